"""Headline queries, timed: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from graphloom.workload import QUERIES

HEADLINE = (
    "customer_triples", "order_customer_edge", "shop_graph", "duplicate_subjects", "typed_literals", "quoted_join", "view_window_rank", "fn_strings", "fn_maths", "fn_split_explode",
    "sparql_order_customer_nation", "sparql_star_scan", "sparql_constant_iri", "sparql_filter", "sparql_optional", "sparql_minus", "sparql_group", "sparql_top_k", "sparql_path_sequence", "sparql_variable_predicate",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
