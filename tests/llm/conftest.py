"""Small tables of documents, odd ones among them."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, h string, kept string, size string, class_id string, n_words string"
VOCABULARY = [a + b for a in ("ba", "de", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu") for b in ("l", "m", "n", "r", "s", "t", "v", "x", "z", "ck")]


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Plain, exact and near copies, repeated lines, a shared passage, empty, null and very long texts, repeated rows, a null id."""
    rng = random.Random(5)
    out: list[tuple[int | None, str | None]] = []
    passage = " ".join(words(rng, 60))
    for i in range(40):
        lines = [" ".join(words(rng, rng.randint(3, 30))) for _ in range(rng.randint(2, 6))]
        if i % 5 == 0:
            lines.insert(1, passage)
        out.append((i, "\n".join(lines)))
    base = out[3][1]
    out += [(100, base), (101, base), (102, base + " tail"), (103, base.replace(base.split()[5], "changed", 1))]
    twenty = " ".join(words(rng, 20))
    out += [(110, twenty), (111, twenty), (112, "x " + twenty), (113, " ".join(twenty.split()[:19]))]
    out += [(120, None), (121, ""), (122, "  \n\t \n"), (123, "one"), (124, "one"), (125, "çé 中文 🙂 İstanbul ΣΑΣ   x y"), (126, "a\tb\x0bc\x0cd\re f  g")]
    out += [(130, " ".join(words(rng, 30_000))), (131, "word " * 5000), (132, "z" * 100_000)]
    out += [(140, out[7][1]), (140, out[7][1]), (None, "no id here at all but some words"), (None, base)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts, tmp_path_factory):
    """The texts as a table with further columns whose names the operators use themselves."""
    rows = [(i, t, ["en", "de", None][k % 3], [None, "b", "a", "c"][k % 4] if k % 7 else "b", None, "r", "h", "k", "s", "c", "n") for k, (i, t) in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
