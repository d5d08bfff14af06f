"""The registered queries of this subpackage and their SQL counterparts, where SQL can express them."""

from __future__ import annotations

from corpus_pipeline import run

from .bpe_words import op3_bpe_words
from .flac import op5_flac
from .license_scan import op7_licenses
from .line_dedup import op6_line_dedup
from .minhash_dedup import op1_near_duplicates
from .mixing import op9_mixing
from .pii import op4_pii
from .quality_rules import op8_quality
from .substring_dedup import op10_substring_dedup
from .token_counts import op2_token_counts

QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_token_counts, op3_bpe_words, op4_pii, op5_flac, op6_line_dedup, op7_licenses, op8_quality, op9_mixing, op10_substring_dedup)}
QUERIES["pipeline"] = run

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op6_line_dedup": f"""
WITH lines AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
cut AS (SELECT doc_id, pos, list_sort(list_distinct({_WORDS.format("line")})) AS ws FROM lines),
kept AS (SELECT * FROM cut WHERE len(ws) >= 1),
sets AS (SELECT ws, min(struct_pack(d := doc_id, p := pos)) AS place, row_number() OVER () AS sid FROM kept GROUP BY ws),
tokens AS (SELECT sid, place, len(ws) AS n, unnest(ws) AS w FROM sets),
pairs AS (SELECT a.sid AS a, b.sid AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM tokens a JOIN tokens b ON a.w = b.w AND a.place < b.place GROUP BY 1, 2),
gone AS (SELECT DISTINCT b AS sid FROM pairs WHERE c >= (n + m - c) * 0.8 - 1e-9),
removed AS (SELECT k.doc_id, k.pos FROM kept k JOIN sets s ON k.ws = s.ws WHERE s.sid IN (SELECT sid FROM gone) OR k.doc_id <> s.place.d OR k.pos <> s.place.p),
listed AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS r FROM removed GROUP BY 1)
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines, coalesce(l.n, 0) AS n_removed, coalesce(l.r, '') AS removed FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id""",
    "op10_substring_dedup": f"""
WITH cut AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(ws[p : p + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM cut)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1),
removed AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM later),
positions AS (SELECT doc_id, generate_subscripts(ws, 1) AS q, unnest(ws) AS w FROM cut),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY q) AS t, count(*) AS n FROM positions ANTI JOIN removed USING (doc_id, q) GROUP BY doc_id)
SELECT c.doc_id, CAST(len(c.ws) AS BIGINT) AS n_words, CAST(len(c.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM cut c LEFT JOIN kept k ON c.doc_id = k.doc_id""",
}
