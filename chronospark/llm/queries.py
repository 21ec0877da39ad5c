"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html, line_dedup, neighbours, packing, pii, sharding, simhash, suffix_dedup, toxicity
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % neighbours.EVERY == 0))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict:
    return {
        "op1_nearest": nearest,
        "op2_decontaminate": decontaminate,
        "op3_pack": pack,
        "op4_personal_data": personal_data,
        "op5_dedup_lines": dedup_lines,
        "op6_html_text": html_text,
        "op7_shard": shard,
        "op8_toxic": toxic,
        "op9_near_duplicates": near_duplicates,
        "op10_remove_repeats": remove_repeats,
    }


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(greatest(len(w) - 10, 0) + 1)) AS s FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1:s + n], ' ') AS k FROM bs),
lens AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS x FROM dw),
da AS (SELECT doc_id, p, list(x) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS a FROM dp),
dk AS (SELECT doc_id, p, n, array_to_string(a[1:n], ' ') AS k FROM da CROSS JOIN lens WHERE len(a) >= n),
hits AS (SELECT doc_id, p, dk.n, item_id FROM dk JOIN win ON dk.n = win.n AND dk.k = win.k),
cov AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hits GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov ON dw.doc_id = cov.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id""",
        "op5_dedup_lines": """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, l, unnest(range(len(l) - 2)) AS p FROM d WHERE len(l) >= 3),
w AS (SELECT doc_id, p, trim(l[p + 1], ' ') || chr(10) || trim(l[p + 2], ' ') || chr(10) || trim(l[p + 3], ' ') AS w FROM x),
f AS (SELECT w, min({'d': doc_id, 'a': p}) AS one FROM w GROUP BY w HAVING count(*) > 1),
later AS (SELECT doc_id, p FROM w JOIN f ON w.w = f.w WHERE doc_id <> one.d OR p <> one.a),
g AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS i FROM later) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(l, lambda v, i: NOT list_contains(gone, i - 1)), chr(10)) END, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
    }
