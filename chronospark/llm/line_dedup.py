"""Line dedup over overlapping windows of consecutive lines.

Each run of three consecutive lines is hashed; windows that occur more than once anywhere are found with one
aggregation; every occurrence but the first is covered, overlapping coverage is merged, and covered lines go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, pick

LINES = 3


def _windows(docs: DataFrame, lines: int) -> DataFrame:
    """(doc_id, th, at, w): a row for each window; th tells texts of the same id apart, w is a 128-bit hash in two longs."""
    split = docs.where("text IS NOT NULL").select("doc_id", "th", F.split("text", "\n", -1).alias("l"))
    n = F.size("l") - F.lit(lines - 1)
    joined = lambda i: F.concat_ws("\n", *[F.trim(F.element_at("l", i + k)) for k in range(1, lines + 1)])
    hashed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("at"), F.xxhash64(joined(i)).alias("w1"), F.xxhash64(F.lit("second"), joined(i)).alias("w2")))
    return split.where(n > 0).select("doc_id", "th", F.explode(hashed).alias("x")).select("doc_id", "th", "x.at", "x.w1", "x.w2")


def covered_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc_id, th, gone): the numbers of the lines to remove, for each document that has any."""
    found = _windows(docs, lines)
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "at")
    repeated = found.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("w1", "w2", "first")
    later = found.join(repeated, ["w1", "w2"]).where(place != F.col("first")).select("doc_id", "th", "at")
    merged = later.groupBy("doc_id", "th").agg(F.collect_set("at").alias("at"))
    spread = F.flatten(F.transform("at", lambda a: F.sequence(a, a + lines - 1)))
    return merged.select("doc_id", "th", F.array_distinct(spread).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """All columns of ``docs`` with the cleaned text in ``text_col``, and n_lines, n_removed.

    Lines are split at line feeds and compared without blanks at their ends. The first occurrence of a window is
    the one in the smallest document (by id, null last, then by a hash of the text), at its first position; every
    other occurrence is covered. A text of fewer than three lines is never changed. Null stays null, with no lines.
    Rows that repeat both id and text are one document and get the same result. A text all of whose lines go becomes
    empty. An empty table gives an empty table. A very long text is one row of arrays of its lines, as long as the text. Columns of
    any name pass through, but for input columns n_lines and n_removed, which are replaced.
    """
    i, t, g = fresh(docs, "gone_id", "gone_th", "gone_lines")
    plain = pick(docs, doc_id=id_col, text=text_col).withColumn("th", F.xxhash64("text"))
    gone = covered_lines(plain, lines).select(F.col("doc_id").alias(i), F.col("th").alias(t), F.col("gone").alias(g))
    text = docs[text_col]
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone[i]) & (F.xxhash64(text) == gone[t]), "left")
    own = F.split(text, "\n", -1)
    kept = F.concat_ws("\n", F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), g), lambda i: F.get(own, i)))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n", -1)))
    cleaned = F.when(F.col(g).isNull(), text).otherwise(kept)
    out = [cleaned.alias(c) if c == text_col else docs[c] for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return joined.select(*out, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(g), F.lit(0)).cast("long").alias("n_removed"))
