"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learned from one half of a bounded sample of labelled rows (words and word beginnings that mark
toxic texts); trees and calibration are learned from the other half, so that the lexicon's densities mean on the
training rows what they mean elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, isotonic
from .common import bounded_batches, pick

#: Labelled rows that training reads at most, the first by a hash of their id.
SAMPLE_ROWS = 20_000
#: Entries of the learned lexicon at most, the most telling first.
LEXICON = 3_000
PREFIX = 4
#: Log odds from which a term is a sure sign.
SURE = 4.0
EDGES = ".,;:!?\"'()[]{}*#$%&_~-…«»„“”’`"
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú usted ustedes vosotros tuyo".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
UPPER = bytes(range(65, 91))
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FEATURES = ["words", "hits", "density", "strongest", "sum", "prefix_hits", "prefix_density", "prefix_strongest", "sure_hits", "sure_prefixes", "near_person", "person_rate", "capitals", "punctuation", "shouts", "obfuscated", "obfuscated_hits", "stretched", "digits", "length"]


@dataclass
class Toxicity:
    lexicon: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    trees: Boosted | None = None
    at: np.ndarray | None = None
    to: np.ndarray | None = None
    base: float = 0.0

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        data = text.encode()
        size = len(data)
        tokens = text.lower().split()
        words = [w.strip(EDGES) for w in tokens]
        n = max(1, len(words))
        lex, pre = self.lexicon, self.prefixes
        hits = [i for i, w in enumerate(words) if w in lex]
        begins = [pre[b] for w in words if (b := w[:PREFIX]) in pre]
        persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        odd = [w for w in words if not w.isalpha() and any(c.isalpha() for c in w) and not w[-1].isdigit()]
        masked = sum(1 for w in odd if (m := w.translate(LEET)) != w and m in lex or w.replace("*", "").replace(".", "").replace("-", "") in lex)
        near = 0.0
        if hits and persons:
            p = np.array(persons)
            near = float(max(1 / (1 + np.abs(p - i).min()) for i in hits))
        weights = [lex[words[i]] for i in hits]
        capitals = size - len(data.translate(None, UPPER))
        marks = size - len(data.translate(None, PUNCTUATION))
        stretched = sum(text.count(c * 3) for c in "aeiou!?")
        digits = size - len(data.translate(None, b"0123456789"))
        return [math.log1p(n), math.log1p(len(hits)), len(hits) / n, max(weights, default=0.0), math.log1p(sum(weights)), math.log1p(len(begins)), len(begins) / n, max(begins, default=0.0), math.log1p(sum(w >= SURE for w in weights)), math.log1p(sum(w >= SURE for w in begins)), near, len(persons) / n, capitals / size, marks / size, text.count("!") / size, len(odd) / n, math.log1p(masked), stretched / size, digits / size, size / n]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.base)
        raw = self.trees.raw(self.matrix(texts))
        # The step function's plateaus keep the trees' order by a part in a thousand.
        return np.clip(0.999 * np.interp(raw, self.at, self.to) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def _terms(text):
    """Distinct lower-case words, and distinct word beginnings marked by a leading blank."""
    words = F.array_distinct(F.split(F.lower(text), r"[\s.,;:!?\"'()\[\]{}*#$%&_~…«»„“”’`-]+", -1))
    return F.array_union(words, F.transform(F.filter(words, lambda w: F.length(w) > PREFIX), lambda w: F.concat(F.lit(" "), F.substring(w, 1, PREFIX))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out_of: int = 5, sample_rows: int = SAMPLE_ROWS) -> Toxicity:
    """A model from labelled rows whose crc32(id as text) mod ``held_out_of`` is not 0.

    At most ``sample_rows`` rows are used. Without rows of both labels the model scores every text with the
    share of label 1 (0 without any row). A label that is null is no label; of several the largest counts.
    """
    bounded_batches(docs.sparkSession)
    known = pick(labels, doc_id=id_col, y=label_col).where("doc_id IS NOT NULL AND y IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_of != 0)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", F.col("y").cast("int").alias("y"), (F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))).alias("half"))
    rows = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), "doc_id")  # bounded by sample_rows

    first = rows.where("half = 0 AND text IS NOT NULL")
    totals = {r["y"]: r["n"] for r in first.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = Toxicity()
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if pos and neg:
        counts = first.select("y", F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a >= 2 AND length(term) > 1")
        odds = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("b") + 0.5) / (neg + 1))
        sure = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
        best = counts.withColumn("w", odds).withColumn("z", sure).where("w > 1.8 AND z > 2.5").orderBy(F.desc("z"), "term").limit(LEXICON).select("term", "w").collect()
        # Beginnings need more evidence than words: many clean words share one.
        model.prefixes = {r["term"][1:]: round(r["w"], 4) for r in best if r["term"][0] == " "}
        model.lexicon = {r["term"]: round(r["w"], 4) for r in best if r["term"][0] != " "}

    bare = Toxicity(model.lexicon, model.prefixes)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bare.matrix(b.column(2).to_pylist()).tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    second = rows.where("half = 1").select(F.col("doc_id").cast("long"), "y", "text").mapInArrow(extract, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    y = second["y"].to_numpy(dtype=np.float64)
    model.base = float((pos + y.sum()) / max(1, pos + neg + len(y)))
    if not len(y) or y.min() == y.max():
        return model
    x = np.stack(second["x"].to_list())
    fold = np.arange(len(y)) % 4
    # Calibration on scores of rows that the trees which score them have not seen.
    raw = np.zeros(len(y))
    for k in range(4):
        part = fold == k
        raw[part] = Boosted().fit(x[~part], y[~part]).raw(x[part])
    model.trees = Boosted().fit(x, y)
    model.at, model.to = isotonic(raw, y)
    return model


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, held_out_of: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Null and empty texts have all features zero and are scored like any other. A null id is not held out. Rows that
    repeat get equal scores; an empty table gives an empty table; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()))], names=["doc_id", "score"])

    scored = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_of == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Toxicity, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, in one pass, whose text scores below the threshold."""
    bounded_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = model.scores(b.column(at).to_pylist()) < threshold
            yield b.filter(pa.array(keep))

    return docs.select(*names).mapInArrow(run, docs.schema)
