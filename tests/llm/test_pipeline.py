"""The pipeline's stages against plain versions: columns, decisions, order; rows that repeat, are null, or clash."""

import zlib

import corpus_pipeline
import numpy as np
from chronospark.llm import packing, toxicity
from chronospark.llm.queries import tokenizer_path
from pyspark.sql import functions as F
from test_operators import contaminated, deduped
from test_similar import smallest


def test_stages_chain(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=lambda x: x[0])
        ids, texts = [i for i, _ in before], [t for _, t in before]
        kept = stage(spark, kept, small).cache()
        assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
        if name == "toxicity":
            want = {i: t for i, t, s in zip(ids, texts, toxicity.train(docs, labels).scores(texts), strict=True) if s < 0.5}
        elif name == "line_dedup":
            want = dict(zip(ids, deduped(texts), strict=True))
            assert all(r["n_chars"] == len(r["text"] or "") for r in kept.collect())
        elif name == "near_dedup":
            groups = smallest(texts, ids)
            want = {i: t for i, t in before if groups[i] == i}
        else:
            want = {i: t for i, t, x in zip(ids, texts, contaminated(texts, items), strict=True) if not x[4]}
        assert {r["doc_id"]: r["text"] for r in kept.collect()} == want
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, small).collect()
    enc, pieces = packing.WordEncoder(tokenizer_path()), {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert set(pieces) == set(want)
    for i, t in want.items():
        data = enc.whole(t or "") + (1).to_bytes(4, "little")
        own = sorted(pieces[i])
        assert sum(n for _, n, _ in own) == len(data) // 4 and all(zlib.crc32(data[4 * s : 4 * (s + n)]) == c for s, n, c in own)


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 100


def test_stages_on_odd_rows(spark, small):
    """Null ids and texts, repeated ids with other texts, repeated rows, a very long text, columns of clashing names, no rows."""
    r = np.random.default_rng(1)
    words = lambda n: " ".join("".join(r.choice(list("abcdefghij"), 5)) for _ in range(n))
    item = spark.read.parquet(f"{small}/benchmark.parquet").where("length(text) > 80").first()["text"]
    base, other, long = words(80), words(80), words(60000)
    near = base + " end"
    rows = [(1, base), (1, other), (2, near), (2, near), (None, base), (None, words(50)), (3, None), (4, ""), (5, None), (6, long), (6, "x\ny\nz"), (7, "x\ny\nz"), (8, item), (8, words(70)), (None, item)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "th long, gone_id long, gone_th long, `__gone` string, n_lines int, h int, fp int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, "g", 4, 5, 6) for i, t in rows], f"{schema}, {extra}")
    texts = lambda d: sorted(((x["doc_id"] is None, x["doc_id"] or 0, x["text"] is None, x["text"] or "") for x in d.collect()))
    key = lambda i, t: (i is None, i or 0, t is None, t or "")

    lines = corpus_pipeline.dedup_lines(spark, docs, small)
    assert lines.columns == docs.columns
    assert texts(lines) == sorted(key(i, "" if (i, t) == (7, "x\ny\nz") else t) for i, t in rows)
    near_kept = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    assert near_kept.columns == docs.columns
    gone = {(2, near), (None, base), (4, ""), (5, None), (7, "x\ny\nz"), (None, item)}
    assert texts(near_kept) == sorted(key(i, t) for i, t in rows if (i, t) not in gone)
    clean = corpus_pipeline.drop_contaminated(spark, docs, small)
    assert clean.columns == docs.columns and texts(clean) == sorted(key(i, t) for i, t in rows if t != item)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), small)
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)
    packed = corpus_pipeline.pack(spark, docs, small)
    assert packed.where("start = 0").count() == len(rows) and packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    model = toxicity.Toxicity()
    assert texts(toxicity.drop_toxic(docs, model)) == texts(docs)
