"""Benchmark decontamination with a positional inverted index. DataFrame functions only.

The corpus frequency of every benchmark term gives its rarity. For each window of a benchmark item, the postings
(term, document, position) of its two rarest terms are stored. Subtracting the term's place in the item from the
position aligns the lists: where both rarest terms of a window agree on the offset, the document is a candidate for
that item and offset, and the remaining terms of the phrase are compared there. Terms of a window whose offsets
nearly agree are reported as proximity matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lower_ascii, pick, without_rows

WINDOW = 10
SLOP = 3
#: Terms of a benchmark up to which its term table (some 60 bytes a term) is broadcast; beyond, it is joined by shuffle.
BROADCAST_TERMS = 200_000
#: Documents with candidates up to which their ids (some 40 bytes each) are broadcast to find their texts; beyond, they are joined by shuffle.
BROADCAST_DOCS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), NO_WORD, -1), "")


def benchmark_anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(term, item_id, ih, n, at): the places of the two rarest terms of each window of each item."""
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))
    placed = items.select("item_id", "ih", "n", F.posexplode("w").alias("at", "term")).join(counts, "term", "left")
    # A term that the corpus lacks is the rarest: its windows can't occur, and it has no postings.
    terms = placed.select("item_id", "ih", "n", F.struct(F.coalesce("count", F.lit(0)).alias("c"), "at", "term").alias("x"))
    gathered = terms.groupBy("item_id", "ih", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("x.at", "x.c", "x.term"))), lambda x: F.struct(x["c"], x["at"], x["term"])).alias("xs"))
    rarest = F.flatten(F.transform(starts, lambda s: F.slice(F.array_sort(F.slice("xs", s + 1, window)), 1, 2)))
    return gathered.select("item_id", "ih", "n", F.explode(F.array_distinct(rarest)).alias("x")).where("x.c > 0").select("x.term", "item_id", "ih", "n", "x.at")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, n_near.

    ``items`` are the ids (as sorted strings) of the items that have an exact phrase of ``window`` words in the
    text (of all their words, if they have fewer); n_hit counts the text's words inside any such phrase. ``n_near``
    counts items two rare terms of which lie within ``slop`` words of their distance in the item. Null and empty
    texts have no words and no hits. Rows that repeat id and text are rows of equal results; a null id is a value
    like any other. Items without words or without an id match nothing; items that repeat count once. With an empty
    benchmark nothing is hit; without documents the result is empty. Other columns are ignored.
    """
    texts, results, nears = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, window, slop)
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    every = texts.select("doc_id", "th", n_words.alias("n_words"))
    out = every.join(results, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")), "left").join(nears, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th")), "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), ids.alias("items"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, slop: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts (doc_id, text, th), the results of those that are hit (r_id, r_th, n_hit, items), and their near matches (k_id, k_th, n_near)."""
    texts = pick(docs, doc_id=id_col, text=text_col).withColumn("th", F.xxhash64("text"))
    items = checkpointed(pick(benchmark, item_id=item_col, text=item_text_col).where("item_id IS NOT NULL").select(F.col("item_id").cast("string"), F.xxhash64("text").alias("ih"), words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0").distinct())
    vocabulary = items.select(F.explode("w").alias("term")).distinct()
    small = vocabulary.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    hinted = F.broadcast if small else (lambda x: x)

    # The first pass over the corpus: how often each benchmark term occurs.
    tokens = texts.where("text IS NOT NULL").select(F.explode(words(F.col("text"))).alias("term"))
    counts = checkpointed(tokens.join(hinted(vocabulary), "term", "left_semi").groupBy("term").count())
    anchors = checkpointed(benchmark_anchors(items, counts, window))

    # The second: the stored postings of the rarest terms.
    places = texts.where("text IS NOT NULL").select("doc_id", "th", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    postings = checkpointed(places.join(hinted(anchors.select("term").distinct()), "term", "left_semi"))

    # Lists that are adjusted by the term's place in the item meet by document and item.
    adjusted = postings.join(anchors, "term").select("doc_id", "th", "item_id", "ih", "n", F.struct((F.col("pos") - F.col("at")).alias("off"), "at").alias("p"))
    lists = adjusted.groupBy("doc_id", "th", "item_id", "ih", "n").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    pairs = F.sequence(F.lit(1), F.greatest(F.size("ps") - 1, F.lit(1)))
    exact = F.when(F.col("n") == 1, F.col("ps.off")).otherwise(F.transform(F.filter(pairs, lambda i: F.get("ps", i)["off"] == F.get("ps", i - 1)["off"]), lambda i: F.get("ps", i)["off"]))
    near = F.exists(pairs, lambda i: (F.get("ps", i)["off"] - F.get("ps", i - 1)["off"] <= slop) & (F.get("ps", i)["at"] != F.get("ps", i - 1)["at"]))
    met = checkpointed(lists.select("doc_id", "th", "item_id", "ih", F.array_distinct(exact).alias("offs"), F.coalesce(near, F.lit(False)).alias("near")).where("near OR size(offs) > 0"))

    # The other terms of the phrase, at each offset that the rarest ones agree on.
    wanted = met.where("size(offs) > 0").select(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th")).distinct()
    few = F.broadcast if wanted.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS else (lambda x: x)
    held = texts.join(few(wanted), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")), "left_semi")
    candidates = met.where("size(offs) > 0").join(items.select("item_id", "ih", "w"), ["item_id", "ih"])
    by_doc = candidates.groupBy("doc_id", "th").agg(F.collect_list(F.struct("item_id", "w", "offs")).alias("cands"))
    found = held.alias("t").join(by_doc.alias("c"), F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.th") == F.col("c.th")))
    rows = found.select("t.doc_id", "t.th", words(F.col("t.text")).alias("words"), "c.cands").select("doc_id", "th", "words", F.explode("cands").alias("c"))
    rows = rows.select("doc_id", "th", "words", "c.item_id", "c.w", F.explode("c.offs").alias("off"), F.least(F.size("c.w"), F.lit(window)).alias("need"))
    low = F.greatest(F.lit(1), 1 - F.col("off"))
    high = F.least(F.size("w"), F.size("words") - F.col("off")) - F.col("need") + 1
    starts = F.when(low <= high, F.filter(F.sequence(low, F.greatest(low, high)), lambda s: F.slice("w", s, F.col("need")) == F.slice("words", s + F.col("off"), F.col("need")))).otherwise(F.array().cast("array<int>"))
    hits = rows.select("doc_id", "th", "item_id", "off", "need", starts.alias("starts")).where("size(starts) > 0")
    runs = hits.select("doc_id", "th", "item_id", F.flatten(F.transform("starts", lambda s: F.sequence(s + F.col("off"), s + F.col("off") + F.col("need") - 1))).alias("at"))
    results = runs.distinct().groupBy("doc_id", "th").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    results = results.select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), "n_hit", "items")
    nears = met.where("near").groupBy(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")).agg(F.countDistinct("item_id").alias("n_near"))
    return texts, results, nears


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose own text has no exact phrase of the benchmark.

    Rows are told by id and text: of rows that share an id, or have none, each goes or stays by its text. Null and empty texts stay; an
    empty benchmark drops nothing; an empty table gives an empty table. Very long texts are compared whole.
    """
    _, results, _ = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, window, 0)
    return without_rows(docs, results.select(F.col("r_id").alias("doc_id"), F.col("r_th").alias("th")), id_col, text_col)
