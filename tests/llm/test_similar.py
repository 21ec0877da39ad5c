"""Near copies by shingle similarity, against brute force."""

import random
from fractions import Fraction
from itertools import combinations

import corpus_pipeline
import pytest
from chronospark.llm import similar


def shingled(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def smallest(texts, ids):
    sets = [shingled(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(sets)), 2):
        both = len(sets[a] | sets[b])
        if sets[a] == sets[b] or Fraction(len(sets[a] & sets[b]), both) >= Fraction(4, 5):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    out = [None, "", " \n", "One two", "one  TWO", "one two three"]
    for size in [6, 9, 14, 30, 60, 120, 200, 400] * 4:
        base = [word() for _ in range(size)]
        out.append(" ".join(base))
        for changes in (0, 1, 1 + size // 60, 1 + size // 40, 1 + size // 20):
            near = list(base)
            for _ in range(changes):
                near[rng.randrange(size)] = word()
            out.append(" ".join(near))
        out += [" ".join([*base, word()]), " ".join(base[size // 8 :]), " ".join(base[: size // 2])]
    return out


@pytest.mark.parametrize("tiles", [(4096, 4_000_000), (4, 300)])
def test_components(spark, texts, monkeypatch, tiles):
    monkeypatch.setattr(similar, "TILE_ROWS", tiles[0])
    monkeypatch.setattr(similar, "TILE_SHINGLES", tiles[1])
    ids = [(i * 37) % 1009 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["component_id"] for r in similar.components(docs).collect()} == smallest(texts, ids)


def test_stage_drops_near_copies(spark, small):
    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    changed = " ".join([*base[:40], "x", *base[41:80], "y", *base[81:]])  # 106 of 126 shingles are shared
    other = " ".join([*base[:20], "x", *base[21:60], "y", *base[61:100], "z", *base[101:]])  # 101 of 131
    docs = spark.createDataFrame([(1, " ".join(base)), (2, changed), (3, other), (None, " ".join(base)), (None, None)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, None]  # a null id goes like any other copy
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), small).count() == 0
