"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from chronospark.llm import boosting, components, decontamination, html, line_dedup, neighbours, packing, pii, sharding, simhash, suffix_dedup, tagger, toxicity
from chronospark.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, th string, size int, n int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, ids=None):
    """Documents with further columns whose names the operators use inside."""
    rows = [((ids or range(1, len(texts) + 1))[i], t, "en", "s", len(t or ""), 1, "x", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(3)
    vocabulary = ["".join(r.choice(list("abcdeé"), r.integers(1, 6))) for _ in range(60)]
    make = lambda n: " ".join(r.choice(vocabulary, n))
    long = make(4000)
    base = [make(int(n)) for n in r.integers(1, 120, 30)]
    return [*base, base[3], base[3], base[4] + " zz", None, "", "   ", "\n\n\n\n", long, "x " + long[:9000], "A b\nC d\nE f\nG", "q\nA b\nC d\nE f", "aaaa" * 900, "日本語 テキスト ñandú"]


# near duplicates


def test_fingerprint_is_the_majority_of_shingle_bits():
    text = "The  quick\tBROWN fox Über jumps over"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("one two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_pivot_pairs_lose_nothing():
    r = np.random.default_rng(1)
    fps = r.integers(0, 2**64, 40, dtype=np.uint64)
    fps = np.concatenate([fps, fps ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)), fps[:9] ^ np.uint64(5)])
    group = np.sort(r.integers(0, 3, len(fps)))
    a, b = simhash.pivot_pairs(group, fps)
    got = {frozenset((int(x), int(y))) for x, y in zip(a, b, strict=True)}
    assert got == {frozenset((i, j)) for i in range(len(fps)) for j in range(i) if group[i] == group[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 2}


def classes(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [min(ids[j] for j in range(len(fps)) if find(j) == find(i)) for i in range(len(fps))]


def test_near_duplicates(spark, texts, monkeypatch):
    docs = frame(spark, texts)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = [simhash.fingerprint(t) for t in texts]
    want = classes(fps, range(1, len(texts) + 1))
    assert got == {i + 1: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, want, strict=True))}
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == set(want)


@pytest.mark.parametrize("n", [1, 4, 9])
def test_cells_bring_all_links_together(n):
    r = np.random.default_rng(n)
    a = r.integers(0, 2**64, 3000, dtype=np.uint64)
    flips = [np.uint64(1) << r.integers(0, 64, 3000).astype(np.uint64) for _ in range(2)]
    b = a ^ flips[0] ^ flips[1]
    own, keys = simhash.cells(np.concatenate([a, b]), n, 6, 2)
    places = {}
    for i, k in zip(own.tolist(), keys.tolist(), strict=True):
        places.setdefault(i, set()).add(k)
    assert all(places[i] & places[i + 3000] for i in range(3000))
    assert len(own) < 6000 * 1.5**n
    assert simhash.cell_pivots(0) == simhash.cell_pivots(10) == 1 < simhash.cell_pivots(10**6) < simhash.cell_pivots(10**9) <= simhash.PIVOTS - 4


def test_drops_tell_rows_by_id_and_text(spark):
    rows = [(1, "a b c d"), (1, "zz yy xx ww vv"), (0, "a b c d"), (None, "a b c d"), (None, "q r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda d: sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=str)
    assert kept(simhash.drop_near_duplicates(docs)) == sorted([rows[1], rows[2], rows[4]], key=str)
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert kept(decontamination.drop_contaminated(docs, bench)) == sorted([rows[1], rows[4]], key=str)


def test_links_of_a_crowd_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    fps = [i for i in range(64)] + [1 << 40, (1 << 40) + 3]
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    comps = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    want = classes(fps, fps)
    assert {f: comps.get(f, f) for f in fps} == dict(zip(fps, want, strict=True))


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 400), (7, 8), (8, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}


# decontamination


def contaminated(texts, items, window=10):
    words = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (x or "").translate(LOW))
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination(spark, texts):
    w = texts[-6].split()
    items = [(1, " ".join(w[5:40])), (2, "A b c-D"), (10, texts[3]), (10, texts[3]), (3, None), (4, "..."), (5, " ".join(w[100:110]).upper()), (6, "ñandú"), (7, "é é é é é é é é é é é é"), (None, "abc")]
    docs = [*texts, "a B. c d e", "nothing " + " ".join(w[100:109]), "x " + " ".join(w[100:112]) + " y", "é " * 30]
    bench = spark.createDataFrame([(i, t, "c", 1) for i, t in items], "item_id long, text string, th string, n int")
    rows = decontamination.contamination(frame(spark, docs), bench).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows}
    assert got == {i + 1: x for i, x in enumerate(contaminated(docs, [x for x in items if x[0] is not None]))}
    kept = {r["doc_id"] for r in decontamination.drop_contaminated(frame(spark, docs), bench).collect()}
    assert kept == {i for i, x in got.items() if not x[4]}


def test_contamination_without_rows(spark, texts):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontamination.contamination(frame(spark, texts), none).collect()} == {0}
    assert decontamination.contamination(frame(spark, []), none).count() == 0


def test_repeated_rows_and_null_ids_of_contamination(spark):
    docs = frame(spark, ["a b c", "a b c", None, "a b c"], [1, 1, None, None])
    rows = decontamination.contamination(docs, spark.createDataFrame([(1, "b c")], "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_hit"]) for r in rows) == {(1, 2): 2, (None, 2): 1, (None, 0): 1}


# packing


def test_word_encoder_equals_the_tokenizer():
    import pyarrow as pa

    enc = packing.WordEncoder(tokenizer_path())
    odd = ["I'LL don't İstanbul ÀÉÎ naïve ﬁ éa 12ab\x1cb ΑΣ ΟΔΟΣ. ", "<|endoftext|> a", "x<|startoftext|>y", " \t\n", "ẞ ÿŸ...!? ;;a,b 's S can'T", "日本語 текст 😀😀", "a." * 50, "", "word*** A&&& b"]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in enc.tokenizer.encode_batch(odd, add_special_tokens=False)]
    for _ in range(2):
        assert enc.batch(pa.array(odd)) == want
    assert enc.batch(pa.array([None, "a"], pa.string())) == [b"", enc.whole("a")]


def test_packing_is_an_exact_round_trip(spark, texts):
    docs = frame(spark, texts * 3).repartition(3)
    rows = [r.asDict() for r in packing.pack(docs, tokenizer_path(), length=256, open_windows=4, keep_ids=True).collect()]
    enc = packing.WordEncoder(tokenizer_path())
    ids = {i + 1: enc.whole(t or "") + (1).to_bytes(4, "little") for i, t in enumerate(texts * 3)}
    for r in rows:
        data = ids[r["doc_id"]]
        assert r["ids"] == data[4 * r["start"] : 4 * (r["start"] + r["length"])] and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["doc_tokens"] == len(data) // 4
    for doc, data in ids.items():
        own = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == doc)
        assert [s for s, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) == len(data) // 4
    sizes = {}
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist()
        sizes[s] = sum(n for _, n in own)
    assert all(n == 256 or n & (n - 1) == 0 for n in sizes.values()) and max(sizes.values()) <= 256
    assert sum(256 - n for n in sizes.values() if n & (n - 1)) == 0


def test_packing_of_no_rows(spark):
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


# line dedup


def deduped(texts):
    order = sorted(range(len(texts)), key=lambda i: i)
    first, gone = {}, {i: set() for i in range(len(texts))}
    counts = Counter()
    windows = lambda t: [tuple(x.strip(" ") for x in t.split("\n")[k : k + 3]) for k in range(len(t.split("\n")) - 2)] if t is not None else []
    for i in order:
        for k, w in enumerate(windows(texts[i])):
            counts[w] += 1
            if first.setdefault(w, (i, k)) != (i, k):
                gone[i] |= {k, k + 1, k + 2}
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in enumerate(texts)]


def test_line_dedup(spark, texts):
    docs = [*texts, "a\nb\nc\nd\ne", "x\na \n b\nc\nd", "a\nb\nc\na\nb\nc\na\nb\nc", "b\nc\nd\ne\nf", "one\ntwo", "\n\n\n"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert got == {i + 1: t for i, t in enumerate(deduped(docs))}
    again = line_dedup.dedup_lines(frame(spark, ["a\nb\nc"] * 2, [1, 1])).collect()
    assert [r["n_removed"] for r in again] == [0, 0]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    clash = frame(spark, ["a\nb\nc", "a\nb\nc", None]).withColumnsRenamed({"h": "__gone", "n": "n_lines", "size": "N_REMOVED", "th": "gone_th"})
    out = line_dedup.dedup_lines(clash)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "__gone", "gone_th", "n_lines", "n_removed"]
    assert sorted((r["doc_id"], r["n_lines"], r["n_removed"]) for r in out.collect()) == [(1, 3, 0), (2, 3, 3), (3, 0, 0)]


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><p>One <b>two</b>
three<p hidden>no</p><div style="display: none">no</div><ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul><script>var x = "</p>";</script>
<table><caption>Cap</caption><tr><th>k<th>value<tr><td>aa<td>1<tr><td>b<td>22</table><pre>x
  y</pre>end<br>line &lt;<!-- c --><span aria-hidden=true>seen</span></body></html>"""


def test_html_layout():
    title, text, tables = html.render(PAGE)
    assert title == "T & t" and tables == 1
    assert text == "One two three\n\n- a\n- b\n  3. c\n  4. d\n\nCap\nk   value\naa  1\nb   22\n\nx\n  y\n\nend\nline <seen"


@pytest.mark.parametrize("source", ["", "plain", "<", "<p", "</p></div>", "<div>" * 5000 + "deep", "<table>x<td>y", "<!-- open", "<script>never closed", "<a href='x>y</a>", "<li>" * 300, "<title>İ</title>x"])
def test_html_never_fails(source):
    title, text, _ = html.render(source)
    assert isinstance(text, str) and "<div>" not in text


def test_extract(spark):
    pages = spark.createDataFrame([(1, PAGE, "u"), (2, None, "u"), (None, "", "u"), (1, PAGE, "v")], "page_id long, html string, title string")
    rows = html.extract(pages).collect()
    assert Counter((r["page_id"], r["n_tables"]) for r in rows) == {(1, 1): 2, (2, 0): 1, (None, 0): 1}


# sharding


def test_shards(spark, texts):
    docs = frame(spark, texts * 20 + ["hot " * 50] * 400)
    rows = sharding.shards(docs, n_shards=8, ranges=4).collect()
    sizes = Counter()
    slots = {}
    for r in rows:
        t = ((texts * 20 + ["hot " * 50] * 400)[r["doc_id"] - 1] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t) + 16, zlib.crc32(t), "bytes")
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(texts) * 20 + 400 and set(sizes) == set(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max(len((t or "").encode()) for t in texts) + 16
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest + 0.02 * sum(sizes.values()) / 8
    assert sharding.shards(frame(spark, [])).count() == 0
    assert sharding.shards(frame(spark, ["a", "a", None], [1, 1, None])).count() == 3
    equal = frame(spark, ["same words"] * 600 + ["x"], [None] * 600 + [1])
    spread = Counter(r["shard"] for r in sharding.shards(equal, n_shards=4, ranges=4).collect())
    assert sum(spread.values()) == 601 and max(spread.values()) < 170


def test_written_shards(spark, texts, tmp_path):
    docs = frame(spark, [*texts, "a", "a", "b"], [*range(1, len(texts) + 1), 1, 1, None]).withColumnsRenamed({"h": "slot", "n": "shard", "size": "row", "th": "row_number"})
    placed = sharding.write_shards(docs, str(tmp_path / "out"), n_shards=3, ranges=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    rows = lambda d: Counter((r["doc_id"], r["text"], r["slot"], r["row"], r["row_number"]) for r in d.collect())
    assert rows(back) == rows(docs) and Counter(r["shard"] for r in back.collect()) == Counter(r["shard"] for r in placed.collect())


# toxicity


def test_toxicity_on_held_out_rows(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    y, rank = got["toxic"].to_numpy() == 1, got["score"].rank().to_numpy()
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.97 and (got["predicted"].to_numpy() == y).mean() > 0.96


def test_toxicity_without_labels_and_on_odd_rows(spark, texts):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, texts), none)
    rows = toxicity.score(frame(spark, texts), model).collect()
    assert {r["score"] for r in rows} == {0.0} and len(rows) == len(texts)
    assert [r["held_out"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [zlib.crc32(str(i + 1).encode()) % 5 == 0 for i in range(len(texts))]
    assert toxicity.drop_toxic(frame(spark, texts), model).columns == frame(spark, texts).columns


def test_isotonic_rises_and_trees_fit():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    raw = boosting.Boosted().fit(x, y).raw(x)
    assert ((raw > 0) == y).mean() > 0.9
    at, to = boosting.isotonic(raw, y)
    assert (np.diff(at) > 0).all() and (np.diff(to) >= 0).all()


# personal data


def test_patterns_equal_plain_expressions():
    r = np.random.default_rng(5)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(2000):
        text = "".join(r.choice(list("ab.@@-+ é1"), 30))
        assert [m.span() for m in email.finditer(text)] == [(a, b) for a, k, b in pii.patterns(text) if k == "email"]
    text = "é a@b.co 1.2.3.4 x 999.1.1.1 x 4111 1111-1111 1111 x 4111111111111112 +1 (843) 555-7672 x " + "9" * 6000 + ".1.1.1"
    assert [(k, text[a:b]) for a, k, b in pii.patterns(text)] == [("email", "a@b.co"), ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (843) 555-7672")]


def test_network_gradient():
    net, r = tagger.Tagger(5, 4), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, tags = r.integers(0, tagger.CLASSES, (3, 7)), r.integers(0, 5, (3, 7))
    _, g = net.gradients(ids, tags)
    for k, w in net.p.items():
        at = (ids[0, 3], 1) if k[0] == "E" else tuple(r.integers(0, s) for s in w.shape)
        old, step = w[at], 1e-4
        w[at] = old + step
        up = net.gradients(ids, tags)[0]
        w[at] = old - step
        down = net.gradients(ids, tags)[0]
        w[at] = old
        assert abs((up - down) / (2 * step) - g[k][at]) < 1e-3, k


def test_network_on_held_out_texts(spark):
    """Every disguise in texts that training did not see, the spans of clean texts, and the query with a network."""
    data = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) < 4000")
    fitted, held = data.where("doc_id % 5 > 0"), [r["text"] for r in data.where("doc_id % 5 = 0").orderBy("doc_id").collect()]
    net = pii.train(fitted)
    r = np.random.default_rng(8)
    texts, want = [], []
    for kind, forms in pii.FORMS.items():
        for form in forms:
            for _ in range(25):
                words = held[r.integers(len(held))].split(" ")
                at = int(r.integers(len(words)))
                head, span = "".join(w + " " for w in words[:at]), pii.disguised(kind, pii.invented(kind, r), form)
                texts.append(" ".join([head + span, *words[at:]]))
                want.append((kind, form, (len(head), kind, len(head) + len(span))))
    found = pii.decoded(net, texts, [pii.patterns(t) for t in texts])
    recall = {}
    for (kind, form, span), spans in zip(want, found, strict=True):
        recall.setdefault((kind, form), []).append(span in spans)
    recall = {k: sum(v) / len(v) for k, v in recall.items()}
    assert sum(recall.values()) / len(recall) >= 0.9 and min(recall.values()) >= 0.7, recall
    added = pii.decoded(net, held, [pii.patterns(t) for t in held])
    assert sum(map(bool, added)) <= 0.01 * len(held)
    rows = pii.find(frame(spark, [*texts[:40], "long " * 40000 + texts[0]]), net).collect()
    assert sum(r["n_added"] for r in rows) >= 30 and all(r["n_spans"] == r["n_added"] + r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len([x for x in r["spans"].split(",") if x]) for r in rows)


def brute(text):
    """The base spans by the contract's expressions as they stand."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)]
    return [x[:1] + x[2:] for x in sorted((m.start(), i, k, m.end()) for i, (k, e, fine) in enumerate(rules) for m in re.finditer(e, text) if fine(m[0]))]


def test_base_spans_equal_brute_force(spark, small):
    r = np.random.default_rng(6)
    odd = ["".join(r.choice(list("0123456789.+- ()@a"), 60)) for _ in range(3000)]
    docs = [x["text"] or "" for x in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for text in [*odd, *docs]:
        assert [(a, k, b) for a, k, b in pii.patterns(text)] == brute(text)
    import time

    began = time.perf_counter()
    pii.patterns("1" * 300_000)
    assert time.perf_counter() - began < 2


def test_find(spark, texts):
    docs = frame(spark, [*texts, "mail a.b@c-d.example now", "1.2.3.4"], None)
    rows = {r["doc_id"]: r for r in pii.find(docs, None).collect()}
    last = rows[len(texts) + 1]
    assert (last["n_email"], last["spans"], last["base_sha256"]) == (1, "email:5:20", hashlib.sha256(b"email:5:20").hexdigest())
    assert rows[34]["base_sha256"] == hashlib.sha256(b"").hexdigest() and len(rows) == len(texts) + 2


# neighbours


def test_nearest(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 16)).astype(np.float32)
    x[50:80] = x[0]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(300)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] + [1.0] * 15, 1), (304, [float("inf")] * 16, 1), (0, [float(v) for v in x[0]], 1), (None, [1.0] * 16, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, side int")
    got = {}
    for q in neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), query_block=4, candidate_block=64).collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    assert set(got) == {0, 50, 100, 150, 200, 250}
    for q, found in got.items():
        score = (x * x[q]).sum(1) / (norm * norm[q])
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-score[i], i))[:5]
        assert [(a, b) for a, b, _ in sorted(found)] == list(enumerate(want, 1))
        assert np.allclose([s for _, _, s in sorted(found)], score[want], rtol=0, atol=1e-15)
    empty = vectors.limit(0)
    assert neighbours.nearest(empty, empty).count() == 0


def test_quantisation_bound():
    r = np.random.default_rng(4)
    q, c = r.normal(size=(20, 48)), r.normal(size=(200, 48))
    a, b, low, high = neighbours.tile(np.arange(20), neighbours.quantise(q)[:4], np.arange(100, 300), neighbours.quantise(c)[:4], 3)
    exact = (q @ c.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(c, axis=1)[None]
    assert (low <= exact[a, b]).all() and (exact[a, b] <= high).all() and len(a) < 20 * 12
    assert {(i, j) for i in range(20) for j in np.argsort(-exact[i])[:3]} <= set(zip(a.tolist(), b.tolist(), strict=True))


# repeated strings


def removed(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        spans = []
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + d[at:a], b
        out.append((len(d), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + d[at:]).hexdigest()))
    return out


def test_two_stage_sorting():
    r = np.random.default_rng(1)
    for _ in range(200):
        x = r.choice([1, 2, 3, 255], int(r.integers(1, 60))).astype(np.uint8)
        data = x.tobytes()
        order = suffix_dedup.two_stage_suffix_array(x)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: data[i:])
        for i, j, n in zip(order[:-1], order[1:], suffix_dedup.common_prefixes(x, order[:-1], order[1:]), strict=True):
            k = 0
            while max(i, j) + k < len(x) and data[i + k] == data[j + k]:
                k += 1
            assert n == k


@pytest.mark.parametrize("group", [2048, 1])
def test_remove_repeats(spark, texts, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    docs = [*texts, texts[-6][200:1500], "é" * 700 + texts[-6][300:2000] + "tail", texts[-6][:399], "ab" * 3000]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(frame(spark, docs)).collect()}
    assert got == {i + 1: x for i, x in enumerate(removed(docs, 400))}


def test_remove_repeats_across_parts_and_without_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 512)
    r = np.random.default_rng(9)
    a = "".join(r.choice(list("abcdefgh"), 3000))
    docs = [a, "x" + a[700:1900] + "y"]
    rows = suffix_dedup.remove_repeats(frame(spark, docs)).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows] == removed(docs, 400)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    assert {x["n_removed"] for x in suffix_dedup.remove_repeats(frame(spark, [a, a], [1, 1])).collect()} == {3000}


def marked(texts, passage=51):
    """For each text whether a passage of so many words stands in another text too."""
    windows = [{tuple(w[i : i + passage]) for i in range(len(w) - passage + 1)} for w in (re.findall("[^ \t-\r]+", t or "") for t in texts)]
    counts = Counter(w for x in windows for w in x)
    return [any(counts[w] > 1 for w in x) for x in windows]


def test_shared_passages(spark):
    r = np.random.default_rng(21)
    word = lambda: "".join(r.choice(list("abcdefghijé"), int(r.integers(1, 5))))
    make = lambda n: [word() for _ in range(n)]
    passages = [make(n) for n in (51, 53, 60, 80)]
    docs = [" ".join([*make(int(r.integers(0, 90))), *passages[i % 4], *make(int(r.integers(0, 90)))]) for i in range(12)]
    short = make(39)
    clean = [" ".join(make(int(n))) for n in r.integers(0, 300, 20)] + [" ".join([*make(60), *short, *make(60)]) for _ in range(3)] + [" ".join(make(60) * 3)]
    texts = [*docs, *clean, None, "", " \n", "w" * 9000 + " x" * 60]
    want = marked(texts)
    got = {x["doc_id"]: x for x in suffix_dedup.remove_repeats(frame(spark, texts).repartition(3)).collect()}
    assert [got[i + 1]["n_shared"] > 0 for i in range(len(texts))] == want and want == [True] * 12 + [False] * (len(texts) - 12)
    assert [got[i + 1]["n_removed"] for i in range(len(texts))] == [x[1] for x in removed(texts, 400)]
    again = suffix_dedup.remove_repeats(frame(spark, [docs[0]] * 2, [1, 1])).collect()
    assert [x["n_shared"] > 0 for x in again] == [True, True] and len({x["n_shared"] for x in again}) == 1
