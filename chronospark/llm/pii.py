"""Personal data: exact patterns, and spans that a character-level BiLSTM-CRF adds.

The network is trained in numpy from labelled spans: those that the patterns find in a bounded sample of texts, and
made-up ones put into these texts, mostly in disguises that the patterns miss ("name at host dot org", digits grouped by other
marks). It reads overlapping windows wherever a text has a digit or an at sign (also spelled out). The decoded spans of all windows
are reconciled over the whole text: those cut by their window's edge go, as another window has them whole; of the rest, which the
network must give a probability of ``SURE`` for every character, long ones win over short, and none overlaps a pattern's span.
Beyond that only the digits are held against the kind's own rule (four numbers below 256, a check digit, a length).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pick
from .tagger import CLASSES, Tagger, encode

KINDS = ("email", "ip", "card", "phone")
#: Texts that training reads at most (those with what looks like a span first, by the smallest hashes), their length, and the windows it makes of them at most.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_WINDOWS = 1500, 4000, 7000
WINDOW, STRIDE = 96, 48
#: Batches that training goes through, if that is not under one epoch.
STEPS, BATCH, HIDDEN = 656, 96, 16
#: Windows that are decoded at once, and the probability that every character of an added span must have.
DECODE, SURE = 1024, 0.3
_SYLLABLES = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u", "an", "er", "il", "on")]
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")
_TRIGGER = re.compile(r"[0-9@]|\b(?:at|AT)\b")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the name is the whole run before an at sign, as far as no match has taken it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def patterns(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every pattern's matches that pass its check, by start, then kind as listed."""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) < 4 and int(x or 0) < 256 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def numbers_fit(kind: str, found: str) -> bool:
    """Whether a span's digits can be of its kind, whatever stands between them; an address needs none."""
    digits = _NO_DIGIT.sub("", found)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p) < 4 and int(p) < 256 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits.removeprefix("00")) <= 15


def _name(r: np.random.Generator, least: int = 2, most: int = 4) -> str:
    return "".join(_SYLLABLES[i] for i in r.integers(0, len(_SYLLABLES), int(r.integers(least, most))))


def invented(kind: str, r: np.random.Generator) -> str:
    """A span as the patterns find it, of made-up parts."""
    one = lambda *x: x[r.integers(len(x))]
    if kind == "email":
        name = _name(r) + one("", "", f".{_name(r)}", f"_{_name(r)}", str(r.integers(1, 1000)), f"+{_name(r, 1, 2)}")
        return f"{name}@{_name(r)}{one('', f'-{_name(r, 1, 3)}', f'.{_name(r, 1, 3)}')}.{one('com', 'org', 'net', 'de', 'fr', 'es', 'io', 'example', 'test', 'co.uk', 'edu', 'info')}"
    if kind == "ip":
        return ".".join(str(x) for x in r.integers(0, 256, 4))
    digits = "".join(map(str, r.integers(0, 10, int(one(13, 14, 15, 15, 15, 15, 18) if kind == "card" else r.integers(10, 14)))))
    digits = one("4", "5", "37", "6")[: 1 if kind == "phone" else 2] + digits[1:]
    if kind == "card":
        digits += str(next(c for c in range(10) if luhn(digits + str(c))))
        return one("", " ", "-").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    return f"+{digits[:2]}{one(' ', '-', ' (')}{digits[2:5]}{one(' ', '-', ') ')}{digits[5:]}".replace("(" + digits[2:5] + " ", "(" + digits[2:5] + ") ")


def _grouped(digits: str, mark: str) -> str:
    return mark.join(digits[k : k + 4] for k in range(0, len(digits), 4))


#: Forms in which the patterns miss a span, by kind: of an address's name and host, or of the digits.
FORMS = {
    "email": {
        "words": lambda n, h: f"{n} at {h.replace('.', ' dot ')}",
        "capital words": lambda n, h: f"{n} AT {h.replace('.', ' DOT ')}",
        "brackets": lambda n, h: f"{n} [at] {h.replace('.', ' [dot] ')}",
        "tight brackets": lambda n, h: f"{n}[at]{h}",
        "parentheses": lambda n, h: f"{n}(at){h.replace('.', '(dot)')}",
        "spaced": lambda n, h: f"{n} @ {h}",
        "dots in brackets": lambda n, h: f"{n}@{h.replace('.', '[.]')}",
    },
    "ip": {"brackets": lambda d: d.replace(".", "[.]"), "parentheses": lambda d: d.replace(".", "(.)"), "spaced": lambda d: d.replace(".", " . ")},
    "card": {"dots": lambda d: _grouped(d, "."), "slashes": lambda d: _grouped(d, "/"), "wide": lambda d: _grouped(d, "  "), "low lines": lambda d: _grouped(d, "_"), "spaced hyphens": lambda d: _grouped(d, " - ")},
    "phone": {"zeros": lambda d: f"00{d}", "zeros apart": lambda d: f"00 {d[:2]} {d[2:5]}-{d[5:]}", "slashes": lambda d: f"+{d[:2]}/{d[2:5]}/{d[5:]}"},
}


def disguised(kind: str, found: str, form: str) -> str:
    """A span in one of the forms that the patterns miss."""
    make = FORMS[kind][form]
    if kind == "email":
        return make(*found.rsplit("@", 1))
    return make(found if kind == "ip" else _NO_DIGIT.sub("", found))


def _number(r: np.random.Generator) -> str:
    """Digits that are nobody's: dates, times, versions, amounts, ranges, codes."""
    n = lambda a, b: int(r.integers(a, b))
    return [lambda: f"{n(1900, 2030)}-{n(1, 13):02d}-{n(1, 29):02d}", lambda: f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2030)}", lambda: f"{n(0, 24):02d}:{n(0, 60):02d}", lambda: f"{n(0, 20)}.{n(0, 30)}.{n(0, 99)}", lambda: f"{n(1, 10**6):,}", lambda: f"{n(0, 10**4)}.{n(0, 100):02d}", lambda: f"{n(1, 500)}-{n(500, 1000)}", lambda: str(n(1, 10 ** n(1, 12))), lambda: f"{n(0, 1 << 62):x}"[: n(6, 16)], lambda: f"@{_name(r)}", lambda: f"at {n(1, 100)} {_name(r)}", lambda: f"{_name(r)} at {_name(r)} {_name(r)}", lambda: f"{n(1, 60)}/{n(1, 60)}", lambda: f"({n(1, 60)})", lambda: f"[{n(1, 60)}] {n(1, 2030)}", lambda: f"{_name(r)}_{n(1, 9999)}"][r.integers(16)]()


def _tags(size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(size, dtype=np.int64)
    for start, kind, end in spans:
        a, b = max(0, start), min(size, end)
        if a < b:
            tags[a:b] = 2 + 2 * kind
            if start >= 0:
                tags[start] = 1 + 2 * kind
    return tags


def training_windows(texts: list[str], most: int = SAMPLE_WINDOWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows of these texts: a third as they are, around digits and the like; a half with an invented span put in,
    mostly disguised; the rest with other digits put in."""
    r, ids, tags = np.random.default_rng(seed), [], []
    made = [(kind, form) for kind, forms in FORMS.items() for form in forms]
    texts = [t for t in texts if t]
    known: dict[int, list] = {}

    def add(part: str, spans: list[tuple[int, int, int]]) -> None:
        codes = np.full(WINDOW, CLASSES - 1, dtype=np.int64)
        codes[: len(part[:WINDOW])] = encode(part[:WINDOW])
        ids.append(codes)
        tags.append(np.concatenate([_tags(len(part[:WINDOW]), spans), np.zeros(max(0, WINDOW - len(part)), dtype=np.int64)]))

    while texts and len(ids) < most:
        k = int(r.integers(len(texts)))
        text = texts[k]
        if k not in known:
            known[k] = [(a, KINDS.index(kind), b) for a, kind, b in patterns(text)]
        if any(b > c for (_, _, b), (c, _, _) in zip(known[k], known[k][1:])):
            known[k] = [s for i, s in enumerate(known[k]) if all(s[2] <= o[0] or o[2] <= s[0] for j, o in enumerate(known[k]) if i != j)]
        spans, turn = known[k], r.random()
        if turn < 0.35:
            places = [m.start() for m in _TRIGGER.finditer(text)] or [int(r.integers(len(text)))]
            at = max(0, places[r.integers(len(places))] - int(r.integers(4, WINDOW - 4)))
            add(text[at : at + WINDOW], [(a - at, kind, b - at) for a, kind, b in spans])
            continue
        at = int(r.integers(len(text)))
        while at < len(text) and not text[at].isspace():
            at += 1
        if any(a < at < b for a, _, b in spans):
            continue
        if turn < 0.8:
            kind, form = made[r.integers(len(made))]
            new = invented(kind, r)
            if r.random() < 0.85:
                new = disguised(kind, new, form)
            found = [(0, KINDS.index(kind), len(new))]
        else:
            new, found = _number(r), []
        lead, tail = " " if at and r.random() < 0.9 else "\n", ["", ".", ",", "\n", ";"][r.integers(5)]
        start = max(0, at - int(r.integers(0, WINDOW)))
        put = at - start + len(lead)
        shift = len(lead) + len(new) + len(tail)
        whole = text[start:at] + lead + new + tail + text[at : at + WINDOW]
        labelled = [(a - start + (shift if a >= at else 0), x, b - start + (shift if a >= at else 0)) for a, x, b in spans] + [(a + put, x, b + put) for a, x, b in found]
        skip = int(r.integers(0, max(1, put + len(new) // 2 - WINDOW // 2 + 1))) if put + len(new) > WINDOW else 0
        if put + len(new) > WINDOW:  # mostly whole in the window, sometimes cut
            skip = max(0, put - int(r.integers(-len(new) // 2, max(1, WINDOW - len(new)))))
        add(whole[skip : skip + WINDOW], [(a - skip, x, b - skip) for a, x, b in labelled])
    return np.array(ids, dtype=np.int64).reshape(-1, WINDOW), np.array(tags, dtype=np.int64).reshape(-1, WINDOW)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_texts: int = SAMPLE_TEXTS, steps: int = STEPS) -> Tagger | None:
    """A network from at most ``sample_texts`` texts of less than SAMPLE_CHARS characters each; None if there is no such text."""
    rough = r"@[A-Za-z0-9-]+\.|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]|[0-9][ -]?[0-9 -]{12,}|\+[0-9]"
    rows = pick(docs, doc_id=id_col, text=text_col).where("text <> ''").where(F.length("text") < SAMPLE_CHARS).select("text", (~F.col("text").rlike(rough)).alias("plain"), F.xxhash64("doc_id", "text").alias("h"))
    # The smallest hashes first, then the texts that have them: no task sends more texts than are taken.
    hashes = rows.select("plain", "h").distinct().orderBy("plain", "h").limit(sample_texts).select("h")
    texts = rows.join(F.broadcast(hashes), "h").dropDuplicates(["h"]).select("h", "text")  # at most sample_texts

    # One task learns from the whole sample: a worker has one core and one thread, which is what matrices this small want.
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((h, text) for b in batches for h, text in zip(*(c.to_pylist() for c in b.columns), strict=True))
        ids, tags = training_windows([text for _, text in found])
        if len(ids):
            net = Tagger(1 + 2 * len(KINDS), HIDDEN)
            net.fit(ids, tags, max(1, steps * BATCH // max(BATCH, len(ids))), BATCH)
            yield pa.RecordBatch.from_arrays([pa.array(list(net.p)), pa.array([v.tobytes() for v in net.p.values()], pa.binary())], names=["name", "weights"])

    bounded_batches(docs.sparkSession)
    weights = {r["name"]: r["weights"] for r in texts.coalesce(1).mapInArrow(fit, "name string, weights binary").collect()}
    if not weights:
        return None
    net = Tagger(1 + 2 * len(KINDS), HIDDEN)
    net.p = {k: np.frombuffer(weights[k], np.float32).reshape(v.shape) for k, v in net.p.items()}
    return net


def _windows(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(text, place) of the windows to read: the two that hold each trigger."""
    for i, text in enumerate(texts):
        last = -1
        for m in _TRIGGER.finditer(text):
            block = m.start() // STRIDE
            for b in range(max(last + 1, block - 1, 0), block + 1):
                yield i, b * STRIDE
            last = max(last, block)


def decoded(net: Tagger, texts: list[str], base: list[list[tuple[int, str, int]]]) -> list[list[tuple[int, str, int]]]:
    """For each text the spans that the network adds to its base spans. No more than DECODE windows are held at once."""
    spans: list[list[tuple]] = [[] for _ in texts]
    windows = _windows(texts)
    while places := list(islice(windows, DECODE)):
        codes = np.full((len(places), WINDOW), CLASSES - 1, dtype=np.int64)
        for row, (i, at) in enumerate(places):
            part = texts[i][at : at + WINDOW]
            codes[row, : len(part)] = encode(part)
        tags = net.decode(codes)
        found = np.flatnonzero(tags.any(axis=1))
        sure = net.confidence(codes[found], tags[found])
        for row, own in zip(found.tolist(), sure, strict=True):
            (i, at), t = places[row], tags[row]
            starts = np.flatnonzero((t > 0) & ((t % 2 == 1) | (np.concatenate([[0], t[:-1]]) == 0)))
            for s in starts.tolist():
                kind = (int(t[s]) - 1) // 2
                e = s + 1
                while e < WINDOW and t[e] == 2 + 2 * kind:
                    e += 1
                e = min(e, len(texts[i]) - at)
                cut = s == 0 and at > 0 or e == WINDOW and at + e < len(texts[i])
                spans[i].append((cut, s - e, at + s, kind, at + e, float(own[s:e].min(initial=1.0))))
    out = []
    for text, found, own in zip(texts, spans, base, strict=True):
        taken, new = [(a, b) for a, _, b in own], []
        for cut, _, a, kind, b, p in sorted(set(found)):
            while a < b and text[a] in " \t\r\n":
                a += 1
            while a < b and text[b - 1] in " \t\r\n.,;:":
                b -= 1
            if a < b and not cut and p >= SURE and numbers_fit(KINDS[kind], text[a:b]) and all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                new.append((a, KINDS[kind], b))
        out.append(sorted(new))
    return out


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def find(docs: DataFrame, net: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans.

    Counts and base_sha256 are of the patterns' spans; ``spans`` also has the ``n_added`` that the network adds (all as
    kind:start:end in code points), ``n_spans`` counts all. Very long texts are read in windows like any other, a bounded number at
    once. Null and empty texts have no spans. Rows that repeat have equal results; null ids stay
    null; an empty table gives an empty table; other columns are ignored. Without a network nothing is added.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            base = [patterns(x) for x in texts]
            added = decoded(net, texts, base) if net else [[] for _ in texts]
            counts = [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]
            cols = [b.column(0), *counts, pa.array(digests, pa.string()), pa.array([_joined(x + y) for x, y in zip(base, added, strict=True)], pa.string()), pa.array([len(x) for x in added], pa.int64()), pa.array([len(x) + len(y) for x, y in zip(base, added, strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
