"""Collocations against a brute force, and the bitmaps they are counted by."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from spinewright.llm import collocation

DOCS = "lang string, text string, n bigint, shard string"


def brute(rows, least, longest, top):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    counts[lang, tuple(w[i : i + m])] += 1
    often = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    hidden = set()
    for (lang, p), a in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                sub = lang, p[i : i + m]
                if 100 * a >= 100 * often[sub]:
                    hidden.add(sub)
    found = {}
    for (lang, p), a in often.items():
        if (lang, p) in hidden:
            continue
        n = total[lang]
        cuts = [(1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], n))
    return {(lang, rank, p.decode(), -a, left, right, n, -s) for lang, x in found.items() for rank, (s, a, p, left, right, n) in enumerate(sorted(x)[:top], 1)}


def some_rows(seed, n=120):
    r = random.Random(seed)
    words = ["de", "La", "a", "é", "x1", "ß", "<b>", "the", "漢字", "n't", "DE"]
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "! "]) for _ in range(r.randint(0, 60)))) for _ in range(n)]
    return [*rows, (None, None), ("en", ""), ("fr", "..;\n"), ("en", "one two three four five six " * 40), ("en", "a a a a a a a " * 9), *[("de", "same text again and again")] * 30]


@pytest.mark.parametrize(("seed", "least", "longest", "parts"), [(1, 3, 5, 1), (2, 5, 5, 7), (3, 2, 3, 3), (4, 4, 2, 2)])
def test_collocations_equal_brute_force(spark, monkeypatch, seed, least, longest, parts):
    rows = some_rows(seed)
    docs = spark.createDataFrame([(*x, 1, "?") for x in rows], DOCS).repartition(parts)
    got = collocation.ranked(collocation.collocations(docs, least, longest), 40)
    assert {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()} == brute(rows, least, longest, 40)


def test_no_rows_and_nothing_frequent(spark):
    empty = spark.createDataFrame([], DOCS)
    assert collocation.collocations(empty).count() == 0
    rare = spark.createDataFrame([("en", "a b c", 1, "?"), ("en", None, 1, "?")], DOCS)
    assert collocation.collocations(rare).count() == 0


def test_bitmaps_in_small_steps(monkeypatch):
    line = np.random.default_rng(5).integers(0, 6, 5000)
    want = Counter((a, b) for a, b in zip(line[:-1].tolist(), line[1:].tolist()) if a and b)
    for step in (7, 64, 1 << 18):
        monkeypatch.setattr(collocation, "AT_ONCE", step)
        words, times = collocation.pairs(line)
        assert {tuple(w): t for w, t in zip(words.tolist(), times.tolist())} == want
        frequent = np.sort(np.array([a << 32 | b for a, b in want if (a + b) % 3]))
        got = Counter()
        for w, t in collocation.longer_phrases(line, frequent, 5):
            got.update({tuple(x): n for x, n in zip(w.tolist(), t.tolist())})
        longer = Counter()
        for m in (3, 4, 5):
            for i in range(len(line) - m + 1):
                p = tuple(line[i : i + m].tolist())
                if all(p) and all((a + b) % 3 for a, b in zip(p, p[1:])):
                    longer[p] += 1
        assert got == longer


def test_score_is_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 10**13 + 7, 10**15 + 3, 10**14 + 1, 10**13 + 9
    row = spark.createDataFrame([(a, n, left, right)], "a bigint, n bigint, l bigint, r bigint")
    assert row.select(collocation._cut_score(*map(F.col, "anlr")).alias("s")).first().s == 1000 * a * n // (left * right)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    text = np.frombuffer((b"aa bb cc. dd ee" * 50 + b"\n") * 3, np.uint8)
    monkeypatch.setattr(collocation.K, "RUN_BYTES", 100)
    line, words, times = collocation.positions(text, np.array([0, len(text)]))
    monkeypatch.setattr(collocation.K, "RUN_BYTES", 1 << 19)
    whole = collocation.positions(text, np.array([0, len(text)]))
    named = lambda x: [(b"", *collocation.K.strings(x[1]))[k] for k in x[0].tolist()]
    assert named((line, words)) == named(whole) and times.sum() == whole[2].sum()


def test_a_shard_sends_few_messages_and_a_bucket_adds_few_times(monkeypatch):
    """Messages hang on buckets and lengths, not on how many ranges of bitmaps a shard has; sums are made anew only when they have doubled."""
    import pyarrow as pa

    line = np.random.default_rng(7).integers(0, 9, 4000)
    monkeypatch.setattr(collocation, "AT_ONCE", 16)
    held, packed = collocation._messages(*collocation.pairs(line), 4)
    rows = [(b, np.packbits(np.ones(len(collocation._unpacked(p)[0]), bool)).tobytes(), True) for b, p in zip(held, packed)]
    seats = collocation._squeezed(np.arange(1, 10))
    answers = pa.table({"bucket": [0, *(r[0] for r in rows)], "packed": [seats, *(r[1] for r in rows)], "pairs": [False, *(r[2] for r in rows)]})
    out = collocation._extended(4, 5)(None, pa.table({"line": [collocation._squeezed(line)]}), answers)
    assert len(out) <= 3 * 4
    found = collocation.Sums(5, 1).total([[p] for p in out.column("packed").to_pylist()])
    want = Counter(tuple(line[i : i + m].tolist()) for m in (3, 4, 5) for i in range(len(line) - m + 1) if line[i : i + m].all())
    assert {tuple(x for x in w if x): t for w, t in zip(found[0].tolist(), found[1].tolist())} == want

    monkeypatch.setattr(collocation, "WAITING", 10)
    added, settled = collocation.Added(pa.array([], pa.large_binary())), []
    settle = added.settle
    monkeypatch.setattr(added, "settle", lambda: (settled.append(1), settle()))
    for k in range(1000):
        added.add(pa.array([b"%d" % n for n in range(k, k + 10)], pa.large_binary()), np.ones(10, np.int64))
    settle()
    assert len(added.keys) == 1009 and added.times.sum() == 10_000 and len(settled) < 100
