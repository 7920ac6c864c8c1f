"""Suffix-array dedup and near-dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spinewright.llm import components, neardup, suffixdedup

DOCS = "doc_id bigint, text string"


def repeats(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        runs = sum(bool(m) and (i == 0 or not mark[i - 1]) for i, m in enumerate(mark))
        out.append((len(t), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(t, mark) if not m)).hexdigest()))
    return out


def pool_texts(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("ab é") for _ in range(n))
    pool = [word(r.randint(50, 200)) for _ in range(12)]
    texts = ["".join(r.choice(pool) if r.random() < 0.8 else word(r.randint(1, 50)) for _ in range(r.randint(0, 8))) for _ in range(60)]
    return [*texts, "x" * 300, "x" * 95, "xyz" * 100, "", None, texts[3], texts[3] + "q"]


@pytest.mark.parametrize("max_group", [10**6, 2])
def test_repeats_equal_brute_force(spark, max_group):
    texts = pool_texts(max_group)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = suffixdedup.find_repeats(df, 100, max_group=max_group).toPandas().sort_values("doc_id")
    assert [tuple(x) for x in got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].values.tolist()] == repeats(texts, 100)


def test_repeats_with_null_ids_repeated_rows_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a" * 450, 1, 2), (1, "a" * 450, 1, 2), (None, "b" * 20, 1, None), (2, None, 3, 4)], DOCS + ", n_bytes int, uid int")
    rows = sorted(suffixdedup.find_repeats(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in rows] == [(1, 450, 450, 1), (1, 450, 450, 1), (2, 0, 0, 0), (None, 20, 0, 0)]
    assert suffixdedup.find_repeats(df.where("false")).count() == 0


def test_remove_repeats_keeps_columns_and_whole_characters(spark):
    shared = "é" * 250
    df = spark.createDataFrame([(1, "one " + shared + " end", "x"), (2, "two " + shared + " fin", "y"), (3, None, None)], DOCS + ", place string")
    got = {r.doc_id: r for r in suffixdedup.remove_repeats(df).collect()}
    kept = {k: got[k].text for k in (1, 2)}
    assert all(len(x) < 20 and x.startswith(w) and x.endswith(e) for x, w, e in ((kept[1], "one", "end"), (kept[2], "two", "fin"))) and got[3].text is None
    assert (got[1].place, got[3].n_removed) == ("x", 0)


def without_passages(texts, length, words):
    """What is left without strings of so many bytes that also start elsewhere and words in a row that another text has too."""
    seen, where = Counter(), {}
    for k, t in enumerate(texts):
        raw, w = (t or "").encode(), (t or "").encode().split()
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
        for i in range(len(w) - words + 1):
            where.setdefault(tuple(w[i : i + words]), set()).add(k)
    out = []
    for t in texts:
        raw = (t or "").encode()
        mark, w = bytearray(len(raw)), [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        for i in range(len(w) - words + 1):
            if len(where[tuple(x[2] for x in w[i : i + words])]) > 1:
                a, b = w[i][0], w[i + words - 1][1]
                mark[a:b] = b"\1" * (b - a)
        out.append((sum(mark), bytes(x for x, m in zip(raw, mark) if not m).decode(errors="ignore")))
    return out


@pytest.mark.parametrize("words", [51, 5])
def test_passages_of_words_equal_brute_force(spark, words):
    """Passages of fewer words, as many and more, set with other white space, once or more in a text, of one word over and over, or whole texts."""
    r = random.Random(words)
    own = lambda n: ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(n)]
    pool = [own(n) for n in (words - 1, words, words, words + 1, 2 * words, 3 * words)] + [["so"] * (2 * words)]
    texts = []
    for _ in range(60):
        parts = [w for _ in range(r.randint(0, 3)) for w in (own(r.randint(0, 30)), r.choice(pool)[r.choice((0, 0, 1)) :])]
        texts.append("".join(x + r.choice((" ", " ", "\n", " \t", "\u00a0" if r.random() < 0.01 else " ")) for p in parts for x in p))
    texts += [None, "", " \n", " ".join(own(words)), " ".join(pool[1]), " ".join(pool[1]), "once " * (3 * words)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = suffixdedup.remove_repeats(df, words=words).orderBy("doc_id").collect()
    assert [(r.n_removed, r.text or "") for r in got] == without_passages(texts, 400, words)
    assert [r.text is None for r in got] == [t is None for t in texts] and suffixdedup.remove_repeats(df.where("false"), words=words).count() == 0


def test_mergesort_orders_suffixes():
    r = random.Random(4)
    strings = ["".join(r.choice("ab") for _ in range(r.randint(0, 9))).encode() for _ in range(500)]
    group = np.sort(np.array([r.randint(0, 3) for _ in strings]))
    s = suffixdedup.Suffixes(pa.array(strings, pa.binary()), group, 9)
    order = s.order()
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group, strings))
    n = s.extensions(order)
    for k in range(1, 500):
        a, b = strings[order[k - 1]], strings[order[k]]
        same = 0 if group[order[k]] != group[order[k - 1]] else next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n[k] == same


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_texts():
    r = random.Random(7)
    texts = []
    for _ in range(12):
        base = [r.choice("abcdefghijklmnop") * r.randint(1, 4) for _ in range(r.randint(6, 120))]
        for _ in range(r.randint(1, 9)):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = f"z{r.randint(0, 99)}"
            texts.append(r.choice([" ", "\n", "  "]).join(own))
    return [*texts, "", None, " \t", "Lone", "lone", "two words", texts[0].upper()]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts()
    sets = [shingles(t, 4) for t in texts]
    leader = list(range(len(texts)))
    find = lambda i: i if leader[i] == i else find(leader[i])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                leader[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], DOCS + ", component int")
    got = neardup.near_duplicates(df, words=4).toPandas().sort_values("doc_id")
    assert got["n_shingles"].tolist() == [len(s) for s in sets]
    assert got["component_id"].tolist() == [find(i) for i in range(len(texts))]
    assert got.loc[got["leader"], "doc_id"].is_unique and got["leader"].sum() == got["component_id"].nunique()


def star(r, copies, at, name):
    """Copies of an original that are linked with it (0.82) but hardly with each other, the original in place at."""
    base = [f"{name}{r.randint(0, 10**9)}" for _ in range(200)]
    texts = []
    for k in range(copies):
        own, first = list(base), r.randrange(38)
        for j in range(5):
            own[first + 39 * j if first + 39 * j > 3 else 4] = f"{name}{k}own{j}"
        texts.append(" ".join(own))
    return [*texts[:at], " ".join(base), *texts[at:]]


def test_stars_with_their_original_anywhere_equal_brute_force(spark):
    r = random.Random(5)
    texts = [*star(r, 600, 300, "m"), *star(r, 300, 300, "e"), *star(r, 40, 20, "s")]
    sets = [shingles(t, 4) for t in texts]
    leader = list(range(len(texts)))
    find = lambda i: i if leader[i] == i else find(leader[i])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                leader[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = neardup.near_duplicates(df, words=4).toPandas().sort_values("doc_id")
    assert got["component_id"].tolist() == [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("small", [0, 32])
def test_the_exact_join_meets_all_links_without_the_forest(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    texts = [t for t in dict.fromkeys(near_texts()) if shingles(t, 4)]
    raw = [t.encode() for t in texts]
    store = neardup.StoreWriter(f"file://{tmp_path}")
    places = [store.add(t) for t in raw]
    store.close()
    sets, bounds = neardup.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw])), 4)
    read = [pa.RecordBatch.from_arrays([pa.array(range(len(raw))), pa.array(range(len(raw))), pa.array(places)], names=["node", "component", "place"])]
    rows = pa.Table.from_batches(neardup.Prefixer(4, 80, f"file://{tmp_path}", np.zeros(1 << neardup.COUNTED_BITS, np.uint8))(iter(read))).sort_by("shingle")
    met = {tuple(sorted(x.values())) for b in neardup.Meeting(80)(iter(rows.to_batches(7))) for x in b.to_pylist()}
    known = [set(sets[bounds[k] : bounds[k + 1]].tolist()) for k in range(len(raw))]
    linked = {(j, i) for i, a in enumerate(known) for j, b in enumerate(known[:i]) if 100 * len(a & b) >= 80 * len(a | b)}
    assert linked and linked <= met
    odd = neardup.parities(sets, bounds)
    for i, j in met:
        assert np.bitwise_count(odd[i] ^ odd[j]).sum() <= len(known[i] ^ known[j])


def test_near_duplicates_of_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None)], DOCS)
    rows = neardup.near_duplicates(df).collect()
    assert [r.component_id for r in rows if r.n_shingles] == [5, 5, 5] and sum(r.leader for r in rows) == 2
    kept = neardup.drop_near_duplicates(df.selectExpr("*", "1 AS own_uid", "'t' AS place")).collect()
    assert len(kept) == 2 and {r.text for r in kept} == {"a b c d e f", None} and kept[0].place == "t"
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (4, 4), *((k, k + 1) for k in range(20, 40))]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 4: 4} | {k: 20 for k in range(20, 41)}
