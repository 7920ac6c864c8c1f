"""Strings made to collide, hot groups, long texts and ties, against brute force and the libraries."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from spinewright.llm import decontaminate, langid, lmscore, neardup, packing, quality, suffixdedup, tokens
from spinewright.llm import textkernel as K

DOCS = "doc_id bigint, text string"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def thue_morse(n):
    """A string of n letters and its complement, which collide under polynomials modulo 2**64."""
    bits = np.bitwise_count(np.arange(n, dtype=np.uint64)) & 1
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


SIZES = (1024, 65536)


@pytest.mark.parametrize("n", SIZES)
def test_colliding_words_are_told_apart(spark, n):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    x, y = thue_morse(n)
    h = K.prefix_hash(np.frombuffer((x + y).encode(), np.uint8))
    assert len(set(K.segment_hash(h, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 1  # the polynomial does collide
    texts = [f"{x}\n{y}", x, y, f"p q r s {x}", f"p q r s {y}"]
    docs = frame(spark, texts)
    data, off = K.column_bytes(pa.array(texts))
    c = quality.text_counts(data, off)
    assert (c["n_dup_lines"][0], c["n_distinct_words"][0]) == (0, 2)
    near = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=4, percent=10).collect()}
    assert near == {k: k for k in range(5)} | {4: 3} or near == {k: k for k in range(5)}
    assert near[1] != near[2]
    items = spark.createDataFrame([(1, x)], "item_id bigint, text string")
    assert [r.n_hit for r in decontaminate.find_contamination(docs, items).orderBy("doc_id").collect()] == [1, 1, 0, 1, 0]
    model = SentencePieceProcessor(model_file=tokens.public_tokenizer("piece_bpe_32k.model"))
    got = tokens.count_tokens(docs, tokens.public_tokenizer("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(model.encode(t)) for t in texts]
    path = packing.public_tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).orderBy("doc_id", "start").collect()
    for k, t in enumerate(texts):
        assert [i for r in rows if r.doc_id == k for i in r.ids] == [*library.encode(t, add_special_tokens=False).ids, 0]


def test_colliding_suffixes_are_sorted_by_their_bytes():
    x, y = thue_morse(1024)
    strings = [s.encode() for s in (y + "c", x + "c", x + "a", y + "a", x + "b", y + "b", x, y)]
    s = suffixdedup.Suffixes(pa.array(strings, pa.binary()), np.zeros(len(strings), np.int64), 1025)
    order, common = s.checked()
    assert [strings[k] for k in order] == sorted(strings)
    assert common.tolist()[1:] == [next((i for i, (p, q) in enumerate(zip(strings[a], strings[b])) if p != q), min(len(strings[a]), len(strings[b]))) for a, b in zip(order, order[1:])]


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


def found(df):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize("max_group", [suffixdedup.MAX_GROUP, 50, 2])
def test_a_passage_in_very_many_places(spark, max_group):
    """Passages of less and of more than 400 bytes, in more suffixes than a group may have, whole or with shared neighbours."""
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    short, long, tails = word(250), word(500), [word(200) for _ in range(3)]
    n = 4200 if max_group == suffixdedup.MAX_GROUP else 150
    texts = [word(r.randint(100, 200)) + r.choice((short, short, short + r.choice(tails), long, r.choice(tails) + short)) + word(r.randint(100, 200)) for _ in range(n)]
    texts += [texts[0], texts[0], None, "", word(399), long[:400]]
    assert found(suffixdedup.find_repeats(frame(spark, texts), max_group=max_group)) == repeats(texts, 400)


def test_repeats_at_400_bytes_within_long_texts(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    passage, edge = word(450), word(420)
    long = word(300_000) + passage + word(400_000) + passage[10:440] + word(500_000)
    cut = long.encode()[: suffixdedup.SLICE - 200].decode(errors="ignore")
    texts = [long, cut + edge + word(10), word(50) + edge, "x" * 1500, passage[:300], None]
    assert found(suffixdedup.find_repeats(frame(spark, texts))) == repeats(texts, 400)


def sets_of(texts, n=4):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
    return out


@pytest.mark.parametrize("partitions", [4, 8, 211])
def test_links_in_a_crowd(spark, partitions):
    """Documents that share most words, too few for a link, and planted copies that have just enough."""
    r = random.Random(3)
    common = [f"c{k}" for k in range(90)]
    crowd = []
    for k in range(700):
        own = list(common)
        for j in range(15):
            own.insert(r.randrange(len(own)), f"o{k}x{j}")
        crowd.append(own)
    copies = []
    for k in range(60):
        own = list(crowd[k * 11])
        for j, at in enumerate(r.sample(range(len(own)), 2)):
            own[at] = f"p{k}x{j}"
        copies.append(own)
    texts = [" ".join(x) for x in crowd + copies]
    r.shuffle(texts)
    sets = sets_of(texts)
    leader = list(range(len(texts)))
    find = lambda i: i if leader[i] == i else find(leader[i])
    links = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                links += 1
                x, y = find(i), find(j)
                leader[max(x, y)] = min(x, y)
    assert links > 30
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = neardup.near_duplicates(frame(spark, texts).repartition(5), words=4).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [g.component_id for g in got] == [find(i) for i in range(len(texts))]


def test_neighbours_go_on_over_batches(spark, monkeypatch):
    """The same candidates, however the sorted rows are cut into batches."""
    monkeypatch.setattr(neardup.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    r = random.Random(4)
    rows = sorted((r.randint(0, 2), np.array([r.randint(0, 1) for _ in range(neardup.DEPTH)], ">u4").tobytes(), k) for k in range(300))
    table = pa.table({"tree": pa.array([x[0] for x in rows], pa.int32()), "prefix": pa.array([x[1] for x in rows], pa.binary()), "node": [x[2] for x in rows], "component": [x[2] // 2 for x in rows]})
    out = []
    for size in (1000, 7, 1):
        parts = [b for b in neardup._neighbours(iter(table.to_batches(size)))]
        got = [x for b in parts for x in b.to_pylist()]
        out.append((sorted({(x["a"], x["b"]) for x in got if x["last"] is None}), [(x["a"], x["last"]) for x in got if x["last"] is not None]))
    assert out[0] == out[1] == out[2] and len(out[0][0]) > 300


def test_language_id_equals_brute_force(spark):
    r = random.Random(5)
    voc = {"x": "alpha beta gamma delta", "y": "uno dos tres cuatro", "z": "aa bb cc dd"}
    rows = [(i, " ".join(r.choices(voc[k].split(), k=r.randint(1, 400))), k) for i, k in enumerate(r.choices("xxyz", k=80))] + [(900, None, "x"), (901, "", "y"), (902, "12 34", "z"), (903, "é", None), (904, "alpha " * 30_000, None)]
    docs = spark.createDataFrame([*rows, rows[0]], DOCS + ", lang string")
    learned = langid.learn(docs.where("doc_id % 5 <> 0"))
    tools = []
    for _, raw in learned:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tools.append(zstandard.ZstdCompressor(level=1, dict_data=d, write_content_size=False, write_checksum=False))
    got = {(g.doc_id, g.lang_pred, round(g.score, 9)) for g in langid.identify(docs, learned).collect()}
    want = set()
    for i, t, _ in rows:
        raw = (t or "").encode()
        if not any(c.isalpha() for c in t or ""):
            want.add((i, "und", 0.0))
            continue
        sizes = sorted((sum(len(tool.compress(raw[s : s + langid.CHUNK])) for s in range(0, len(raw), langid.CHUNK)), k) for k, tool in enumerate(tools))
        want.add((i, learned[sizes[0][1]][0], round((sizes[1][0] - sizes[0][0]) / sizes[1][0], 9)))
    assert got == want
    # A tie goes to the more frequent language, and nothing learned is nothing known.
    assert {g.lang_pred for g in langid.identify(docs.where("doc_id = 0"), [("p", learned[0][1]), ("q", learned[0][1])]).collect()} == {"p"}
    assert langid.learn(docs.where("false")) == [] and langid.identify(docs.where("false"), learned).count() == 0


def test_equal_gains_and_repeated_rows_give_one_list():
    x = {f: np.zeros(60) for f in quality.FEATURES}
    x["upper_share"] = x["digit_share"] = np.repeat([0.0, 1.0], 30)
    bad, fold = np.repeat([False, True], 30), np.arange(60) % 3 != 2
    once = quality.learn_rules(x, bad, fold)
    assert [str(k) for k in once] == ["upper_share >= 0.5"]
    twice = quality.learn_rules({k: np.tile(v, 2) for k, v in x.items()}, np.tile(bad, 2), np.tile(fold, 2))
    assert [str(k) for k in twice] == [str(k) for k in once]


def test_long_texts_beyond_a_run(spark):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    r = random.Random(6)
    long = " ".join(f"w{r.randint(0, 5000)}" for _ in range(500_000))
    assert len(long) > 4 * K.RUN_BYTES
    w = long.split(" ")
    texts = [long, " ".join(w[300_000:300_030]), None, long.replace("w1 ", "v1 ")]
    docs = frame(spark, texts)
    model = SentencePieceProcessor(model_file=tokens.public_tokenizer("piece_bpe_32k.model"))
    got = tokens.count_tokens(docs, tokens.public_tokenizer("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [g.n_tokens for g in got] == [len(model.encode(t or "")) for t in texts]
    path = packing.public_tokenizer("byte_bpe_50k.json")
    rows = packing.pack(docs.where("doc_id = 0"), path).orderBy("start").collect()
    assert [i for g in rows for i in g.ids] == [*Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids, 0]
    items = spark.createDataFrame([(1, texts[1]), (2, " ".join(w[:12])), (3, " ".join(w[-10:])), (4, " ".join(w[262_140:262_160]))], "item_id bigint, text string")
    hit = decontaminate.find_contamination(docs, items).orderBy("doc_id").collect()
    assert [(h.n_words, h["items"]) for h in hit[:3]] == [(500_000, ["1", "2", "3", "4"]), (30, ["1"]), (0, [])] and hit[0].n_hit == 72
    assert (hit[0].longest, hit[0].longest_at, hit[0].longest_item) == (30, 300_000, "1") and hit[2].longest == 0
    near = {g.doc_id: (g.component_id, g.n_shingles) for g in neardup.near_duplicates(docs).collect()}
    assert near[0] == (0, len(sets_of([long], 5)[0])) and near[3][0] == 0 and near[2] == (2, 0)
    c = quality.judge(docs, []).orderBy("doc_id").first()
    assert (c.n_words, c.n_distinct_words, c.word_chars) == (len(w), len(set(w)), len(long) - len(w) + 1)
    scores = lmscore.score_documents(docs, spark.createDataFrame([(0,)], "doc_id bigint")).orderBy("doc_id").collect()
    assert [s.n_tokens for s in scores] == [len(t or "") for t in texts] and scores[2].score == 0
    assert {p.lang_pred for p in langid.identify(docs, [("p", b"w1 w2 w3"), ("q", b"zzz")]).collect()} <= {"p", "q", "und"}


def test_a_bucket_above_its_bounds_gives_the_same(spark, monkeypatch):
    texts = [f"word{k} other{k % 7} x" for k in range(300)]
    path = tokens.public_tokenizer("piece_bpe_32k.model")
    model = __import__("sentencepiece").SentencePieceProcessor(model_file=path)
    held = [pa.array([t.encode() for t in texts[k : k + 40]], pa.large_binary()) for k in range(0, 300, 40)]
    monkeypatch.setattr(tokens, "KEEP_PRETOKENS", 10)
    monkeypatch.setattr(tokens, "AT_ONCE", 500)
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([0] * 5 + [1] * 3, pa.int32()), pa.array([tokens._pack(h) for h in held], pa.binary())], names=["block", "bucket", "packed"])
    got = [tokens.unsqueeze(p).tolist() for b in tokens.PieceCounter(path)(iter([batch.slice(0, 3), batch.slice(3)])) for p in b.column(2).to_pylist()]
    assert got == [[len(model.encode(t.as_py().decode())) for t in h] for h in held]
    docs, ids = frame(spark, texts), spark.createDataFrame([(0,), (9,)], "doc_id bigint")
    whole = lmscore.score_documents(docs, ids).orderBy("doc_id").collect()
    # More buckets than partitions, a few contexts each.
    monkeypatch.setattr(lmscore, "BUCKET_BYTES", 50)
    parts = lmscore.score_documents(docs, ids).orderBy("doc_id").collect()
    assert parts == whole
    monkeypatch.setattr(lmscore, "WAITING", 10)
    monkeypatch.setattr(lmscore, "SOLVED_ROW", 50)
    grams = [np.unique(np.random.default_rng(k).integers(0, 500, 60).astype(np.uint64)) for k in range(6)]
    one = np.ones(512).reshape(2, 256)
    rows = pa.RecordBatch.from_arrays([pa.array([0] * 6, pa.int32()), pa.array([lmscore._split(g) for g in grams], pa.binary()), *(pa.array([tokens.squeeze(np.ones(len(g), np.int64)) for g in grams], pa.binary()) for _ in range(2))], names=["bucket", "grams", "background", "target"])
    out = list(lmscore.Sums(one, 5.0)(iter([rows.slice(0, 2), rows.slice(2)])))
    u, n = np.unique(np.concatenate(grams), return_counts=True)
    assert len(out) > 1 and np.array_equal(np.concatenate([lmscore._join(b.column(1)[0].as_py()) for b in out]), u)
    assert np.allclose(np.concatenate([np.frombuffer(b.column(2)[0].as_py(), np.float32) for b in out]), lmscore.gram_losses(u, n, n, one, 5.0))
    known = [{"bucket": 0, "block": None, "grams": b.column(1)[0].as_py(), "losses": b.column(2)[0].as_py()} for b in out]
    asked = pa.RecordBatch.from_pylist([*known, {"bucket": 0, "block": 3, "grams": lmscore._split(u[5:9]), "losses": None}], schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("losses", pa.binary())]))
    answer = list(lmscore.Answers()(iter([asked.slice(0, 1), asked.slice(1)])))
    assert len(answer) == 1 and np.allclose(np.frombuffer(answer[0].column(2)[0].as_py(), np.float32), lmscore.gram_losses(u, n, n, one, 5.0)[5:9]) and len(whole) == 300


def test_buckets_are_written_by_length(spark, tmp_path):
    packed = packing.pack(frame(spark, ["word " * 700, "a", None]), packing.public_tokenizer("byte_bpe_50k.json"))
    packing.write_buckets(packed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == packed.count() and back.where("bucket <> length").count() == 0


def test_matches_of_repeated_words_take_no_pairs(spark):
    from spinewright.llm import decontaminate as D

    docs = spark.createDataFrame([(1, "a " * 200_000), (2, "a b " * 3000), (3, "x " + "a " * 12)], "doc_id bigint, text string")
    items = spark.createDataFrame([("i", "a " * 20_000), ("j", "a b " * 40), ("k", "a")], "item_id string, text string")
    got = {r.doc_id: (r.longest, r.longest_at) for r in D.find_contamination(docs, items).collect()}
    assert got == {1: (20_000, 0), 2: (80, 0), 3: (12, 1)}


def test_longest_matches_equal_brute_force():
    from spinewright.llm import decontaminate as D

    r = random.Random(4)
    for window in (2, 3, 5):
        texts = [" ".join(r.choice("abc" if k % 2 else "abcdefg") for _ in range(r.randint(0, 60))) for k in range(25)]
        items = [" ".join(r.choice("abc" if k % 2 else "abcdefg") for _ in range(r.randint(0, 25))) for k in range(12)]
        tests = D.Tests([str(k) for k in range(len(items))], items, window)
        words = D.Words(*K.column_bytes(pa.array(texts, pa.large_string())))
        shards = D.Shards(words, window)
        hits = D.Hits(*[shards.occurrences(tests)[k] for k in (2,)], words.bounds, tests, *shards.occurrences(tests)[:2])
        got = {(int(t), int(p), int(n)) for part in hits.longest() for t, p, n in zip(*part)}
        want, best = set(), {}
        for d, text in enumerate(texts):
            w = text.split()
            for i, item in enumerate(items):
                v = item.split()
                for p in range(len(w)):
                    for t in range(len(v)):
                        if p and t and w[p - 1] == v[t - 1]:
                            continue
                        n = 0
                        while p + n < len(w) and t + n < len(v) and w[p + n] == v[t + n]:
                            n += 1
                        if n and n >= min(window, len(v)):
                            want.add((int(tests.bounds[i]) + t, int(words.bounds[d]) + p, n))
                            best[d] = min(best.get(d, (0, 0)), (-n, p))
        assert got == want
        doc, n, p, _ = hits.best()
        assert {int(k): (-int(x), int(y - words.bounds[k])) for k, x, y in zip(doc, n, p)} == best


def test_chunks_and_blocks_change_nothing(spark, monkeypatch):
    """Matches of equal length in items of different chunks, and texts longer than a block."""
    from spinewright.llm import decontaminate as D

    r = random.Random(9)
    words = [f"w{k}" for k in range(9)]
    item = lambda k: " ".join(r.choice(words) for _ in range(14))
    items = [(f"i{k}", item(k)) for k in range(12)]
    texts = [" - ".join([*(items[k][1] for k in order), "end"]) for order in ([3, 1], [1, 3], [11, 0, 5], [7, 7])]
    docs, tests = frame(spark, texts), spark.createDataFrame(items, "item_id string, text string")
    rows = lambda size: sorted(map(repr, D.find_contamination(docs, tests, chunk_bytes=size).drop("longest_item").collect()))
    assert rows(1) == rows(1 << 22)
    long = frame(spark, ["a long text, " * 500, "short", "x" * 9000, None])
    ids = spark.createDataFrame([(1,)], "doc_id bigint")
    scored = lambda: sorted(map(repr, lmscore.score_documents(long, ids).collect()))
    whole = scored()
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 1000)
    assert scored() == whole
