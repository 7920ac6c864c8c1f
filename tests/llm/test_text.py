"""Token counts, packing, decontamination, language ID, quality rules and LM scores."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spinewright.llm import decontaminate, langid, lmscore, packing, quality, tokens
from spinewright.llm import textkernel as K

DOCS = "doc_id bigint, text string"
ODD = ["", " ", "  a  b ", "▁a ▁b", "a\tb\nc", "<s>x</s> <unk>", "　é　ﬁ\x00", "<|endoftext|> a<|endoftext|>", "don't we'll I'VE x's's '' 'tis", "漢字かな 123²  \n\n  x", "é 😀", None]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], DOCS + ", n_tokens int, block string")


def odd_texts(n=300):
    r = random.Random(1)
    parts = ["'", "s", "re", "ll", "d", "x", " ", "  ", "\n", "\t", "1", "²", "é", "ß", "　", "!", "'ve", "漢", "\x1c", "\x85", "’", "▁"]
    return ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path, texts = tokens.public_tokenizer("piece_bpe_32k.model"), odd_texts()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = tokens.count_tokens(frame(spark, texts), path).toPandas().sort_values("doc_id")
    assert got["n_tokens"].tolist() == [len(model.encode(t or "")) for t in texts]
    assert got["n_bytes"].tolist() == [len((t or "").encode()) for t in texts]
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], DOCS)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in tokens.count_tokens(twice, path).collect()) == [(0, 1), (1, 2), (1, 2)]
    assert tokens.count_tokens(twice.where("false"), path).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path, texts = packing.public_tokenizer("byte_bpe_50k.json"), [*odd_texts(), "word " * 3000]
    library = Tokenizer.from_file(path)
    rows = packing.pack(frame(spark, texts), path).toPandas().sort_values(["doc_id", "start"])
    assert rows["sequence_id"].is_unique and (rows["offset"] == 0).all()
    for i, pieces in rows.groupby("doc_id"):
        want = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        assert [x for ids in pieces["ids"] for x in ids] == want
        assert pieces["start"].tolist() == [0, *np.cumsum(pieces["length"])[:-1]] and set(pieces["doc_tokens"]) == {len(want)}
        for p in pieces.itertuples():
            assert p.length <= 1024 and p.length & (p.length - 1) == 0
            assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    assert packing.pack(frame(spark, texts).where("false"), path).count() == 0


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize("window", [3, 10])
def test_contamination_equals_brute_force(spark, window):
    r = random.Random(window)
    voc = ["x", "y", "zé", "Q1", "w"]
    text = lambda n: " ".join(r.choice(voc) for _ in range(n))
    docs = [text(r.randint(0, 60)) for _ in range(150)] + [None, "", "...", "x"]
    items = [text(r.choice([0, 1, 2, 3, 5, 12])) for _ in range(12)] + [None, "", docs[3], docs[5] + " tail"]
    ids = list(range(len(items)))
    got = decontaminate.find_contamination(frame(spark, docs), spark.createDataFrame(list(zip(ids, items)), "item_id bigint, text string"), window).toPandas().sort_values("doc_id")
    for d, row in zip(docs, got.itertuples()):
        w, hit, found = words(d), set(), set()
        for i, item in zip(ids, items):
            v = words(item)
            n = min(window, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(i))
        runs = [(-m, k) for i, item in zip(ids, items) for v in [words(item)] if v for k in range(len(w)) for j in range(len(v)) for m in [next((x for x in range(min(len(w) - k, len(v) - j)) if w[k + x] != v[j + x]), min(len(w) - k, len(v) - j))] if m >= min(window, len(v))]
        best = min(runs, default=None)
        assert (row.longest, None if row.longest == 0 else row.longest_at) == ((-best[0], best[1]) if best else (0, None))
        assert (row.n_words, row.n_hit, row.items_sha256) == (len(w), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    clean = decontaminate.drop_contaminated(frame(spark, docs), spark.createDataFrame(list(zip(ids, items)), "item_id bigint, text string"), window)
    assert {r.doc_id for r in clean.collect()} == set(got.loc[got["n_hit"] == 0, "doc_id"])


def test_chunks_of_the_benchmark_add_up(spark):
    docs, tests = frame(spark, ["a b c d", "c d e", "z"]), spark.createDataFrame([(1, "a b"), (2, "d e"), (2, "d e"), (None, "z")], "item_id bigint, text string")
    whole = decontaminate.find_contamination(docs, tests, 2).orderBy("doc_id").collect()
    assert decontaminate.find_contamination(docs, tests, 2, chunk_bytes=3).orderBy("doc_id").collect() == whole
    assert [(r.n_hit, r["items"]) for r in whole] == [(2, ["1"]), (2, ["2"]), (1, [])]
    assert decontaminate.find_contamination(docs, tests.where("false")).where("n_hit > 0").count() == 0


def test_longest_matches(spark):
    docs, tests = frame(spark, ["q a b c d e q", "b c d"]), spark.createDataFrame([(7, "z a b c d e f")], "item_id bigint, text string")
    got = sorted((r.doc_id, r.test_id, r.word, r.test_word, r.length) for r in decontaminate.find_matches(docs, tests, 3).collect())
    assert got == [(0, "7", 1, 1, 5), (1, "7", 0, 2, 3)]


def test_language_id(spark, sf):
    assert {r.lang_pred for r in langid.identify(frame(spark, ["", None, "123 !", "text"]), []).collect()} == {"und"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = langid._fold(docs.doc_id)
    learned = langid.learn(docs.where(fold != 0))
    assert len(learned) == 4 and all(len(d) <= 2 * langid.SNIPPETS * (langid.SNIPPET_CHARS + 1) for _, d in learned)
    got = langid.identify(docs.where(fold == 0), learned).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() >= 0.94 and got["score"].between(0, 1).all()
    sure = got[~got["rejected"]]
    assert (sure["lang"] == sure["lang_pred"]).mean() >= 0.98


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup, mark = set(), 0, set()
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:]))
    for i in range(len(w) - 2):
        if c[w[i], w[i + 1], w[i + 2]] > 1:
            mark |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(mark)


def test_quality_counts_equal_brute_force():
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "b", "é", "#", "<", " ", "\n", "\t", "\x0b", " ", "漢", "A"]) for _ in range(r.randint(0, 60))) for _ in range(800)] + ["", None, ""]
    data, off = K.column_bytes(pa.array(texts))
    for d, e in K.runs(off, 3000):
        c = quality.text_counts(data[off[d] : off[e]], off[d : e + 1] - off[d])
        for i in range(e - d):
            assert tuple(int(c[k][i]) for k in quality.COUNTS[:5]) == counts(texts[d + i])


def test_rules_are_learned_and_become_columns(spark):
    r = np.random.default_rng(3)
    n = 3000
    x = {f: r.random(n) for f in quality.FEATURES}
    bad = ((x["symbol_share"] > 0.8) & (x["word_length"] < 0.5)) | (x["upper_share"] > 0.9)
    rules = quality.learn_rules(x, bad, np.arange(n) % 3 != 2)
    covered = np.any([k.covers(x, n) for k in rules], axis=0)
    assert (covered == bad).mean() > 0.99
    docs = frame(spark, ["good words " * 40 + " ".join(f"w{i}" for i in range(90)), "x", None, ""])
    rule = quality.Rule([("n_words", False, 10.0), ("distinct_share", True, 0.2)])
    got = {g.doc_id: g for g in quality.judge(docs, [rule]).collect()}
    assert got[0].kept and got[0].n_distinct_words == 92 and quality.verdict([rule]) is not None
    twice = quality.judge(docs.union(docs), [quality.Rule([("n_words", False, 10.0), ("distinct_share", True, 0.6)])]).where("doc_id = 0").collect()
    assert [(g.rule, g.kept, g.base_failed) for g in twice] == [(0, False, False)] * 2
    assert not any(got[k].kept for k in (1, 2, 3)) and quality.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int")) == []
    assert quality.keep_good(docs, []).columns == docs.columns


def test_lm_scores_equal_brute_force(spark):
    texts, target = ["the cat sat", "the dog sat", "xx yy", "", None, "the cat é", "the cat sat"], {0, 5}
    order, strength = lmscore.ORDER, lmscore.STRENGTH
    grams = lambda t: [x[i : i + order] for x in [b"\0" * (order - 1) + (t or "").encode()] for i in range(len(x) - order + 1)]
    n = [Counter(g for i, t in enumerate(texts) if k == 0 or i in target for g in grams(t)) for k in (0, 1)]
    single = [np.array([sum(c for g, c in m.items() if g[-1] == b) for b in range(256)]) for m in n]
    scale = [single[1].sum() / single[0].sum(), 1]
    p = [(s + 1) / (s.sum() + 256) for s in single]
    context = [Counter() for _ in n]
    for k in (0, 1):
        for g, c in n[k].items():
            context[k][g[:-1]] += c
    log = lambda k, g: math.log((n[k][g] * scale[k] + strength * p[k][g[-1]]) / (context[k][g[:-1]] * scale[k] + strength))
    want = [np.mean([log(0, g) - log(1, g) for g in grams(t)]) if t else 0.0 for t in texts]
    ids = spark.createDataFrame([(0,), (5,), (5,), (None,)], "doc_id bigint")
    got = lmscore.score_documents(frame(spark, texts), ids).toPandas().sort_values("doc_id")
    assert np.allclose(got["score"], want, atol=1e-6) and got["n_tokens"].tolist() == [len((t or "").encode()) for t in texts]
    assert lmscore.score_documents(frame(spark, texts), ids.where("false")).count() == len(texts)
