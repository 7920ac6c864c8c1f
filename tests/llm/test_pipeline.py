"""The pipeline's rows against a brute-force version of all its stages."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from spinewright.llm import quality
from spinewright.llm.shared import written
from spinewright.llm.tokens import public_tokenizer

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(text):
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen, repeated = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[w[i], w[i + 1], w[i + 2]] > 1:
            repeated |= {i, i + 1, i + 2}
    chars = sum(map(len, w))
    share = lambda a, b: a / b if b else 0.0
    return {
        "n_words": len(w), "word_length": share(chars, len(w)), "symbol_share": share(len(re.findall(r"[#*$%&|<>]", text)), chars), "dup_line_share": share(len(lines) - len(set(lines)), len(lines)),
        "repeat_share": share(len(repeated), len(w)), "upper_share": share(len(re.findall("[A-Z]", text)), chars), "digit_share": share(len(re.findall("[0-9]", text)), chars), "distinct_share": share(len(set(w)), len(w)),
    }


def good(text, rules):
    f = features(text or "")
    fits = any(all(f[k] <= at if below else f[k] >= at for k, below, at in r.conditions) for r in rules)
    return f["n_words"] >= 50 and f["repeat_share"] <= 0.5 and not fits


def one_of_each(docs):
    def shingles(text):
        w = WORD.findall(text.translate(LOWER))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    docs = sorted(docs, key=lambda d: d["doc_id"])
    sets, leader = [shingles(d["text"]) for d in docs], list(range(len(docs)))

    def find(i):
        return i if leader[i] == i else find(leader[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                leader[max(x, y)] = min(x, y)
    return [d for i, d in enumerate(docs) if find(i) == i]


def without_repeats(docs, length=400):
    raw = [d["text"].encode() for d in docs]
    seen = Counter(hash(t[i : i + length]) for t in raw for i in range(len(t) - length + 1))
    out = []
    for d, t in zip(docs, raw):
        mark, end = np.zeros(len(t), bool), 0
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                mark[max(i, end) : i + length] = True
                end = i + length
        at, kept = 0, []
        for c in d["text"]:  # a character goes if all its bytes do
            n = len(c.encode())
            if not mark[at : at + n].all():
                kept.append(c)
            at += n
        if kept or not mark.any():
            text = "".join(kept)
            out.append(d | {"text": text, "n_chars": len(text) if mark.any() else d["n_chars"]})
    return out


def uncontaminated(docs, items, window=10):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    bad = set()
    for w in map(words, items):
        n = min(window, len(w))
        bad |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes = {len(x) for x in bad}

    def clean(text):
        w = words(text)
        return not any(tuple(w[k : k + n]) in bad for n in sizes for k in range(len(w) - n + 1))

    return [d for d in docs if clean(d["text"])]


def packed(docs):
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(public_tokenizer("byte_bpe_50k.json")), []
    for d in docs:
        ids = [*library.encode(d["text"], add_special_tokens=False).ids, 0]
        at = 0
        while at < len(ids):
            n = min(1024, 1 << ((len(ids) - at).bit_length() - 1))
            out.append((d["doc_id"], at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
    return sorted(out)


def fixture(sf):
    """Documents, labels and benchmark items with cases for every stage, and columns whose names clash."""
    r = random.Random(11)
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    labels = pq.read_table(f"{sf}/labels.parquet").to_pylist()
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    own = lambda n: " ".join("".join(r.choice("abcdefghiklmnoé") for _ in range(r.randint(2, 9))) for _ in range(n))
    add = lambda i, text: docs.append({"doc_id": i, "text": text, "lang": "en", "source": "s", "n_chars": len(text or "")})
    for i in range(60):  # junk with a label
        add(5000 + i, " ".join(f"{w}{r.randint(10**5, 10**7)}" for w in own(80).split()))
        labels.append({"doc_id": 5000 + i, "quality": 0, "toxic": 0})
    passage = own(90)
    for i in range(4):  # a passage in several documents, and one with nothing else
        add(6000 + i, f"{own(60)}\n{passage}\n{own(60)}")
    add(6004, passage)
    for i in range(3):  # copies stand behind what they copy, with smaller ids
        text = own(200)
        add(7010 - i, text)
        add(7000 - i, text.replace(text.split()[100], "other", 1))
        add(6990 - i, text)
    add(8000, own(70) + " " + items[0]["text"] + " " + own(70))
    for i, text in enumerate((None, "", " \n\t", "one", own(30_000))):
        add(9000 + i, text)
    docs += [dict(d) for d in docs[:3]]
    for d in docs:
        d |= {"n_removed": 1, "own_text": "x", "place": None, "uid": 2, "n_words": 3, "group": "g"}
    return docs, labels, [*items, {"item_id": None, "text": None}]


def test_rows_equal_brute_force(spark, sf, tmp_path):
    docs, labels, items = fixture(sf)
    for name, rows in (("documents", docs), ("labels", labels), ("benchmark", items)):
        pq.write_table(pa.Table.from_pylist(rows), tmp_path / f"{name}.parquet")
    tables = [spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels")]
    rules = quality.fit(*tables)
    kept = [[d for d in docs if good(d["text"], rules)]]
    kept.append(one_of_each(kept[-1]))
    kept.append(without_repeats(kept[-1]))
    kept.append(uncontaminated(kept[-1], [i["text"] for i in items]))
    at, ids = tables[0], [{d["doc_id"] for d in docs}, *({d["doc_id"] for d in k} for k in kept)]
    assert rules and not ids[1] & set(range(5000, 5060)) and {6000, 7000, 9004} <= ids[1]
    assert ids[1] > ids[2] > ids[3] > ids[4] and 6004 not in ids[3] and 8000 in ids[3] - ids[4] and {6988, 6989, 6990} <= ids[4]
    for (name, stage), want in zip(corpus_pipeline.STAGES, kept):
        at = written(stage(spark, at, str(tmp_path)), name)
        key = lambda d: (d["doc_id"], d["text"], d["n_chars"])
        assert at.columns == tables[0].columns and sorted(map(key, at.toLocalIterator())) == sorted(map(key, want)), name
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(map(tuple, got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].values.tolist())) == packed(kept[-1])
    assert got["sequence_id"].is_unique and (got["offset"] == 0).all()


def test_empty_tables_give_no_rows(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{sf}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_passages_of_over_fifty_words_are_cut_below_400_bytes(spark):
    r = random.Random(5)
    own = lambda n: " ".join("".join(r.choice("abcdefghi") for _ in range(r.randint(2, 6))) for _ in range(n))
    passage, short = own(60), own(50)
    assert len(passage) < 400
    texts = [f"{own(70)} {p} {own(70)}" for p in (passage, passage.replace(" ", "\n", 3), short, short, own(60))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {d.doc_id: d for d in corpus_pipeline.suffix_dedup(spark, docs, "", words=51).collect()}
    assert [len(got[k].text.split()) for k in range(5)] == [140, 140, 190, 190, 200]
    assert all(d.n_chars == len(d.text) for d in got.values()) and [got[k].text for k in (2, 3, 4)] == texts[2:]
