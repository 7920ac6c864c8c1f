"""Cross-tokenizer alignment against a brute force over byte ranges."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from spinewright.llm import alignment, tokens

from test_text import frame, odd_texts

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def brute(texts):
    """The contract's columns from the libraries' own ids and every pair of byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.public_tokenizer(A))
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=tokens.public_tokenizer(B))
    entry = {i: w for w, i in alignment.byte_level_tokens(tokens.public_tokenizer(A)).items()}

    def piece(i):
        p = model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    docs, count = [], Counter()
    for t in texts:
        a = library.encode(" " + t, add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        a_bytes, b_bytes = [entry[i] for i in a], [piece(i) for i in b]
        if not t or b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            docs.append(None)
            continue
        spans = []
        for side in (a_bytes, b_bytes):
            at, out = 0, []
            for w in side:
                out.append((at, at + len(w)))
                at += len(w)
            spans.append(out)
        links, j = [], 0
        for x, (s, e) in zip(a, spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((x, b[k]))
                k += 1
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, before = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, (s, f) in zip(a, spans[0]) if before <= s and f <= e) + "|" + ",".join(str(i) for i, (s, f) in zip(b, spans[1]) if before <= s and f <= e))
            before = e
        count.update(links)
        docs.append((len(a), len(b), links, groups))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups = d
            out.append((n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(frame):
    return alignment.align_tokens(frame, tokens.public_tokenizer(A), tokens.public_tokenizer(B))


@pytest.mark.parametrize("parts", [1, 5])
def test_alignment_equals_brute_force(spark, parts):
    texts = [*odd_texts(400), "unbelievable re-tokenisation", "unbelievable re-tokenisation", "word " * 3000, "naïve café " * 20, "x" * 20000, " lead", "trail ", "a  b", "a\n b", "a　 b", "é b  c", "▁"]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in aligned(frame(spark, texts).repartition(parts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_alignment_of_no_rows_and_repeated_ones(spark):
    rows = spark.createDataFrame([(1, "a b", 2), (1, "a b", 3), (None, "c", 4)], "doc_id bigint, text string, n_a int")
    got = sorted((r.doc_id or 0, *(r[c] for c in COLUMNS)) for r in aligned(rows).collect())
    want = brute(["c", "a b", "a b"])
    assert got == sorted([(0, *want[0]), (1, *want[1]), (1, *want[2])])
    assert aligned(rows.where("false")).count() == 0


def test_transducer_closes_groups_and_refuses_other_bytes():
    t = alignment.Transducer([b"ab", b"c", b"a", b"abcd"], [b"a", b"bc", b"abc", b"d"])
    cases = [([0, 1], [0, 1]), ([3, 3], [2, 3, 2, 3]), ([0, 1], [0]), ([2], [1]), ([], [0]), ([], []), ([0], [])]
    flat = [np.array([x for c in cases for x in c[k]], np.int64) for k in (0, 1)]
    bounds = [np.append(0, np.cumsum([len(c[k]) for c in cases])) for k in (0, 1)]
    for _ in range(2):  # by moves worked out, and then by those kept
        good, a_group, a_link, b_group, b_link = t.align(flat[0], bounds[0], flat[1], bounds[1])
        assert good.tolist() == [True, True, False, False, False, True, False]
        assert a_group[:4].tolist() == [0, 0, 0, 1] and b_group[:6].tolist() == [0, 0, 0, 0, 1, 1]
        assert a_link[:4].tolist() == [-1, 1, -1, -1] and b_link[:6].tolist() == [0, 0, 3, 3, 3, 3]
    texts = alignment.GroupWriter(4, 4).write(3, flat[0][:4], np.array([0, 0, 2, 2]), a_group[:4], flat[1][:6], np.array([0, 0, 2, 2, 2, 2]), b_group[:6])
    assert texts.to_pylist() == ["0,1|0,1;", "", "3|2,3;3|2,3;"]


def test_query_over_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.op11_token_alignment(spark, sf).collect()}
    want = brute([r.text for r in rows])
    assert [got[r.doc_id] for r in rows] == want
