"""The queries over tables with columns whose names clash, nulls anywhere, repeated rows, and no rows."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spinewright.llm.registry import QUERIES

CLASHES = (
    "n_bytes", "n_removed", "n_spans", "n_shingles", "component_id", "kept", "n_tokens", "over_limit", "host", "path", "rule", "verdict", "n_words", "n_hit", "items", "longest", "payload", "payload_digest", "record_type", "refers_to", "held_out", "lang_pred",
    "score", "base_failed", "sequence_id", "offset", "start", "length", "doc_tokens", "block", "gram", "key", "node", "id", "place", "bucket", "value", "count", "run", "label", "row", "digest", "size", "words", "n", "k",
    "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "links", "sha", "shard", "phrase", "rank", "l", "r", "a", "seat", "word", "text", "level", "group", "host", "groups", "bytes", "home", "packed",
)
LINE = "the quick brown fox jumps over the lazy dog near a quiet river bank "


def tables(sf):
    read = lambda name, n: pq.read_table(f"{sf}/{name}.parquet").slice(0, n)
    docs, pages, labels, benchmark = read("documents", 60), read("pages", 40), read("labels", 10**6), read("benchmark", 10**6)
    texts = [None, "", " ", "x", LINE * 9, LINE * 9, "\U0001f600" * 300]
    odd = {"doc_id": [None, 900_001, 900_002, None, 900_003, 900_003, 900_004], "text": texts, "lang": [None] * 7, "source": [None] * 7, "n_chars": [None] * 7}
    docs = pa.concat_tables([docs, docs.slice(0, 3), pa.table({c: pa.array(odd[c], docs.schema.field(c).type) for c in docs.column_names}, schema=docs.schema)])
    rows = {"page_id": [None, 900_001, 900_002, 900_002], "url": [None, None, "no scheme", "http:///?#"], "html": [None, "", LINE * 40, LINE * 40]}
    pages = pa.concat_tables([pages, pages.slice(0, 2), pa.table({c: pa.array(rows[c], pages.schema.field(c).type) for c in pages.column_names}, schema=pages.schema)])
    blank = lambda t: pa.concat_tables([t, pa.table({c: pa.nulls(1, t.schema.field(c).type) for c in t.column_names}, schema=t.schema)])
    return {"documents": docs, "pages": pages, "labels": blank(labels), "benchmark": blank(benchmark)}


@pytest.fixture(scope="module")
def folders(sf, tmp_path_factory):
    out = {}
    for kind in ("plain", "clashing", "empty"):
        out[kind] = tmp_path_factory.mktemp(kind)
        for name, t in tables(sf).items():
            if kind == "clashing":
                for c in CLASHES:
                    if c not in t.column_names:
                        t = t.append_column(c, pa.array(["?"] * len(t)))
            pq.write_table(t.slice(0, 0) if kind == "empty" else t, out[kind] / f"{name}.parquet")
    return {k: str(p) for k, p in out.items()}


#: Columns that name a row, and aren't a result: sequences are numbered anew in each run.
NUMBERS = {"op10_packing": ["sequence_id"]}


@pytest.mark.parametrize("name", list(QUERIES))
def test_clashing_columns_change_nothing(spark, folders, name):
    rows = lambda kind: sorted(map(repr, QUERIES[name](spark, folders[kind]).drop(*NUMBERS.get(name, [])).collect()))
    plain = rows("plain")
    assert rows("clashing") == plain
    assert rows("empty") == []
    if name == "op12_collocations":  # a row for each phrase
        assert plain
        return
    by = "page_id" if "page_id=" in plain[0] else "doc_id"
    want = pq.read_table(f"{folders['plain']}/{'pages' if by == 'page_id' else 'documents'}.parquet").column(by).to_pylist()
    got = [r[by] for r in QUERIES[name](spark, folders["plain"]).collect()]
    if name == "op10_packing":
        assert set(got) == set(want)
    else:
        assert sorted(got, key=str) == sorted(want, key=str)
