"""URL filters, WARC archives and the pipeline."""

import gzip
import random
from collections import defaultdict
from math import sqrt

import duckdb

import corpus_pipeline
from spinewright.llm import registry, urlfilter, warc
from spinewright.llm.shared import scratch_path, written

PAGES = "page_id bigint, url string, html string"


def test_rules_and_empty_urls(spark):
    urls = ["http://a.net/x", "https://A.example.NET/en/1", "http://example.com/de/", "http://q.org/fr/?x", "http://net", "no scheme", None, "ftp://h.com?q/://x", "http://x.com/#a"]
    pages = spark.createDataFrame([(i, u, "p", "h") for i, u in enumerate(urls)], PAGES + ", host string")
    labels = spark.createDataFrame([(8, 1, 0), (8, 1, None), (7, 0, 0), (None, 1, 0), (6, None, 1)], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: r for r in urlfilter.filter_urls(pages, labels).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [
        ("a.net", "/x", "net/"), ("a.example.net", "/en/1", "example.net/en/"), ("example.com", "/de/", "example.com/de/"), ("q.org", "/fr/", "org/fr/"), ("net", "", None), ("", "", None), ("", "", None), ("h.com", "", None), ("x.com", "/", None),
    ]
    assert [got[i].verdict for i in range(4)] == ["block", "allow", "block", "allow"]
    assert urlfilter.filter_urls(pages, labels.where("false")).count() == 9 and urlfilter.filter_urls(pages.where("false"), labels).count() == 0


def test_reputation_takes_after_the_domain(spark):
    pages = spark.createDataFrame([(i, f"http://{'good' if i < 40 else 'bad'}.{'a' if i < 40 else 'b'}.com/{i}") for i in range(80)] + [(90, "http://new.a.com/"), (91, "http://new.b.com/")], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(pages, labels, rules=()).collect()}
    assert (got[0], got[50], got[91]) == ("allow", "block", "block")


def test_sites_below_country_suffixes_have_domains_of_their_own(spark):
    names = ["org.uk", "ac.uk", "co.in", "com.cn", "co.uk"]
    listed = urlfilter.suffixes_of(["// a list", *(f"{n.upper()} // with a comment" for n in names), "*.ck", "!www.ck", "com", ""])
    assert listed == tuple(sorted(names))
    for suffix in names:
        urls = [f"http://www.s{k}.{suffix}/{i}" for k in range(10) for i in range(20)]
        pages = spark.createDataFrame([*enumerate(urls), (900, f"http://new.s0.{suffix}/"), (901, f"http://new.s9.{suffix}/")], "page_id bigint, url string")
        labels = spark.createDataFrame([(i, int(i < 100), 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
        got = {r.page_id: r.verdict for r in urlfilter.filter_urls(pages, labels, rules=(), two_label_suffixes=listed).collect()}
        assert (got[0], got[199], got[900], got[901]) == ("allow", "block", "allow", "block"), suffix


def moments(groups):
    """(1 - rho) / rho of lists of (n, s), as the beta-binomial's moments pooled over the lists give it."""
    above = below = 0.0
    for g in groups:
        g = [(n, s) for n, s in g if n]
        n, s = sum(x for x, _ in g), sum(y for _, y in g)
        if n:
            m = s / n
            above += sum(x * (y / x - m) ** 2 for x, y in g) - m * (1 - m) * (len(g) - 1)
            below += m * (1 - m) * (n - sum(x * x for x, _ in g) / n - (len(g) - 1))
    rho = min(max(above / below if below else urlfilter.LEAST_RHO, urlfilter.LEAST_RHO), urlfilter.MOST_RHO)
    return (1 - round(rho, 6)) / round(rho, 6)


def test_reputation_equals_brute_force(spark):
    r = random.Random(11)
    hosts = [f"{h}.{d}{t}" for t in (".com", ".org", ".co.uk", ".de") for d in ("a", "b", "c") for h in ("www", "x.y", "blog")] + ["com", "co.uk", "z.de", ""]
    taste = {h: r.random() for h in hosts}
    rows = [(i, h) for i, h in enumerate(r.choices(hosts, k=900))]
    pages = spark.createDataFrame([(i, f"http://{h}/{i}" if h else None) for i, h in rows] + [(5, f"http://{rows[5][1]}/5")], "page_id bigint, url string")
    labels = {i: (int(r.random() < taste[h]), int(r.random() < 0.1)) for i, h in rows if r.random() < 0.5}
    table = [(i, *x) for i, x in labels.items()] + [(7, 1, 0), (7, 0, 0)]
    labels[7] = (0, 0)
    n, s = defaultdict(int), defaultdict(int)
    for i, h in [*rows, rows[5]]:
        if i in labels:
            n[h] += 1
            s[h] += labels[i][0] and not labels[i][1]
    suffix = lambda h: ".".join(h.split(".")[-2:]) if ".".join(h.split(".")[-2:]) in urlfilter.TWO_LABEL_SUFFIXES else h.split(".")[-1]
    domain = lambda h: h if h.count(".") < len(suffix(h).split(".")) else ".".join(h.split(".")[-len(suffix(h).split(".")) - 1 :])
    known = {h for _, h in rows}
    total = lambda hs: (sum(n[h] for h in hs), sum(s[h] for h in hs))
    of_domain = {d: [h for h in known if domain(h) == d] for d in map(domain, known)}
    of_suffix = {t: [d for d in of_domain if suffix(of_domain[d][0]) == t] for t in map(suffix, known)}
    sums = {d: total(hs) for d, hs in of_domain.items()}
    tops = {t: tuple(map(sum, zip(*(sums[d] for d in ds)))) for t, ds in of_suffix.items()}
    strength_suffix, strength_domain, strength_host = moments([tops.values()]), moments([[sums[d] for d in ds] for ds in of_suffix.values()]), moments([[(n[h], s[h]) for h in hs] for hs in of_domain.values()])
    all_n, all_s = total(known)
    verdicts = {}
    for t, ds in of_suffix.items():
        top = (strength_suffix * (all_s + 1) / (all_n + 2) + tops[t][1]) / (strength_suffix + tops[t][0])
        for d in ds:
            middle = (strength_domain * top + sums[d][1]) / (strength_domain + sums[d][0])
            for h in of_domain[d]:
                size = strength_host + n[h]
                mean = (strength_host * middle + s[h]) / size
                verdicts[h] = "allow" if mean - urlfilter.Z * sqrt(mean * (1 - mean) / (size + 1)) >= urlfilter.MIN_BOUND else "block"
    got = urlfilter.filter_urls(pages, spark.createDataFrame(table, "doc_id bigint, quality int, toxic int"), rules=()).collect()
    assert len(got) == 901 and set(verdicts.values()) == {"allow", "block"}
    assert all(g.verdict == verdicts[g.host] for g in got)


def test_large_pages_come_in_blocks_of_their_own(spark, monkeypatch):
    rows = [(i, f"http://a.com/{i}", random.Random(i % 3).randbytes(900_000).hex() + "é") for i in range(8)]
    monkeypatch.setattr(warc, "BLOCK_BYTES", 1 << 20)
    monkeypatch.setattr(warc, "ROOT_LINES", 1)
    made = warc.archive(spark.createDataFrame(rows, PAGES), scratch_path(spark, "warc"))
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in made.scan().collect())
    assert got == [(i, "response", None) if i > 4 else (i, "revisit", {0: 6, 1: 7, 2: 5}[i % 3]) for i in range(8)]
    keys = spark.createDataFrame([("com,a)/7", 7), ("com,a)/0", None)], "key string, page_id bigint")
    found = {r.page_id: r for r in made.lookup(keys).collect()}
    assert bytes(found[7].payload) == rows[7][2].encode() and found[0].record_type == "revisit" and len(found) == 2


def test_archives_read_back(spark, tmp_path):
    big, same = "é" * 600, "s" * 1000
    rows = [(1, "http://b.com/1", big), (2, "http://a.com/ x\n", big), (3, None, big), (4, "http://a.com/", same), (5, "http://a.com/", same), (5, "http://a.com/", same), (6, "http://a.com/", "s" * 999), (7, "http://a.com/", "s" * 999), (8, "u", None), (9, "u", ""), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], PAGES + ", digest string")
    made = warc.archive(pages, scratch_path(spark, "warc"), block_lines=2)
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in made.scan().collect()), key=str)
    want = [(0, "response", None, 1200), (1, "revisit", 3, None), (2, "revisit", 3, None), (3, "response", None, 1200), (4, "revisit", 5, None), (5, "response", None, 1000), (5, "response", None, 1000), (6, "response", None, 999), (7, "response", None, 999), (8, "response", None, 0), (9, "response", None, 0)]
    assert got == sorted(want, key=str)
    keys = pages.where("page_id IN (4, 6)").select(warc.url_key(pages.url).alias("key"), "page_id").union(spark.createDataFrame([("com,a)/", None), ("com,zzz)/", None)], "key string, page_id bigint"))
    found = sorted((r.key, r.page_id, r.record_type) for r in made.lookup(keys).collect())
    assert found == sorted([("com,a)/", p, t) for p, t in ((4, "revisit"), (6, "response"), (4, "revisit"), (5, "response"), (5, "response"), (6, "response"), (7, "response"))])
    folder = made.folder.removeprefix("file://").removeprefix("file:")
    name = made.ranges.first().archive
    text = gzip.open(f"{folder}/{name}").read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    names = [line for r in made.ranges.collect() for line in gzip.open(f"{folder}/{r.archive}").read().split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(names) == len(set(names)) == len(rows) + made.ranges.count()
    refers = {line.split(b": ")[1] for r in made.ranges.collect() for line in gzip.open(f"{folder}/{r.archive}").read().split(b"\r\n") if line.startswith(b"WARC-Refers-To:")}
    assert refers <= {n.split(b": ")[1] for n in names}
    assert warc.archive(pages.where("false"), scratch_path(spark, "warc")).scan().count() == 0


def test_queries_equal_their_sql(spark, sf):
    con = duckdb.connect()
    for t in ("pages", "labels", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        want = con.execute(sql).df()
        got = registry.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
        rows = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))
        assert rows(got) == rows(want), name


def test_pipeline_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.limit(1).selectExpr("doc_id + 100000 AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")
    at, sizes = docs.union(extra).union(docs.where("doc_id < 3")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = written(stage(spark, at, sf), "stage")
        assert at.columns == docs.columns
        sizes.append(at.count())
    assert docs.count() > sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 0
    ids = {r.doc_id for r in at.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def test_ports_and_addresses(spark):
    """A port is no part of the domain, and the parts of an address are no domains."""
    urls = [f"http://a.com:80{k:02}/{i}" for k in range(10) for i in range(10)] + [f"http://10.0.{k}.1/{i}" for k in range(10) for i in range(10)]
    pages = spark.createDataFrame([*enumerate(urls), (900, "https://new.a.com:1/"), (901, "http://10.0.77.1/"), (902, "http://[::1]:8080/x"), (903, "http://com:8000/")], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: (r.host, r.verdict) for r in urlfilter.filter_urls(pages, labels, rules=()).collect()}
    assert got[0] == ("a.com:8000", "allow") and got[900] == ("new.a.com:1", "allow") and got[199][1] == "block"
    assert got[901][0] == "10.0.77.1" and got[902][0] == "[::1]:8080"
    tree = urlfilter._tree("counts", 0.5, 1.645, ("co.uk",)).split("domains AS (")[0].rstrip().rstrip(",")
    hosts = {r.host: (r.domain, r.suffix) for r in spark.sql(f"WITH counts AS (SELECT explode(array('a.com:80', 'x.b.co.uk:1', '10.0.0.1:9', '[::1]:8080', 'com:1', '', 'w.a.com')) AS host, 0D AS n, 0D AS s), {tree} SELECT * FROM hosts").collect()}
    assert hosts == {"a.com:80": ("a.com", "com"), "x.b.co.uk:1": ("b.co.uk", "co.uk"), "10.0.0.1:9": ("10.0.0.1", "address"), "[::1]:8080": ("[::1]", "address"), "com:1": ("com", "com"), "": ("", ""), "w.a.com": ("a.com", "com")}
