"""Claims, clusters and ranking against the rules one by one, and the whole plan's sums."""

import os
import random
import urllib.parse

import duckdb
from pyspark.sql import functions as F

from spinewright import report
from spinewright.functions.paths import lower_keys
from spinewright.operators import running
from spinewright.operators.claims import claims, fold
from spinewright.operators.intra import clusters, intra_duplicates
from spinewright.operators.inventory import editions, recalculated, with_edition
from spinewright.operators.ranking import ranked, reasons
from spinewright.plans import fixtures, organise, queries
from spinewright.plans.virtual import library
from spinewright.streaming import intake

FILES = "path string, folder string, name string, ext string, size bigint, author string, book string, year string, bitrate bigint, duration double"


def sequential(files, disk):
    seen, out = {}, {}
    for path, dest, fp in sorted(files):
        held = seen.get(dest, disk.get(dest))
        if held is None:
            final = dest
        elif held == fp:
            out[path] = ("quarantine" if dest in seen else "skip", dest)
            continue
        else:
            base, ext = dest.rsplit(".", 1)
            final = next(x for n in range(2, 10**6) if (x := f"{base}.{n}.{ext}") not in seen and x not in disk)
        seen[final] = fp
        out[path] = ("proceed", final)
    return out


def test_claims_follow_the_sequential_rule(spark):
    r = random.Random(11)
    names = ["a.m4b", "a.2.m4b", "a.3.m4b", "a.2.2.m4b", "b.mp3", "c.mp3", "d.1.mp3"]
    files = [(f"/s/{k:04}", f"/o/{r.randint(0, 20)}/{r.choice(names)}", r.choice("xyz")) for k in range(900)]
    disk = {f"/o/{r.randint(0, 20)}/{r.choice(names)}": r.choice("xyz") for _ in range(40)}
    got = claims(spark.createDataFrame(files, "path string, dest_file string, fp string"), spark.createDataFrame(list(disk.items()), "dest string, disk_fp string")).collect()
    assert {g.path: (g.action, g.final) for g in got} == sequential(files, disk)


def row(path, author="A", book="B", year="", bitrate=64000, duration=60.0, size=10):
    folder, _, name = path.removeprefix("/lib/").rpartition("/")
    return (path, folder, name, name.rsplit(".", 1)[-1].lower(), size, author, book, year, bitrate, duration)


def test_clusters_are_anchored_and_need_evidence(spark):
    files = [row(f"/lib/d/{n}", duration=d) for n, d in (("x.mp3", 10.0), ("x.2.mp3", 10.8), ("y.mp3", 11.6), ("z.mp3", 30.0), ("w.mp3", 30.5), ("q.mp3", 0.0), ("q.2.mp3", 0.0))]
    keyed = with_edition(spark.createDataFrame(files, FILES))
    known = editions(keyed)
    found = intra_duplicates(clusters(keyed, known)).collect()
    assert [(r.path, r.kept, r.reason) for r in found] == [("/lib/d/x.2.mp3", "/lib/d/x.mp3", "same duration, same format, 1 duplicate copy")]
    new = recalculated(known, keyed, intra_duplicates(clusters(keyed, known))).first()
    assert (new.file_count, new.total_duration, new.format) == (6, 82.1, "mp3")


def test_editions_are_ranked_with_reasons(spark):
    files = [
        row("/lib/A/B/1.m4b", "A", "The Big", "2001", 64000), row("/lib/A/B2/1.mp3", "a", "Big (Unabridged)", "2003", 128000), row("/lib/_Unknown/B/1.mp3", "A", "Big: Tale of it", "2003", 128000), row("/lib/A - Big.mp3", "", "", ""),
        row("/lib/x.mp3", "", ""), row("/lib/y.mp3", "", ""),
    ]
    rank = ranked(editions(with_edition(spark.createDataFrame(files, FILES))))
    assert [(r.edition_dir, r.rank) for r in rank.orderBy("rank").collect()] == [("/lib/A/B", 1), ("/lib/A/B2", 2), ("/lib/_Unknown/B", 3), ("/lib/A - Big.mp3", 4)]
    why = reasons(rank).first()
    assert why.display == '"The Big" by A' and why.losers == 3
    assert why.reason == "M4B preferred over MP3; M4B preferred over MP3; M4B preferred over MP3; has year metadata (2001)"


def test_every_file_has_one_outcome(spark, sf):
    files = queries.audio(spark, sf)
    dedup = organise.book_dedup(files)
    planned = organise.plan(files, queries.listing(files), "/out", dedup).persist()
    n = {r.outcome: r["count"] for r in planned.groupBy("outcome").count().collect()}
    assert sum(n.values()) == files.count() == planned.select("path").distinct().count() and {"move", "intra", "cross", "existing_duplicate"} <= set(n)
    c = organise.counters(planned).first()
    assert c.files == c.moved + c.skipped + c.dupe - n["existing_duplicate"] + c.intra_dedup + c.book_dedup
    assert dedup.intra.join(dedup.cross, "path").count() == 0


def test_counters_of_all_files_follow_the_sequential_rule(spark, sf):
    files = queries.audio(spark, sf, errors=True)
    dedup = organise.book_dedup(files)
    intra, cross = ({r.path for r in x.select("path").collect()} for x in (dedup.intra, dedup.cross))
    rows = queries.plan_files(files).select("path", "dest_file", "fp", "no_meta", "e", "title", "name", "error").collect()
    disk = {}
    for r in rows:
        if r.e % 17 == 0:
            disk[r.dest_file] = min(r.fp, disk.get(r.dest_file, r.fp))
    left = [r for r in rows if r.path not in intra | cross and not r.error]
    failed = sum(r.path not in intra | cross and bool(r.error) for r in rows)
    done = sequential([(r.path, r.dest_file, r.fp) for r in left], disk)
    moved = [r for r in left if done[r.path][0] == "proceed"]
    skipped = sum(a == "skip" for a, _ in done.values())
    want = {
        "files": len(rows), "moved": len(moved), "skipped": skipped, "dupe": skipped + sum(a == "quarantine" for a, _ in done.values()), "conflict": sum(done[r.path][1] != r.dest_file for r in moved),
        "intra_dedup": len(intra), "book_dedup": len(cross), "book_dedup_groups": dedup.decisions.count(), "failed": failed, "no_meta": sum(r.no_meta for r in moved),
    }
    assert queries.QUERIES["run_counters"](spark, sf).first().asDict() == want
    assert failed and intra and cross and any(r.title.endswith(".2") for r in rows)


def test_book_queries_take_copies_within_editions_out_first(spark, monkeypatch):
    copies = [row(f"/lib/A/Long/x{end}.mp3", "A", "B", "2001", rate) for end, rate in (("", 64000), (".2", 256000), (".3", 256000))]
    rival = [row("/lib/A/Other/y.mp3", "A", "B", "2001", 128000)]
    monkeypatch.setattr(queries, "audio", lambda *_: spark.createDataFrame(copies + rival, FILES))
    got = {name: queries.QUERIES[name](spark, "").collect() for name in ("edition_reason", "cross_quarantine_files", "kept_files")}
    # Counted with its copies, the first edition would have the higher bitrate and win.
    assert [(r.kept_dir, r.losers, r.reason) for r in got["edition_reason"]] == [("/lib/A/Other", 1, "higher bitrate (128kbps vs 64kbps)")]
    assert [r.path for r in got["cross_quarantine_files"]] == ["/lib/A/Long/x.mp3"]
    assert [(r.ext, r.files, r.bytes) for r in got["kept_files"]] == [("mp3", 1, 10)]


def test_copies_within_editions_are_reported(spark):
    copies = [row(f"/lib/A/Long/x{end}.mp3", "A", "B", "2001", 64000) for end in ("", ".2", ".3")]
    dedup = organise.book_dedup(spark.createDataFrame(copies, FILES))
    lines = [r.line for r in report.intra_lines(dedup.intra, dedup.editions).collect()]
    assert lines == ['  "B" by A [Long]\n    KEEP:       x.mp3\n    QUARANTINE: x.2.mp3\n    QUARANTINE: x.3.mp3\n    Reason: same duration, same format, 2 duplicate copies']
    dedup.release()


def test_very_many_conflicts_of_one_name():
    rows = [(f"/s/{k:06}", "/d/x.m4b", str(k), "/d/x", ".m4b") for k in range(30_000)]
    rows.insert(5, ("/s/000004b", "/d/x.7.m4b", "own", "/d/x.7", ".m4b"))
    final = [r[3] for r in fold(rows)]
    assert len(set(final)) == len(rows) and final[:9] == ["/d/x.m4b", "/d/x.2.m4b", "/d/x.3.m4b", "/d/x.4.m4b", "/d/x.5.m4b", "/d/x.7.m4b", "/d/x.6.m4b", "/d/x.8.m4b", "/d/x.9.m4b"]


def test_queries_equal_their_sql(spark, sf):
    con = duckdb.connect()
    for t in ("part", "supplier", "events", "orders", "pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))
    for name in ("ext_filter_scan", "tag_chain_order", "normalise_author_key", "normalise_book_key", "accent_fold", "build_dest", "edition_inventory", "intra_duplicate_files", "edition_reason", "claim_window", "claim_family", "organise_plan", "organise_errors", "organise_again", "run_counters", "cross_quarantine_files", "kept_files", "format_quality", *fixtures.QUERIES):
        want = con.execute(queries.ORACLE_SQL[name]).df()
        assert rows(queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]) == rows(want), name


def test_destinations_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("/s/A/B/x.mp3", "A/B", "x.mp3", {"title": "T"})], "path string, folder string, name string, tags map<string,string>")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = intake.destinations(stream, "/out").select("dest_file").writeStream.format("memory").queryName("taken").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.dest_file for r in spark.sql("SELECT * FROM taken").collect()] == ["/out/A/B/T.mp3"]


def test_counts_are_taken_while_a_plan_is_written_and_steps_released(spark):
    copies = [row(f"/lib/A/Long/x{end}.mp3", "A", "B", "2001", 64000) for end in ("", ".2", ".3")]
    files = spark.createDataFrame([(*r, *[""] * 8, "f" + r[0], "bad" if ".3" in r[0] else None) for r in copies], FILES + ", title string, track string, disc string, series string, series_index string, narrator string, subtitle string, genre string, fp string, error string")
    dedup = organise.book_dedup(files)
    there = spark.createDataFrame([], "dest string, disk_fp string")
    for known, groups in ((None, 0), (dedup, 7)):
        planned = organise.plan(files, there, "/out", known)
        kept = []
        out, found = running.counted(planned, organise.counts(groups), kept)
        assert found == planned.agg(*(c.alias(k) for k, c in organise.counts(groups).items())).first().asDict() and found["files"] == out.count() == 3
        assert (found["failed"], found["intra_dedup"], found["book_dedup_groups"]) == ((1, 0, 0) if known is None else (0, 2, 7))
    paths = [urllib.parse.urlparse(p).path for p in (*kept, *dedup.kept)]
    assert len(paths) == 6 and all(map(os.path.exists, paths))
    running.release(kept)
    dedup.release()
    assert not any(map(os.path.exists, paths))


def test_tags_are_put_together_once_and_by_many_tasks(spark, sf):
    """A step inside a lambda is worked out again for each element; library's events are one small file."""
    made = queries.tag_chain_order(spark, sf)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("map_entries(") == 1
    assert library(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = spark.range(1).select(F.create_map(F.lit("A"), F.lit("1"), F.lit("b"), F.lit("2"), F.lit("a"), F.lit("3"), F.lit("Ab"), F.lit(None).cast("string")).alias("t"))
    assert row.select(lower_keys(F.col("t"))).first()[0] == {"b": "2", "a": "3", "ab": None}
