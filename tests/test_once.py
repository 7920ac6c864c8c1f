"""What a plan writes, joins and works out no more than once."""

import pandas as pd

from spinewright.functions import folding
from spinewright.operators.claims import claims
from spinewright.plans import organise

FILES = "path string, folder string, name string, ext string, size bigint, author string, book string, year string, bitrate bigint, duration double, title string, track string, disc string, series string, series_index string, narrator string, subtitle string, genre string, fp string, more string"


def made(spark):
    rows = [(f"/lib/d/x{k}{s}.mp3", "d", f"x{k}{s}.mp3", "mp3", 10, "A", "B", "", 64000, 60.0 + 5 * k, "T", "", "", "", "", "", "", "", f"f{k % 2}", "m") for k in range(6) for s in ("", ".2")]
    return spark.createDataFrame(rows, FILES)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_claims_join_files_and_names_once(spark):
    files = spark.createDataFrame([(f"/s/{k}", f"/o/{k % 3}.mp3", f"f{k % 4}", k) for k in range(40)], "path string, dest_file string, fp string, own int")
    out = claims(files, spark.createDataFrame([("/o/1.mp3", "f1")], "dest string, disk_fp string"), ("own",))
    assert "Join Inner" not in optimized(out)
    assert all(r.path == f"/s/{r.own}" for r in out.collect()) and out.count() == 40


def test_keys_of_repeated_names_are_made_once(spark):
    folding.author_key.cache_clear()
    assert set(folding.author_keys(pd.Series(["Zed; É", "Zed; É"] * 500))) == {"e, zed"}
    assert folding.author_key.cache_info().misses == 1


def test_clusters_are_found_by_lengths_alone(spark):
    from spinewright.operators.intra import cluster_lengths
    from spinewright.operators.inventory import editions, with_edition

    keyed = with_edition(made(spark))
    found = cluster_lengths(keyed, editions(keyed))
    assert not {"path", "name"} & set(found.columns)
    assert [(r.duration, r.cluster_start, r.files, r.suffixed) for r in found.orderBy("duration").collect()] == [(60.0 + 5 * k, 60.0 + 5 * k, 2, True) for k in range(6)]


def test_book_dedup_keeps_only_what_it_looks_at(spark):
    assert not {"more", "fp", "title", "genre"} & set(organise.book_dedup(made(spark)).keyed.columns)


def test_plan_is_joined_once(spark):
    files = made(spark)
    there = spark.createDataFrame([], "dest string, disk_fp string")
    out = organise.plan(files, there, "/out", organise.book_dedup(files))
    assert not any(x in optimized(out) for x in ("LeftSemi", "LeftAnti", "Join Inner"))
    assert sorted((r.outcome, r.path) for r in out.collect() if r.outcome == "intra") == [("intra", f"/lib/d/x{k}.2.mp3") for k in range(6)]
