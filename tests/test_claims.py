"""Claims by names and ranges against the rule file by file."""

import random

import pyarrow as pa
import pytest

from spinewright.operators import running as R
from spinewright.operators.claims import claims, fold

FILES, DISK = "path string, dest_file string, fp string", "dest string, disk_fp string"


def by_rule(files, disk):
    """fold over each family, whatever its names."""
    import re

    def split(dest):
        folder, _, name = dest.rpartition("/")
        stem, dot, ext = name.rpartition(".")
        return (f"{folder}/{stem}", dot + ext)

    families = {}
    for dest, fp in disk.items():
        base, suffix = split(dest)
        families.setdefault((re.sub(r"(\.\d+)+$", "", base), suffix), []).append((None, dest, fp, base, suffix))
    for path, dest, fp in sorted(files):
        base, suffix = split(dest)
        families.setdefault((re.sub(r"(\.\d+)+$", "", base), suffix), []).append((path, dest, fp, base, suffix))
    return {r[0]: (r[2], r[3]) for rows in families.values() for r in fold(rows)}


def got(spark, files, disk, parts=3):
    rows = claims(spark.createDataFrame(files, FILES).repartition(parts), spark.createDataFrame(list(disk.items()), DISK)).collect()
    assert len(rows) == len(files)
    return {r.path: (r.action, r.final) for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_claims_equal_the_rule(spark, seed):
    r = random.Random(seed)
    names = ["a.m4b", "a.2.m4b", "a.3.m4b", "a.4.m4b", "a.7.m4b", "a.2.2.m4b", "a.2.3.m4b", "a.02.m4b", "a.1.m4b", "a.2.2.2.m4b", "b.mp3", "b.1.2.mp3", "b.12.mp3", f"b.{10**20}.mp3"]
    files = [(f"/s/{k:04}", f"/o/{r.randint(0, 12)}/{r.choice(names)}", r.choice("xyzw" * 3 + "_")) for k in range(1500)]
    disk = {f"/o/{r.randint(0, 12)}/{r.choice(names)}": r.choice("xyz") for _ in range(60)}
    want = by_rule(files, disk)
    assert got(spark, files, disk) == want


def test_one_large_family_is_spread_over_tasks(spark):
    """Most files want one name, others its numbers; no task has more than its share."""
    r = random.Random(5)
    files = [(f"/s/{k:06}", "/d/x.m4b" if r.random() < 0.6 else f"/d/x.{r.randint(2, 9000)}.m4b", str(r.randint(0, 900))) for k in range(12_000)]
    disk = {f"/d/x.{n}.m4b": "there" for n in range(3, 400, 7)}
    want = by_rule(files, disk)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        assert got(spark, files, disk) == want
        rows = spark.createDataFrame([("k", f"{k:05}", 1) for k in range(5000)], "key string, at string, one bigint")
        sizes = [x["count"] for x in rows.repartitionByRange(12, "key", "at").groupBy(R.F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * 5000 / 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_null_fingerprints_and_no_rows(spark):
    files = [("/s/1", "/d/x.mp3", None), ("/s/2", "/d/x.mp3", None), ("/s/3", "/d/y.mp3", None)]
    assert got(spark, files, {"/d/y.mp3": "f"}) == {"/s/1": ("proceed", "/d/x.mp3"), "/s/2": ("proceed", "/d/x.2.mp3"), "/s/3": ("proceed", "/d/y.2.mp3")}
    none = spark.createDataFrame([], FILES)
    assert claims(none, spark.createDataFrame([], DISK)).count() == 0


@pytest.mark.parametrize("largest", [False, True])
def test_running_totals_cross_partitions(spark, largest):
    r = random.Random(3)
    rows = [(r.choice("aaaaaaab"), k, r.randint(0, 9), str(k)) for k in range(3000)]
    out = R.running(spark.createDataFrame(rows, "key string, at int, value bigint, rest string").repartition(5), "key", ["at"], "value", largest).collect()
    total, want = {}, {}
    for key, at, value, _ in rows:
        total[key] = max(total.get(key, 0), value) if largest else total.get(key, 0) + value
        want[key, at] = total[key]
    assert {(x.key, x.at): x.running for x in out} == want and len(out) == len(rows) and all(x.rest == str(x.at) for x in out)


def test_running_within_batches():
    batches = [pa.record_batch([pa.array(k), pa.array(v, pa.int64())], names=["k", "v"]) for k, v in ((["a", "a", "b"], [1, 2, 3]), (["b"], [4]), ([], []), (["b", "c", "c"], [5, 6, 7]))]
    batches[2] = pa.record_batch([pa.array([], pa.string()), pa.array([], pa.int64())], names=["k", "v"])
    assert [x for b in R.Running(False)(iter(batches)) for x in b.column(2).to_pylist()] == [1, 3, 3, 7, 12, 6, 13]
    assert [x for b in R.Running(True)(iter(batches)) for x in b.column(2).to_pylist()] == [1, 2, 3, 4, 5, 6, 7]
