"""Plans carried out by tasks: the same as row by row, also if a task is run again."""

import os

import pyarrow as pa
import pytest

from spinewright import cli, executor
from spinewright.plans import fixtures
from test_library import args, library_to_move, make, picture, plan_of, state, text_frame

PLAN = "path string, no_meta boolean, outcome string, final string, error string"


def by_rows(spark, root, rows):
    """The plan's rows one by one in the order of paths, by a journal."""
    return run(spark, root, rows, str(root / "journal"))


def run(spark, root, rows, journal=None):
    lines = []
    planned = spark.createDataFrame([(str(root / p), False, o, f and str(root / f), e) for p, o, f, e in rows], PLAN)
    done = executor.apply(planned, str(root / "in"), str(root / "out"), str(root / "in/dupes"), False, True, lines.append, journal)
    return done, [x.replace(str(root), "") for x in lines], state(root)


ROWS = [
    ("in/a/0.mp3", "move", "out/A/plain.mp3", None), ("in/a/1.mp3", "move", "out/A/first.mp3", None), ("in/a/2.mp3", "move", "out/A/second.mp3", None),
    ("in/a/3.mp3", "duplicate", None, None), ("in/dupes/a/3.mp3", "move", "out/A/from dupes.mp3", None),  # the place where a/3.mp3 goes, which isn't free yet
    ("in/b/1.mp3", "move", "out/B/same.mp3", None), ("in/c/1.mp3", "move", "out/B/same.mp3", None), ("in/c/2.mp3", "move", "out/../evil.mp3", None),
    ("in/d/1.mp3", "in_place", None, None), ("in/d/2.mp3", "failed", None, "no"), ("in/d/3.mp3", "move", "out/D/there.mp3", None), ("in/d/gone.mp3", "move", "out/D/gone.mp3", None),
]


def folders(root):
    for p, *_ in ROWS:
        if "gone" not in p:
            make(root, p, text_frame("TIT2", p), *(() if p == "in/a/0.mp3" else (picture(p.encode()),)))
    make(root, "out/D/there.mp3")


def test_tasks_do_what_rows_do(spark, tmp_path):
    for root in (tmp_path / "rows", tmp_path / "tasks"):
        folders(root)
    done, lines, found = by_rows(spark, tmp_path / "rows", ROWS)
    assert run(spark, tmp_path / "tasks", ROWS) == (done, lines, found)
    # The first file has no picture, and what hangs on its order has it.
    assert found["out/A/cover.jpg"] == b"in/a/1.mp3" and found["out/B/cover.jpg"] == b"in/b/1.mp3" and b"in/b/1.mp3" in found["out/B/same.mp3"]
    assert (done.failed, done.covers, done.quarantined, done.skipped) == (6, 2, 1, 1)


def test_the_driver_moves_nothing(spark, tmp_path, monkeypatch):
    library_to_move(tmp_path / "rows")
    library_to_move(tmp_path / "tasks")
    wanted, _ = cli.organise(spark, args(tmp_path / "rows", "--journal", str(tmp_path / "journal")), lambda line: None)
    refuse = lambda *_: pytest.fail("on the driver")
    monkeypatch.setattr(executor.shutil, "move", refuse)
    done, _ = cli.organise(spark, args(tmp_path / "tasks"), lambda line: None)
    assert done == wanted and state(tmp_path / "tasks") == state(tmp_path / "rows") and done.moved


def test_a_task_that_is_run_again_finds_its_files_moved(tmp_path):
    for k in range(3):
        make(tmp_path, f"in/{k}.mp3", picture(b"JPG"))
    rows = [{"path": str(tmp_path / f"in/{k}.mp3"), "no_meta": False, "outcome": "move", "final": str(tmp_path / f"out/{k}.mp3"), "error": None, "to": str(tmp_path / f"out/{k}.mp3"), "folder": str(tmp_path / "out")} for k in range(3)]
    carrier = executor.Carrier(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "dupes"), True, "/")
    stopped = carrier.carried(iter(rows), False)
    next(stopped), next(stopped)
    first, second = (list(carrier.carried(iter(rows), True)) for _ in range(2))
    assert first == second and [(r["moved"], r["failed"], r["pictured"]) for r in first] == [(1, 0, True), (1, 0, False), (1, 0, False)]
    giver = pa.RecordBatch.from_pylist([{c: first[0][c] for c in ("path", "folder", "to")}])
    assert [[b.to_pylist() for b in carrier.covered(iter([giver]))][0][0]["covers"] for _ in range(2)] == [1, 1]
    assert sorted(os.listdir(tmp_path / "out")) == ["0.mp3", "1.mp3", "2.mp3", "cover.jpg"] and not os.listdir(tmp_path / "in")


def test_between_file_systems_a_copy_is_whole(tmp_path, monkeypatch):
    a, b = make(tmp_path, "in/a.mp3"), tmp_path / "out/a.mp3"
    content, rename = a.read_bytes(), os.rename

    def other(path, to):
        if str(path) == str(a):
            raise OSError(executor.errno.EXDEV, "another file system")
        rename(path, to)

    monkeypatch.setattr(executor.os, "rename", other)
    executor.move_again(str(a), str(b))
    assert not a.exists() and b.read_bytes() == content and os.listdir(tmp_path / "out") == ["a.mp3"]
    c = make(tmp_path, "in/c.mp3")
    with pytest.raises(OSError, match="exists"):
        executor.move_again(str(c), str(b), True)
    assert c.exists()


def test_carried_out_reads_tags_once(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(fixtures, "apply", lambda planned, *_, **__: None)
    monkeypatch.setattr(fixtures, "plan", lambda files, listing, dest: seen.extend([plan_of(files), plan_of(listing)]))
    fixtures.carried_out(spark, sf)
    assert len(seen) == 2 and not any("_parse" in p for p in seen)
