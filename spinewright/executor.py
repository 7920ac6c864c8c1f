"""Carries a plan out.

Files are moved by tasks. A task that is run again finds moved what it had
moved, and a file is whole at one of its two places at any time. Moves that
hang on their order go one by one on the driver, and so does a run with a
journal: one that was stopped goes on where it was, since the plan is kept
beside a log of what is done; a plan made anew would see what had been moved and
decide otherwise.
"""

from __future__ import annotations

import errno
import filecmp
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.running import cut, release
from .sources import tags

QUARANTINE = {"duplicate": "DUPLICATE", "intra": "INTRA_DEDUP: duplicate copy in same edition", "cross": "BOOK_DEDUP: inferior edition"}


@dataclass
class Done:
    moved: int = 0
    skipped: int = 0
    quarantined: int = 0
    covers: int = 0
    failed: int = 0
    no_meta: int = 0


def safe(path: str, root: str) -> bool:
    """Whether a path stays within root: names that tags give may hold ``..``."""
    parts = os.path.relpath(path, root).split(os.sep)
    return ".." not in parts and not os.path.isabs(os.path.relpath(path, root))


def picture(path: str) -> bytes | None:
    """The first picture of a file."""
    with open(path, "rb") as f:
        return tags.read(f)[2]


def write_cover(source: str, folder: str, again: bool = False) -> bool:
    """Write the first picture of a file as cover.jpg unless there is one; again: one that is the same counts as written."""
    path = os.path.join(folder, "cover.jpg")
    if os.path.exists(path) and not again:
        return False
    found = picture(source)
    if not found:
        return False
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        if os.path.exists(path):
            with open(path, "rb") as f:
                return f.read() == found
        with open(part, "wb") as out:
            out.write(found)
        os.rename(part, path)
        return True
    except OSError:
        if os.path.exists(part):
            os.remove(part)
        return False


PLAN_COLUMNS = ("path", "no_meta", "outcome", "final", "error")


class Journal:
    """A plan and how far it is carried out, in a folder.

    The plan is there in whole or not at all. A line is written before a file is
    moved and one after, so that at most one move is in doubt when a run stops.
    """

    def __init__(self, folder: str):
        self.plan, self.log = os.path.join(folder, "plan.parquet"), os.path.join(folder, "done.jsonl")
        os.makedirs(folder, exist_ok=True)

    def exists(self) -> bool:
        """Whether a run was begun and not finished."""
        return os.path.exists(self.plan)

    def begin(self, rows: Iterator) -> None:
        schema = pa.schema([(c, pa.bool_() if c == "no_meta" else pa.string()) for c in PLAN_COLUMNS])
        with pq.ParquetWriter(self.plan + ".part", schema) as out:
            held: list[dict] = []
            for r in rows:
                held.append({c: r[c] for c in PLAN_COLUMNS})
                if len(held) == 10_000:
                    out.write_table(pa.Table.from_pylist(held, schema))
                    held = []
            out.write_table(pa.Table.from_pylist(held, schema))
        os.replace(self.plan + ".part", self.plan)

    def rows(self) -> Iterator[dict]:
        for batch in pq.ParquetFile(self.plan).iter_batches(10_000):
            yield from batch.to_pylist()

    def resume(self) -> tuple[int, Done, tuple[str, str] | None]:
        """How many rows are finished, what was done in them, and the move that was in doubt."""
        n, done, doubt = 0, Done(), None
        if os.path.exists(self.log):
            with open(self.log, encoding="utf-8") as f:
                for line in f:
                    if not line.endswith("\n"):  # the run stopped within it
                        break
                    r = json.loads(line)
                    if "to" in r:
                        doubt = r["path"], r["to"]
                    else:
                        n, done, doubt = r["row"], Done(**r["done"]), None
        return n, done, doubt

    def write(self, **row) -> None:
        with open(self.log, "a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")
            f.flush()
            os.fsync(f.fileno())

    def end(self) -> None:
        """The run is finished: a later one makes its own plan."""
        for path in (self.plan, self.log):
            if os.path.exists(path):
                os.remove(path)


def _settle(path: str, to: str) -> bool:
    """Whether a move in doubt had ended; what it had begun is undone if it hadn't."""
    if not os.path.exists(path):
        return os.path.exists(to)
    if os.path.exists(to):  # copied in part or whole, and the source still there
        os.remove(to)
    return False


def _move_once(path: str, to: str, journal: Journal | None, doubt: tuple[str, str] | None) -> None:
    if doubt == (path, to) and _settle(path, to):
        return
    if os.path.exists(to):
        raise OSError(f"{to} exists")
    os.makedirs(os.path.dirname(to), exist_ok=True)
    if journal:
        journal.write(path=path, to=to)
    shutil.move(path, to)


def move_again(path: str, to: str, again: bool = False) -> None:
    """Move a file, or find that another attempt of the task has; again: whether there was one before."""
    there = os.path.exists(to)
    if there and not os.path.lexists(path):
        return
    if there:
        # Between file systems an attempt can end when the copy is there and the source still is; on one it can't.
        if again and os.lstat(path).st_dev != os.lstat(to).st_dev and filecmp.cmp(path, to, shallow=False):
            os.remove(path)
            return
        raise OSError(f"{to} exists")
    os.makedirs(os.path.dirname(to), exist_ok=True)
    try:
        os.rename(path, to)
        return
    except FileNotFoundError as e:
        if os.path.exists(to):
            return
        raise FileNotFoundError(e.errno, e.strerror, path) from None
    except OSError as e:
        if e.errno != errno.EXDEV:
            raise
    part = f"{to}.{uuid.uuid4().hex}.part"
    try:
        shutil.copy2(path, part, follow_symlinks=False)
        os.rename(part, to)
    except OSError:
        if os.path.lexists(part):
            os.remove(part)
        raise
    os.remove(path)


def apply(plan: DataFrame | None, source: str, dest: str, dupes: str, dry_run: bool = True, covers: bool = True, log: Callable[[str], None] | None = None, journal: str | None = None) -> Done:
    """Carry the plan out. Nothing is ever overwritten, and the log has the order of paths.

    journal: a folder for what is needed to go on after a stop; a plan that is
    in there goes on, and plan isn't looked at. Rows then come one by one, in the
    order of paths, as they do in a dry run.
    """
    if not dry_run and not journal:
        return _by_tasks(plan, source, dest, dupes, covers, log)
    done, begun, doubt, kept = Done(), 0, None, None
    if journal and not dry_run:
        kept = Journal(journal)
        if kept.exists():
            begun, done, doubt = kept.resume()
        else:
            kept.begin(plan.select(*PLAN_COLUMNS).orderBy("path").toLocalIterator())
        rows = kept.rows()
    else:
        rows = plan.select(*PLAN_COLUMNS).orderBy("path").toLocalIterator()
    for n, r in enumerate(rows, 1):
        if n <= begun:
            continue
        _carry_out(r, done, source, dest, dupes, dry_run, covers, log or (lambda line: None), lambda path, to: _move_once(path, to, kept, doubt))
        doubt = None
        if kept:
            kept.write(row=n, done=asdict(done))
    if kept:
        kept.end()
    return done


def _target(r, source: str, dupes: str) -> str | None:
    """Where a row of a plan moves its file, if it does."""
    return os.path.join(dupes, os.path.relpath(r["path"], source)) if r["outcome"] in QUARANTINE else r["final"] if r["outcome"] == "move" else None


def _carry_out(r, done: Done, source: str, dest: str, dupes: str, dry_run: bool, covers: bool, log: Callable[[str], None], move: Callable[[str, str], None], cover: Callable[[str, str], bool] = write_cover) -> None:
    """One row of a plan."""
    path = r["path"]
    if r["outcome"] in ("in_place", "existing_duplicate"):
        done.skipped += 1
        return
    if r["outcome"] == "failed":
        log(f"ERROR processing {path}: {r['error']}")
        done.failed += 1
        return
    to = _target(r, source, dupes)
    if r["outcome"] in QUARANTINE:
        log(f"QUARANTINE ({QUARANTINE[r['outcome']]}): {path} -> {to}")
        done.quarantined += 1
    else:
        log(f"{'[DRY RUN] ' if dry_run else ''}{path} -> {to}")
        if not safe(to, dest):
            log(f"FAILED: {to} is outside {dest}")
            done.failed += 1
            return
        done.moved += dry_run
    if dry_run:
        return
    try:
        move(path, to)
        if r["outcome"] == "move":
            done.moved += 1
            done.no_meta += r["no_meta"]
            done.covers += covers and cover(to, os.path.dirname(to))
    except OSError as e:
        log(f"FAILED: {e}")
        done.failed += 1


_COUNTS = tuple(f.name for f in fields(Done))
_AIMED = "path string, no_meta boolean, outcome string, final string, error string, to string, folder string"
_CARRIED = pa.schema([("path", pa.string()), ("folder", pa.string()), ("to", pa.string()), ("pictured", pa.bool_()), ("lines", pa.list_(pa.string())), *((c, pa.int64()) for c in _COUNTS)])


@dataclass
class Carrier:
    """Paths of a run, and its rows carried out by tasks; relative paths are those of the driver."""

    source: str
    dest: str
    dupes: str
    covers: bool
    cwd: str

    def at(self, path: str) -> str:
        return os.path.join(self.cwd, path)

    def aimed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a plan with where they go, and the folder of that or, if they stay, of the file."""
        for batch in batches:
            to = [_target(r, self.source, self.dupes) for r in batch.to_pylist()]
            folder = [os.path.dirname(t or p) for t, p in zip(to, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.string()), pa.array(folder, pa.string())], names=[*PLAN_COLUMNS, "to", "folder"])

    def carried(self, rows: Iterator[dict], again: bool) -> Iterator[dict]:
        """Each row carried out but for its cover. pictured: that the file is the first here of its folder, which has no cover yet, to have a picture."""
        folder, sought = None, False
        for r in rows:
            if r["folder"] != folder:
                folder = r["folder"]
                sought = self.covers and not os.path.exists(os.path.join(self.at(folder), "cover.jpg"))
            done, lines, pictured = Done(), [], False
            if sought:

                def cover(to: str, _: str) -> bool:
                    nonlocal pictured
                    pictured = bool(picture(self.at(to)))
                    return False

            else:
                cover = lambda to, _: False
            _carry_out(r, done, self.source, self.dest, self.dupes, False, self.covers, lines.append, lambda path, to: move_again(self.at(path), self.at(to), again), cover)
            sought = sought and not pictured
            yield {"path": r["path"], "folder": folder, "to": r["to"], "pictured": pictured, "lines": lines, **asdict(done)}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        again = context is not None and context.attemptNumber() > 0
        held: list[dict] = []
        for row in self.carried((r for batch in batches for r in batch.to_pylist()), again):
            held.append(row)
            if len(held) == 2_000:
                yield pa.RecordBatch.from_pylist(held, _CARRIED)
                held = []
        yield pa.RecordBatch.from_pylist(held, _CARRIED)

    def covered(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(path, lines, covers, failed) of files (path, folder, to) that give their folder its cover."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                row = {"path": r["path"], "lines": [], "covers": 0, "failed": 0}
                try:
                    row["covers"] = int(write_cover(self.at(r["to"]), self.at(r["folder"]), True))
                except OSError as e:
                    row |= {"lines": [f"FAILED: {e}"], "failed": 1}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, pa.schema([_CARRIED.field(c) for c in ("path", "lines", "covers", "failed")]))


def _by_tasks(plan: DataFrame, source: str, dest: str, dupes: str, covers: bool, log: Callable[[str], None] | None) -> Done:
    """The same as row by row in the order of paths.

    The plan is written first, since made anew it would see what had been moved.
    Rows are dealt by ranges of folder and path, so that a folder of any size is
    spread over tasks; each finds the first of its files with a picture, and the
    first of these in the order of paths gives the cover, once all are moved.
    Rows of which one goes where another goes to or comes from, also by names in
    another case, hang on their order: the driver carries them out one by one.
    """
    spark, kept = plan.sparkSession, []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    carrier = Carrier(source, dest, dupes, covers, os.getcwd())
    rows = cut(plan.select(*PLAN_COLUMNS).mapInArrow(carrier.aimed, _AIMED), kept)
    places = rows.where(F.col("to").isNotNull()).select("path", F.explode(F.transform(F.array("to", "path"), lambda p: F.xxhash64(F.lower(p)))).alias("place"))
    shared = cut(places.groupBy("place").count().where("count > 1").select("place"), kept)
    tables = []
    schema = "path string, folder string, to string, pictured boolean, lines array<string>, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    if not shared.isEmpty():
        tangled = cut(places.join(shared, "place", "left_semi").select("path").distinct(), kept)
        ordered = cut(rows.join(tangled, "path", "left_semi"), kept)
        rows = rows.join(tangled, "path", "left_anti")
        held: list[dict] = []
        for row in carrier.carried((r.asDict() for r in ordered.orderBy("path").toLocalIterator()), False):
            held.append(row)
            if len(held) == 10_000:
                tables.append(cut(spark.createDataFrame(held, schema), kept))
                held = []
        if held:
            tables.append(cut(spark.createDataFrame(held, schema), kept))
    carried = cut(rows.repartitionByRange(parts, "folder", "path").sortWithinPartitions("folder", "path").mapInArrow(carrier, schema), kept)
    for table in tables:
        carried = carried.unionByName(table)
    first = carried.where("pictured").groupBy("folder").agg(F.min_by(F.struct("path", "to"), "path").alias("first")).select("first.path", "folder", "first.to")
    written = cut(first.repartition(parts).mapInArrow(carrier.covered, "path string, lines array<string>, covers bigint, failed bigint"), kept)
    done = Done(**{c: n or 0 for c, n in carried.agg(*(F.sum(c).alias(c) for c in _COUNTS)).first().asDict().items()})
    more = written.agg(F.sum("covers"), F.sum("failed")).first()
    done.covers += more[0] or 0
    done.failed += more[1] or 0
    if log:
        lines = carried.select("path", F.lit(0).alias("turn"), "lines").union(written.select("path", F.lit(1), "lines"))
        for r in lines.where(F.size("lines") > 0).orderBy("path", "turn").toLocalIterator():
            for line in r.lines:
                log(line)
    release(kept)
    return done
