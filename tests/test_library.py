"""Files with tags made here, read and organised."""

import base64
import io
import os
import struct

import pytest

from spinewright import cli, executor, report
from spinewright.sources import files, tags

FRAMES = (bytes.fromhex("fffb9000") + bytes(413)) * 5


def text_frame(name, text):
    raw = b"\x03" + text.encode()
    return name.encode() + struct.pack(">I", len(raw)) + b"\0\0" + raw


def id3(*frames):
    body = b"".join(frames)
    n = len(body)
    return b"ID3\x03\0\0" + bytes(n >> s & 0x7F for s in (21, 14, 7, 0)) + body


def picture(data):
    raw = b"\0image/jpeg\0\x03\0" + data
    return b"APIC" + struct.pack(">I", len(raw)) + b"\0\0" + raw


def comments(**own):
    items = [f"{k}={v}".encode() for k, v in own.items()]
    return struct.pack("<I", 1) + b"x" + struct.pack("<I", len(items)) + b"".join(struct.pack("<I", len(i)) + i for i in items)


def atom(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + name + body


def test_mp3():
    got, info, cover = tags.read(io.BytesIO(id3(text_frame("TPE1", "Ann"), text_frame("TXXX", "SERIES\0Saga"), text_frame("TYER", "2001"), picture(b"JPG")) + FRAMES))
    assert got == {"tpe1": "Ann", "txxx:series": "Saga", "tdrc": "2001"} and cover == b"JPG"
    assert (info["bitrate"], info["codec"], info["sample_rate"], info["channels"]) == (128000, "mp3", 44100, 2) and abs(info["duration"] - 5 * 417 * 8 / 128000) < 1e-9
    assert tags.read(io.BytesIO(b"not sound"))[0:2] == ({}, tags.info())


def test_flac_and_ogg():
    stream = (44100 << 44 | 1 << 41 | 15 << 36 | 88200).to_bytes(8, "big")
    b = b"fLaC" + b"\0\0\0\x22" + bytes(10) + stream + bytes(16) + b"\x84" + len(c := comments(ALBUM="B", Artist="A")).to_bytes(3, "big") + c + bytes(1000)
    got, info, _ = tags.read(io.BytesIO(b))
    assert got == {"album": "B", "artist": "A"} and (info["duration"], info["channels"], info["bitrate"]) == (2.0, 2, 4000)
    first, second = b"OpusHead\x01\x02" + struct.pack("<HIHB", 312, 48000, 0, 0), b"OpusTags" + comments(title="T")
    page = lambda p, g: b"OggS\0\0" + struct.pack("<qIII", g, 1, 0, 0) + bytes([1, len(p)]) + p
    got, info, _ = tags.read(io.BytesIO(page(first, 0) + page(second, 48312)))
    assert got == {"title": "T"} and (info["codec"], info["duration"], info["channels"]) == ("opus", 1.0, 2)


def test_mp4():
    data = lambda kind, raw: atom(b"data", struct.pack(">II", kind, 0), raw)
    free = atom(b"----", atom(b"mean", bytes(4), b"com.x"), atom(b"name", bytes(4), b"SERIES"), data(1, b"S"))
    ilst = atom(b"ilst", atom(b"\xa9alb", data(1, b"Book")), atom(b"aART", data(1, b"Ann")), atom(b"trkn", data(0, struct.pack(">HHHH", 0, 3, 9, 0))), free, atom(b"covr", data(13, b"IMG")))
    entry = atom(b"mp4a", bytes(16), struct.pack(">HH", 2, 16), bytes(4), struct.pack(">HH", 44100, 0), atom(b"esds", bytes(4), b"\x03\x19\0\0\0\x04\x11\x40\x15\0\0\0", struct.pack(">II", 0, 64000)))
    trak = atom(b"trak", atom(b"mdia", atom(b"mdhd", bytes(12), struct.pack(">II", 1000, 5500), bytes(4)), atom(b"hdlr", bytes(8), b"soun", bytes(12)), atom(b"minf", atom(b"stbl", atom(b"stsd", bytes(8), entry)))))
    b = atom(b"ftyp", b"M4B ") + atom(b"mdat", bytes(50)) + atom(b"moov", trak, atom(b"udta", atom(b"meta", bytes(4), ilst)))
    got, info, cover = tags.read(io.BytesIO(b))
    assert got == {"album": "Book", "album_artist": "Ann", "trkn": "3", "txxx:series": "S"} and cover == b"IMG"
    assert info == {"bitrate": 64000, "duration": 5.5, "codec": "aac", "sample_rate": 44100, "channels": 2}


def wide(text):
    return text.encode("utf-16-le") + b"\0\0"


def test_asf():
    part = lambda kind, body: bytes.fromhex(kind) + struct.pack("<Q", len(body) + 24) + body
    title, author = wide("One"), wide("Ann")
    content = struct.pack("<5H", len(title), len(author), 0, 0, 0) + title + author
    name, album, series, n = wide("WM/AlbumTitle"), wide("Book"), wide("SERIES"), struct.pack("<I", 3)
    extended = struct.pack("<H", 2) + b"".join(struct.pack("<H", len(k)) + k + struct.pack("<HH", form, len(v)) + v for k, form, v in ((name, 0, album), (series, 3, n)))
    properties = bytes(40) + struct.pack("<QQQ", 130_000_000, 0, 3000) + bytes(16)
    stream = bytes.fromhex("409e69f84d5bcf11a8fd00805f5c442b") + bytes(38) + struct.pack("<HHII", 0x161, 2, 44100, 8000) + bytes(8)
    body = part("3326b2758e66cf11a6d900aa0062ce6c", content) + part("40a4d0d207e3d21197f000a0c95ea850", extended) + part("a1dcab8c47a9cf118ee400c00c205365", properties) + part("9107dcb7b7a9cf118ee600c00c205365", stream)
    head = bytes.fromhex("3026b2758e66cf11a6d900aa0062ce6c") + struct.pack("<QIBB", len(body) + 30, 4, 1, 2)
    got, info, cover = tags.read(io.BytesIO(head + body))
    assert got["title"] == "One" and got["album"] == "Book" and "Ann" in got.values() and "3" in got.values() and cover is None
    assert info == {"bitrate": 64000, "duration": 10.0, "codec": "wma", "sample_rate": 44100, "channels": 2}
    assert tags.read(io.BytesIO(head[:20]))[0] == {}


def test_wav_and_aiff():
    own = id3(text_frame("TIT2", "T"), picture(b"JPG"))
    chunk = lambda end, name, body: name + struct.pack(end + "I", len(body)) + body + bytes(len(body) & 1)
    wav = chunk("<", b"fmt ", struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)) + chunk("<", b"data", bytes(64000)) + chunk("<", b"id3 ", own)
    got, info, cover = tags.read(io.BytesIO(b"RIFF" + struct.pack("<I", len(wav) + 4) + b"WAVE" + wav))
    assert got == {"tit2": "T"} and cover == b"JPG" and (info["duration"], info["bitrate"], info["channels"], info["sample_rate"]) == (2.0, 256000, 2, 8000)
    hz = struct.pack(">HQ", 16383 + 15, 44100 << 48)  # 80 bits: an exponent of 15, and the mantissa with its highest bit set
    aiff = chunk(">", b"COMM", struct.pack(">HIH", 1, 88200, 16) + hz) + chunk(">", b"SSND", bytes(11)) + chunk(">", b"ID3 ", own)
    got, info, cover = tags.read(io.BytesIO(b"FORM" + struct.pack(">I", len(aiff) + 4) + b"AIFF" + aiff))
    assert got == {"tit2": "T"} and cover == b"JPG" and (info["duration"], info["sample_rate"], info["bitrate"]) == (2.0, 44100, 705600)


def test_ape():
    item = lambda k, v, flags=0: struct.pack("<II", len(v), flags) + k + b"\0" + v
    body = item(b"Title", "Öne".encode()) + item(b"Artist", b"Ann\0Bob") + item(b"Cover Art (Front)", b"\xff\xd8", 2)
    foot = b"APETAGEX" + struct.pack("<IIII", 2000, len(body) + 32, 3, 0) + bytes(8)
    assert tags.read(io.BytesIO(b"MAC \x96\x0f" + bytes(100) + body + foot))[0] == {"title": "Öne", "artist": "Ann"}
    assert tags.read(io.BytesIO(b"MAC \x96\x0f" + bytes(100)))[0] == {}


def test_pictures_of_flac_and_vorbis():
    image = struct.pack(">II", 3, 10) + b"image/jpeg" + struct.pack(">I", 4) + b"name" + bytes(16) + struct.pack(">I", 3) + b"IMG"
    block = lambda kind, b: bytes([kind]) + len(b).to_bytes(3, "big") + b
    assert tags.read(io.BytesIO(b"fLaC" + block(0, bytes(34)) + block(6, image) + block(0x84, comments(TITLE="T"))))[::2] == ({"title": "T"}, b"IMG")
    first = b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 2, 44100, 0, 96000, 0, 0xB8, 1)
    page = lambda p, g: b"OggS\0\0" + struct.pack("<qIII", g, 1, 0, 0) + bytes([len(p) // 255 + 1]) + b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) + p
    read = lambda picture: tags.read(io.BytesIO(page(first, 0) + page(b"\x03vorbis" + comments(title="T", metadata_block_picture=picture), 88200)))
    got, info, cover = read(base64.b64encode(image).decode())
    assert cover == b"IMG" and got["title"] == "T" and (info["codec"], info["duration"], info["bitrate"], info["channels"]) == ("vorbis", 2.0, 96000, 2)
    assert read("not base64!")[2] is None


def make(root, path, *frames, extra=b""):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(id3(*frames) + FRAMES + extra)
    return p


def test_hidden_names_are_read(spark, tmp_path):
    for p in ("_Unknown Author/a.mp3", ".hid/4.MP3", ".3.mp3", "x/y/z.txt"):
        make(tmp_path, p, text_frame("TIT2", p))
    got = {r.path.removeprefix(str(tmp_path) + "/"): r for r in files.read_library(spark, str(tmp_path), 2).collect()}
    assert set(got) == {"_Unknown Author/a.mp3", ".hid/4.MP3", ".3.mp3"}
    r = got["_Unknown Author/a.mp3"]
    assert (r.folder, r.title, r.codec) == ("_Unknown Author", "_Unknown Author/a.mp3", "mp3") and r.fp.startswith(f"{r.size}:")


def test_only_files_of_equal_size_are_opened(spark, tmp_path):
    paths = [make(tmp_path, p, text_frame("TIT2", "t")) for p in ("a.mp3", "b.mp3", "c.mp3")]
    size = paths[0].stat().st_size
    claimed = spark.createDataFrame([(str(paths[0]), size), (str(paths[1]), size + 1)], "dest_file string, size bigint")
    got = {r.dest: r.disk_fp for r in files.read_listing(spark, str(tmp_path), claimed).collect()}
    assert got == {str(paths[0]): files.fingerprint(str(paths[0])), str(paths[1]): f"{size}:", str(paths[2]): f"{size}:"}
    assert files.read_listing(spark, str(tmp_path / "none"), claimed).count() == 0
    assert files.read_listing(spark, str(tmp_path / "none")).count() == 0


def test_a_live_run_moves_and_a_dry_one_does_not(spark, tmp_path):
    src = tmp_path / "in"
    book = lambda *more: (text_frame("TPE1", "Ann"), text_frame("TALB", "Book"), text_frame("TIT2", "One"), *more)
    make(src, "p/1.mp3", *book(picture(b"JPG")))
    make(src, "p/2.mp3", *book(picture(b"JPG")))
    make(src, "p/3.mp3", *book(), extra=b"other")
    make(src, "q/evil.mp3", text_frame("TPE1", "..."), text_frame("TALB", "..."), text_frame("TIT2", "up"))
    own = ["--source", str(src), "--dest", str(tmp_path / "out"), "--dupes", str(tmp_path / "dupes")]
    lines = []
    done, counts = cli.organise(spark, cli.parse(own), lines.append)
    assert not (tmp_path / "out").exists() and (counts.moved, counts.dupe, counts.conflict) == (3, 1, 1)
    done, _ = cli.organise(spark, cli.parse([*own, "--move"]), lines.append)
    assert (done.moved, done.quarantined, done.covers, done.failed) == (2, 1, 1, 1)
    out = tmp_path / "out/Ann/Book"
    assert sorted(p.name for p in out.iterdir()) == ["One.2.mp3", "One.mp3", "cover.jpg"] and (tmp_path / "dupes/p/2.mp3").exists() and (src / "q/evil.mp3").exists()
    assert cli.parse(["--book-dedup"]).book_dedup and cli.parse([]).dry_run


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_opened_for_columns_and_rows_that_need_it(spark, tmp_path):
    make(tmp_path, "a/1.mp3", text_frame("TIT2", "One"), picture(b"JPG"))
    make(tmp_path, "b/2.flac")
    lib = files.read_library(spark, str(tmp_path), 2)
    assert "ArrowEvalPython" not in plan_of(lib.select("path", "size", "ext", "folder")) and "ArrowEvalPython" in plan_of(lib.select("title"))
    # Filters on what a listing knows come before files are opened.
    plan = plan_of(lib.where("ext = 'mp3'").select("title"))
    assert plan.index("ArrowEvalPython") < plan.index("Filter")
    assert [(r.title, bytes(r.cover)) for r in lib.where("ext = 'mp3'").select("title", "cover").collect()] == [("One", b"JPG")]
    uri = files.read_library(spark, f"file://{tmp_path}", 2).select("path", "folder", "title", "fp").orderBy("path").collect()
    own = lib.select("path", "folder", "title", "fp").orderBy("path").collect()
    assert [(r.path, r.folder, r.title, r.fp) for r in uri] == [(f"file://{r.path}", r.folder, r.title, r.fp) for r in own]


def test_folders_are_listed_level_by_level(spark, tmp_path):
    paths = [f"{a}/{b}/{c}.mp3" for a in "xyz" for b in ("", "q", "q/r/s") for c in "12"]
    for p in paths:
        make(tmp_path, p)
    (tmp_path / "x/link").symlink_to(tmp_path / "y")
    (tmp_path / "x/gone.mp3").symlink_to(tmp_path / "nowhere")
    got = {r.path.removeprefix(str(tmp_path) + "/") for r in files.list_files(spark, str(tmp_path)).collect()}
    assert got == {p.replace("//", "/") for p in paths} | {"x/gone.mp3"}


def noting(log):
    """A hasher that writes down what it opens; workers get it by value."""

    def note(path, log=str(log)):
        with open(log, "a") as f:
            f.write(path + "\n")
        return files.fingerprint(path)

    return note


def test_only_rivals_are_hashed(spark, tmp_path):
    names = {n: make(tmp_path / "in", f"{n}.mp3", text_frame("TIT2", n[0]), extra=b"+" * more) for n, more in (("a1", 0), ("a2", 0), ("b", 0), ("c", 9), ("d", 0))}
    there = make(tmp_path / "out", "x/d.mp3", text_frame("TIT2", "d"))
    make(tmp_path / "out", "unclaimed/e.mp3")
    rows = [(str(p), str(tmp_path / "out/x" / f"{'a' if n in ('a1', 'a2', 'c') else n}.mp3"), p.stat().st_size, None) for n, p in names.items()]
    placed = spark.createDataFrame(rows, "path string, dest_file string, size bigint, error string")
    listing = files.list_claimed(spark, str(tmp_path / "out"), placed)
    assert [r.dest for r in listing.collect()] == [str(there)]
    got = {r.path: r.fp for r in files.fingerprinted(placed, listing, noting(tmp_path / "log")).collect()}
    opened = set((tmp_path / "log").read_text().split())
    # b wants a name of its own, and c has another size: neither is opened.
    assert opened == {str(names[n]) for n in ("a1", "a2", "d")}
    assert all(got[str(p)] == (files.fingerprint(str(p)) if n in ("a1", "a2", "d") else f"{p.stat().st_size}:") for n, p in names.items())
    assert [(r.dest, r.disk_fp) for r in files.met(listing, placed, noting(tmp_path / "there")).collect()] == [(str(there), files.fingerprint(str(there)))]


def library_to_move(root):
    book = lambda title, *more: (text_frame("TPE1", "Ann"), text_frame("TALB", "Book"), text_frame("TIT2", title), *more)
    for k in range(8):
        make(root / "in", f"p/{k}.mp3", *book(f"T{k % 3}"), extra=b"x" * (k % 4))
    (root / "in/p/broken.mp3").symlink_to(root / "nowhere")


def state(root):
    return {str(p.relative_to(root)): p.read_bytes() for folder in ("in", "out", "dupes") for p in sorted((root / folder).rglob("*")) if p.is_file()}


def args(root, *more):
    return cli.parse(["--source", str(root / "in"), "--dest", str(root / "out"), "--dupes", str(root / "dupes"), "--move", *more])


def test_a_file_that_cannot_be_read_fails_and_the_run_goes_on(spark, tmp_path):
    library_to_move(tmp_path)
    lines = []
    done, counts = cli.organise(spark, args(tmp_path), lines.append)
    assert (done.failed, counts.failed, counts.files) == (1, 1, 9) and done.moved + done.quarantined == 8
    assert any(x.startswith(f"ERROR processing {tmp_path}/in/p/broken.mp3: ") for x in lines) and "  Failed        : 1" in lines


class Stop(BaseException):
    pass


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    whole, parts = tmp_path / "whole", tmp_path / "parts"
    for root in (whole, parts):
        library_to_move(root)
    wanted, _ = cli.organise(spark, args(whole), lambda line: None)
    move, moves = executor.shutil.move, []

    def stopping(path, to):
        moves.append(path)
        if len(moves) in (3, 6):  # within a move, once before and once after the source has gone
            executor.shutil.copy(path, to)
            if len(moves) == 6:
                os.remove(path)
            raise Stop
        return move(path, to)

    monkeypatch.setattr(executor.shutil, "move", stopping)
    journal = str(tmp_path / "journal")
    for _ in range(2):
        with pytest.raises(Stop):
            cli.organise(spark, args(parts, "--journal", journal), lambda line: None)
    done, _ = cli.organise(spark, args(parts, "--journal", journal), lambda line: None)
    assert state(parts) == state(whole) and done == wanted
    assert not executor.Journal(journal).exists()


def test_colours_are_for_terminals(tmp_path, capsys):
    log = report.Log(str(tmp_path / "sub/run.log"))
    log("FAILED: x")
    log.colours = True
    log('  "B" by A\n    KEEP:       x\n    QUARANTINE: y')
    log.close()
    assert capsys.readouterr().out == 'FAILED: x\n  "B" by A\n\x1b[32m    KEEP:       x\x1b[0m\n\x1b[35m    QUARANTINE: y\x1b[0m\n'
    assert "\x1b" not in (tmp_path / "sub/run.log").read_text()


def test_headings_count_what_follows(spark, tmp_path):
    book = (text_frame("TPE1", "Ann"), text_frame("TALB", "Book"))
    for p in ("e1/a.mp3", "e1/a.2.mp3", "e1/a.3.mp3", "e2/b.mp3"):
        make(tmp_path / "in", p, *book)
    lines = []
    own = ["--source", str(tmp_path / "in"), "--dest", str(tmp_path / "out"), "--dupes", str(tmp_path / "dupes"), "--book-dedup"]
    _, counts = cli.organise(spark, cli.parse(own), lines.append)
    assert "INTRA-EDITION DEDUP: 2 duplicate file(s) in 1 edition(s)" in lines and "BOOK-LEVEL DEDUP: 1 book(s) with multiple editions" in lines
    assert (counts.intra_dedup, counts.book_dedup, counts.book_dedup_groups) == (2, 1, 1)
    assert "  Skipped       : 0 (already in place)" in lines and "  Book dedup    : 1 groups resolved, 1 files (would quarantine)" in lines
