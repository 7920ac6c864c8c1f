"""String functions and paths, as tables of rows."""

import pytest
from pyspark.sql import functions as F

from spinewright.functions import paths
from spinewright.functions import text as T


def values(spark, f, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "f, rows",
    [
        (T.leading_digits, {"3": "3", "03/12": "03", " 7": "7", "x1": "", "": "", "\xa012b": "12", "1.5": "1"}),
        (T.two_digits, {"1": "01", "007": "07", "12": "12", "123": "123", "0": "00"}),
        (T.sanitise, {"a/b\\c": "a∕b∕c", "What? \"Why\"": "What Why", " .hidden": "hidden", "...": "..", "a \t  b\xa0c": "a b c", "1:2*3<4>5|6": "1∶2∗3‹4›5│6", "é" * 200: "é" * 180}),
        (T.strip_track_prefix, {"01 - 02 - Intro": "Intro", "D01-T02 - X": "X", "1 - X": "1 - X", "101 - X": "101 - X", "22 -  22 - A": "A"}),
        (T.extension, {"a.MP3": "mp3", ".mp3": "", "a.": "", "a.b.m4b": "m4b", "..x.ogg": "ogg", "none": ""}),
        (T.stem, {"a.b.m4b": "a.b", ".mp3": ".mp3", "a": "a"}),
        (T.has_copy_suffix, {"b.2.m4b": True, "b.m4b": False, "b.2": False, "b.12.x": True}),
        (T.normalise_author, {"Émile ZOLA": "emile zola", "B, A; C": "a, b, c", "Stephen Fry - introductions; Arthur Doyle": "arthur doyle, stephen fry", "Jo (narrator)": "jo", "Łuk Ørst ß": "luk orst ss", "": "", " , ": ""}),
        (
            T.normalise_book,
            {
                "The Stand (Unabridged)": "stand", "Good Omens: The Nice Prophecies": "good omens", "Alan: Series 2 Extra": "alan series 2", "1982 - The Gunslinger": "1982 - the gunslinger", "A B": "a b", "An Ox": "ox", "Dune [B0743JTTWQ]": "dune", "Dune [1338589016]": "dune",
                "Saga - Part iv - End": "saga part iv", "X: y - Volume 3": "x volume 3", "It": "it", "": "",
            },
        ),
    ],
)
def test_strings(spark, f, rows):
    assert values(spark, f, list(rows)) == list(rows.values())


def test_formats(spark):
    lengths = {0.0: "0s", -1.0: "0s", 59.9: "59s", 61.0: "1m01s", 3600.0: "1h00m00s", 7325.5: "2h02m05s"}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "i int, x double")
    assert [r.y for r in df.select("i", T.format_duration(F.col("x")).alias("y")).orderBy("i").collect()] == list(lengths.values())
    rows = [("mp3", 128400, 44100, 2, 65.0), ("", 0, 0, 0, 5.0), ("aac", 0, 22050, 1, 0.0), ("", 0, 48000, 0, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, b bigint, s int, n int, d double")
    got = df.select("i", T.format_quality(*(F.col(c) for c in "cbsnd")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == ["MP3 128kbps 44.1kHz stereo, 1m05s", "5s", "AAC 22.05kHz mono, 0s", "48kHz, 1s"]


def test_inference(spark):
    pairs = {"A/B": ("A", "B"), "A/B/C": ("A", "B"), "A - B": ("A", "B"), "Book": ("", "Book"), "": ("", "")}
    a = values(spark, lambda x: F.struct(*(c.alias(n) for c, n in zip(paths.infer_from_path(x), "ab"))), list(pairs))
    assert [tuple(r) for r in a] == list(pairs.values())
    pairs = {"A - B.mp3": ("A", "B"), "01 - B.mp3": ("", "B"), "B.mp3": ("", ""), "A - B - 3.mp3": ("A", "B - 3")}
    a = values(spark, lambda x: F.struct(*(c.alias(n) for c, n in zip(paths.infer_from_filename(x), "ab"))), list(pairs))
    assert [tuple(r) for r in a] == list(pairs.values())


def test_resolve_and_destination(spark):
    rows = [
        ({"TPE2": " ", "Artist": "Ann\xa0", "ALBUM": "B: C", "trck": "3/9", "tpos": "2", "title": "One", "date": "2020-01-02", "series": "S", "movement": "1.5"}, "x/y", "f.MP3", "/out/Ann/S/01 - B∶ C/D02-T03 - One.mp3", False),
        ({"album": "Q", "series": "Q"}, "Au/Bo", "01 - 01 - Ch.m4b", "/out/Au/Q/Q.m4b", True),
        ({}, "", "07 - Name.ogg", "/out/_Unknown Author/Name/Name.ogg", True),
        ({"trkn": "5"}, "", "x.mp3", "/out/_Unknown Author/_Unknown Book/05 - x.mp3", True),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, tags map<string,string>, folder string, name string").withColumn("tags", paths.lower_keys(F.col("tags")))
    df = df.withColumns(paths.resolve(F.col("tags")))
    out = df.withColumns(paths.build_destination({f: F.col(f) for f in paths.FIELDS}, F.col("folder"), F.col("name"), F.lit("/out"))).orderBy("i").collect()
    assert [(r.dest_file, r.no_meta) for r in out] == [r[3:] for r in rows]
    assert (out[0].year, out[0].series_index, out[1].series) == ("2020", "1", "")


def test_keys_of_odd_names(spark):
    """Keys follow the rule for white space, digits and separators beyond ASCII, and for null."""
    authors = {"A\x1cB ; C": "a b, c", "É – Narrators x; b": "b, e", "(x": "(x", None: "", "ß;ſ": "s, ss", ",;": ""}
    assert values(spark, T.normalise_author, list(authors)) == list(authors.values())
    books = {"١٢٣: Tale": "١٢٣: tale", "Ab: Tale": "ab: tale", "X - Tale: Vol  ２　end": "x vol 2", "Abc: d - e": "abc", "the  ": "the", "The \n A": "a", "Q: a: part x": "q part x", None: "", "[ABCDEFGHIJ": "[abcdefghij"}
    assert values(spark, T.normalise_book, list(books)) == list(books.values())


def test_safe_texts_are_sanitised_as_others(spark):
    rows = {"a b": "a b", "a  b": "a b", " a": "a", "a.": "a.", ".a": "a", "a\n": "a", "x" * 181: "x" * 180, "": "", "a|b": "a│b", "~!": "~!", "a\\b": "a∕b"}
    assert values(spark, T.sanitise, list(rows)) == list(rows.values())
    bare = {"a b": "a b", "\x1fa\xa0": "a", "é ": "é", " ": "", "": "", "a ": "a"}
    assert values(spark, T.strip, list(bare)) == list(bare.values())
