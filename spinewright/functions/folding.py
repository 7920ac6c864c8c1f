"""Folding of case and accents, and the keys made of what is folded, for workers: nothing here needs a session."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd

from ..fixed import CATALOGUE_ID, LETTERS, NUMERIC_ID, PARENTHESES, ROLES, VOLUME

_LETTERS = str.maketrans(LETTERS)
_ROLES, _PARENTHESES, _CATALOGUE_ID, _NUMERIC_ID = (re.compile(p, f) for p, f in ((ROLES, re.I), (PARENTHESES, 0), (CATALOGUE_ID, re.I), (NUMERIC_ID, 0)))
_VOLUME = re.compile(VOLUME + ".*", re.I | re.S)
_SPACES, _DIGITS, _ARTICLE = re.compile(r"\s+"), re.compile(r"\d+"), re.compile(r"\A(?:the |a |an )(?=..)", re.S)
#: Keys that a worker keeps in mind: files of one book come with the same names again and again.
_REMEMBERED = 1 << 15


def strip_text(x: str) -> str:
    """Marks dropped after compatibility decomposition, the letters that don't decompose spelt out."""
    return x if x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c)[0] != "M").translate(_LETTERS)


def fold_text(x: str) -> str:
    """Case folded, then strip_text."""
    return strip_text(x.casefold())


def _collapse(x: str) -> str:
    return _SPACES.sub(" ", x).strip(" ")


@functools.lru_cache(_REMEMBERED)
def author_key(x: str) -> str:
    """The grouping key of an author: folded, roles and parentheses gone, names sorted."""
    s = _PARENTHESES.sub("", _ROLES.sub("", fold_text(x).replace(";", ",")))
    return _collapse(", ".join(sorted(filter(None, map(str.strip, s.split(","))))))


@functools.lru_cache(_REMEMBERED)
def book_key(x: str) -> str:
    """The grouping key of a title: folded, ids, parentheses, subtitle and leading article gone, volumes kept.

    A volume behind a separator stays as a mark of its own; a subtitle goes and ends the search.
    """
    s = fold_text(x)
    for gone in (_CATALOGUE_ID, _NUMERIC_ID, _PARENTHESES):
        s = gone.sub("", s)
    for sep in (":", " - "):
        before, found, after = s.partition(sep)
        if not found:
            continue
        before, volume = before.strip(), _VOLUME.search(after.strip())
        if volume:
            s = before + " " + " ".join(volume[0].split()[:2])
        elif len(before) >= 3 and not _DIGITS.fullmatch(before):
            s = before
            break
    return _collapse(_ARTICLE.sub("", s, count=1))


def author_keys(x: pd.Series) -> pd.Series:
    return x.map(author_key, na_action="ignore")


def book_keys(x: pd.Series) -> pd.Series:
    return x.map(book_key, na_action="ignore")


def strip_series(x: pd.Series) -> pd.Series:
    return x.map(strip_text, na_action="ignore")


def author_key_arrays(x: pd.Series) -> pd.Series:
    return x.map(lambda a: [author_key(s) for s in a], na_action="ignore")
