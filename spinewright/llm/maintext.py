"""The main text of web pages: markup says what can be text, and a suffix array over each host's pages what repeats.

1. A page's markup is read once. Elements for menus, page headers, footers,
   sidebars, notices, adverts, forms, scripts and comments are left out, by their
   names, roles and the words of their class and id. Of the rest, what is inside
   the article's element counts, if there is one.
2. Pages are dealt by host, and those of a host with much text by a hash into
   groups of about GROUP_BYTES, so that no host needs one task. The words of a
   group's pages, with a mark at each block, are put one after another. Its
   suffixes are sorted by their first RUN tokens, by doubling; suffixes that
   agree so far are neighbours, and the pages that they come from are counted.
3. Words covered by runs that lie on a share of the host's pages are removed,
   and the unique runs are kept. Inside an article's element, where passages may
   be quoted or whole articles copied, the share is higher.

A run on a share of a host's pages is on that share of the pages of one of its
groups at least. So the groups of a large host first name the runs that are on
the share of their own pages; all of its groups then count those, and the sums
tell which are removed. The result is the same however pages are grouped.

The suffix array alone can't tell an advert that each page has anew from the
article, nor a copied article from a notice; that is what the markup is for.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import bounded, written

#: Tokens of a run; pages (least, share of the group's) that a run must be on outside an article's element and inside one.
RUN, OUTSIDE, INSIDE = 6, (3, 0.5), (10, 0.8)
#: Bytes of html in a group of a host's pages; what a group is hangs on it, and no result does.
GROUP_BYTES = 16 << 20
#: Hosts of more than one group that may be sent to all tasks, a name and a number each.
FEW_HOSTS = 20_000

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What these hold isn't markup, or isn't text.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg canvas video audio object select button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and roles that hold no article, and words in a class or id that say so.
LEFT_OUT = frozenset("nav aside footer form menu dialog search".split())
LEFT_OUT_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
LEFT_OUT_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer sidebar aside widget widgets ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay comment comments commentlist reply replies respond disqus form login signup subscribe subscription newsletter share sharing "
    "social related recommended recommendations pagination pager toolbar copyright skip hidden".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: Words beside which the others only describe a layout.
LAYOUT_WORDS = frozenset("with has no without".split())
ARTICLE_NAMES = frozenset("article articlebody article-body article-content article-text post post-body post-content entry entry-content story story-body content main main-content maincontent page-content body-content".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_END = re.compile(r"(?>=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+))")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in RAW}
#: An element's end that may be missing before the start of another.
_ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: How far inside an article text is: not at all, by a name, by an element.
NOT_INSIDE, BY_NAME, BY_ELEMENT = 0, 1, 2
#: Why text is left out: it isn't; by a word or a form, so that an article inside is text again; by an element or as comments.
TEXT, WEAK, STRONG = 0, 1, 2


def _judged(name: str, attributes: str, inside: int, out: int) -> tuple[int, int]:
    """Whether the text of an element is inside an article and left out, from those of the element around it."""
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    role = found.get("role", "").lower()
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    words = {w.lower() for w in _WORDS.findall(" ".join(names))}
    comments = bool(words & COMMENT_WORDS) and not words & LAYOUT_WORDS
    element = (name in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articleBody") and not comments
    if element and out < STRONG:
        return BY_ELEMENT, TEXT
    if out:
        return inside, STRONG if comments else out
    if comments or name in LEFT_OUT - {"form"} or role in LEFT_OUT_ROLES - {"form"} or (name == "header" and not inside):
        return inside, STRONG
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
    if name in ("form", "fieldset") or role == "form" or hidden or re.search(r"\shidden(?=[\s/>]|$)", _ATTRIBUTE.sub(" ", attributes)):
        return inside, WEAK
    if words & LEFT_OUT_WORDS and not words & LAYOUT_WORDS or ("header" in words and not inside):
        return inside, WEAK
    if not inside and any(n.lower() in ARTICLE_NAMES for n in names):
        return BY_NAME, TEXT
    return inside, out


def blocks(page: str) -> tuple[int, list[str]]:
    """How the article is known and its blocks, in page order, with white space as single blanks."""
    kept: tuple[list[str], list[str], list[str]] = ([], [], [])
    stack: list[tuple[str, int, int]] = []
    opened: Counter = Counter()
    inside, out, parts = NOT_INSIDE, TEXT, []
    at, n = 0, len(page)

    def ended() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                kept[inside].append(text)
            parts.clear()

    def pop() -> None:
        nonlocal inside, out
        opened[stack.pop()[0]] -= 1
        inside, out = stack[-1][1:] if stack else (NOT_INSIDE, TEXT)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at and not out:
            parts.append(page[at:start])
        if start == n:
            break
        m = _NAME.match(page, start)
        if m is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = n if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), start):
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:
                if not out:
                    parts.append("<")
                at = start + 1
            continue
        name, closing = m[1].lower(), page[start + 1] == "/"
        tail = _END.match(page, m.end())
        at = tail.end() if tail else n
        attributes = page[m.end() : at]
        if not closing and name in RAW:
            end = _CLOSE[name].search(page, at)
            if end is None:
                at = n
            else:
                close = page.find(">", end.end())
                at = n if close < 0 else close + 1
        elif name == "br":
            if not out:
                parts.append(" ")
        elif name in BLOCKS:
            ended()
            if name in ("html", "head", "hr"):
                continue
            if name == "body":
                while stack and not closing:
                    pop()
                continue
            if closing:
                if opened[name] > 0:
                    while stack[-1][0] != name:
                        pop()
                    pop()
                continue
            if stack and stack[-1][0] == "p":
                pop()
            while stack and stack[-1][0] in _ENDED_BY.get(name, ()):
                pop()
            inside, out = _judged(name, attributes, inside, out)
            stack.append((name, inside, out))
            opened[name] += 1
        elif name in ("span", "a", "ins"):
            if closing:
                if stack and stack[-1][0] == name:
                    ended()
                    pop()
            elif "class" in attributes or "id" in attributes or "hidden" in attributes:
                got = _judged(name, attributes, inside, out)
                if got[1] and not out:  # only what is left out has a border here
                    ended()
                    inside, out = got
                    stack.append((name, inside, out))
                    opened[name] += 1
    ended()
    level = max((k for k in range(3) if kept[k]), default=0)
    return level, kept[level]


class Parse:
    """The level and blocks, one a line, of each page; other columns are passed on."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(page.as_py() or "") for page in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array([x for x, _ in found], pa.int32()), pa.array(["\n".join(x) for _, x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "level", "text"])
        K.tidy()


def ranked_suffixes(token: np.ndarray, run: int) -> np.ndarray:
    """The rank of each place's suffix by its first run tokens; the places past the end are lower than all."""
    rank, depth = np.unique(token, return_inverse=True)[1].astype(np.int64) + 1, 1
    while depth < run:
        step = min(depth, run - depth)
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    return rank


def repeated(page: np.ndarray, token: np.ndarray, need: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which tokens lie in a run that is on at least as many pages as their page needs.

    page: the page of each token, in order; need: of each page.
    """
    out = np.zeros(len(token), bool)
    n = len(token) - run + 1
    if n <= 0:
        return out
    rank = ranked_suffixes(token, run)[:n]
    whole = page[:n] == page[run - 1 :]
    both = np.unique(rank[whole] * (int(page[-1]) + 1) + page[:n][whole]) // (int(page[-1]) + 1)
    pages = np.bincount(both, minlength=int(rank.max()) + 1)
    hit = np.flatnonzero(whole & (pages[rank] >= need[page[:n]]))
    edge = np.zeros(len(token) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + run, -1)
    return np.cumsum(edge[:-1]) > 0


def need(pages: int, bound: tuple[int, float]) -> int:
    """On how many of a host's pages a run must be to be removed."""
    return max(bound[0], int(np.ceil(bound[1] * pages)))


class GroupText:
    """The tokens of a group's pages: words by number, and a mark before each block's first."""

    def __init__(self, text: pa.Array):
        data, offsets = K.column_bytes(text)
        self.data = np.ascontiguousarray(data)
        self.starts, self.ends, self.bounds = K.segments((self.data != 0x20) & (self.data != 0x0A), offsets)
        code, self.words = K.codes(self.data, self.starts, self.ends)
        page = K.owner(self.bounds)
        fresh = np.ones(len(self.starts), bool)
        fresh[1:] = (self.data[self.starts[1:] - 1] == 0x0A) | (page[1:] != page[:-1])
        self.place = np.arange(len(self.starts)) + np.cumsum(fresh)
        self.token, self.page = np.zeros(len(self.starts) + int(fresh.sum()), np.int64), np.empty(len(self.starts) + int(fresh.sum()), np.int64)
        self.token[self.place], self.page[self.place] = code + 1, page
        self.page[self.place[fresh] - 1] = page[fresh]

    def whole(self, run: int) -> np.ndarray:
        """The places where a run begins that is within a page."""
        n = max(len(self.token) - run + 1, 0)
        return np.flatnonzero(self.page[:n] == self.page[run - 1 :][:n])

    def pages_with(self, kind: np.ndarray, at: np.ndarray) -> np.ndarray:
        """On how many pages each of the kinds of runs, given for places, is."""
        width = len(self.bounds)
        return np.bincount(np.unique(kind * width + self.page[at]) // width)

    def frequent(self, run: int, share: float) -> list[bytes]:
        """The runs that are on a share of the pages, by their words, each with a blank behind it; a line feed is a mark."""
        at = self.whole(run)
        if not len(at):
            return []
        _, first, kind = np.unique(ranked_suffixes(self.token, run)[at], return_index=True, return_inverse=True)
        often = at[first[self.pages_with(kind, at) >= share * (len(self.bounds) - 1) - 1e-6]]
        words = [b"\n ", *(w + b" " for w in K.strings(self.words))]
        return [b"".join([words[t] for t in self.token[a : a + run].tolist()]) for a in often.tolist()]

    def among(self, runs: list[bytes], run: int) -> tuple[np.ndarray, np.ndarray]:
        """The places where one of some runs begins, and which; the runs are sorted along with the suffixes."""
        at = self.whole(run)
        if not len(at) or not runs:
            return at[:0], at[:0]
        told = pa.array([w for r in runs for w in r.split(b" ")[:-1]], pa.large_binary())
        code = pc.index_in(told, self.words).fill_null(len(self.words)).to_numpy().astype(np.int64) + 1
        code[pc.equal(told, b"\n").to_numpy(zero_copy_only=False)] = 0
        rank = ranked_suffixes(np.concatenate([self.token, code]), run)
        seat = np.full(int(rank.max()) + 1, -1, np.int64)
        seat[rank[len(self.token) :: run]] = np.arange(len(runs))
        kind = seat[rank[at]]
        return at[kind >= 0], kind[kind >= 0]

    def without(self, gone: np.ndarray, text: pa.Array) -> pa.Array:
        """The texts without tokens that are gone; a text of which nothing would be left is a copy, and stays."""
        gone = gone[self.place]
        some = np.bincount(K.owner(self.bounds)[gone], minlength=len(text))
        cut = np.flatnonzero((some > 0) & (some < np.diff(self.bounds)))
        if not len(cut):
            return text
        out, raw = text.to_pylist(), self.data.tobytes()
        for d in cut.tolist():
            own = np.flatnonzero(~gone[self.bounds[d] : self.bounds[d + 1]]) + self.bounds[d]
            out[d] = b" ".join([raw[a:b] for a, b in zip(self.starts[own].tolist(), self.ends[own].tolist())]).decode()
        return pa.array(out, pa.large_string())


class Groups:
    """Calls solved for each group of rows that begin with host and group and are sorted by them; waiting rows are Arrow slices."""

    def __init__(self, run: int, outside: tuple[int, float], inside: tuple[int, float]):
        self.run, self.bounds = run, (outside, outside, inside)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, []
        for batch in batches:
            key = pa.StructArray.from_arrays(batch.columns[:2], names=["host", "group"]).to_pylist()
            edges = [0, *(k for k in range(1, len(key)) if key[k] != key[k - 1]), len(key)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if waiting and key[a] != now:
                    yield from self.solved(pa.Table.from_batches(waiting))
                    waiting = []
                now = key[a]
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield from self.solved(pa.Table.from_batches(waiting))
        K.tidy()

    def solved(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def shown(self, table: pa.Table, text: pa.Array | pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        text = pc.replace_substring(text, "\n", " ")
        yield from pa.Table.from_arrays([table.column("page_id"), table.column("url"), text.cast(pa.string())], names=["page_id", "url", "text"]).to_batches(max_chunksize=512)


def _texts(table: pa.Table) -> pa.Array:
    return table.column("text").cast(pa.large_string()).combine_chunks()


class HostArrays(Groups):
    """(page_id, url, text) of (host, group, page_id, url, level, text) rows of hosts that are one group."""

    def solved(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        text = table.column("text")
        if table.column("host")[0].as_py() is not None and len(table) >= min(self.bounds[0][0], self.bounds[2][0]):
            text = _texts(table)
            own = GroupText(text)
            least = np.array([need(len(text), self.bounds[k]) for k in table.column("level").to_pylist()], np.int64)
            text = own.without(repeated(own.page, own.token, least, self.run), text)
        yield from self.shown(table, text)


class NamedRuns(Groups):
    """(host, run) of the runs that are on the lowest share of a group's pages."""

    def solved(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        often = GroupText(_texts(table)).frequent(self.run, min(b[1] for b in self.bounds))
        yield pa.RecordBatch.from_arrays([pa.array([table.column("host")[0].as_py()] * len(often), pa.string()), pa.array(often, pa.binary())], names=["host", "run"])


class Counted:
    """(host, run, pages) of a group's pages and its host's runs: on how many of the pages each of the runs is."""

    def __init__(self, run: int):
        self.run = run

    def __call__(self, key: tuple, pages: pa.Table, told: pa.Table) -> pa.Table:
        own, runs = GroupText(_texts(pages)), told.column("run").to_pylist()
        at, kind = own.among(runs, self.run)
        times = own.pages_with(kind, at)
        found = np.flatnonzero(times)
        return pa.table({"host": pa.array([key[0].as_py()] * len(found), pa.string()), "run": pa.array([runs[k] for k in found.tolist()], pa.binary()), "pages": pa.array(times[found], pa.int64())})


class LargeHosts(Groups):
    """(page_id, url, text) of a group's pages, given its host's runs with their sums; pages tells how many the host has."""

    def __call__(self, key: tuple, pages: pa.Table, told: pa.Table) -> pa.Table:
        text = _texts(pages)
        own, total = GroupText(text), told.column("pages").to_numpy()
        if len(told) and len(pages):
            at, kind = own.among(told.column("run").to_pylist(), self.run)
            least = np.array([need(pages.column("pages")[0].as_py(), self.bounds[k]) for k in pages.column("level").to_pylist()], np.int64)
            hit = at[total[kind] >= least[own.page[at]]]
            edge = np.zeros(len(own.token) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + self.run, -1)
            text = own.without(np.cumsum(edge[:-1]) > 0, text)
        return pa.Table.from_batches(self.shown(pages, text), pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())]))


def _host(url: Column) -> Column:
    """The host of a url, lower-cased; null if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.when(host != "", F.lower(host))


def _three(f):
    """f as a function of key and two tables, which cogroup asks for."""
    return lambda key, left, right: f(key, left, right)


def main_text(pages: DataFrame, run: int = RUN, outside: tuple[int, float] = OUTSIDE, inside: tuple[int, float] = INSIDE, group_bytes: int = GROUP_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of each row of pages.

    outside, inside: on how many pages a run must be, at least and as a share of
    its group, to be removed outside an article's element and inside one.

    Null and empty pages, and pages without text, have an empty text; pages of
    any length are read whole; pages without a host are compared with no others;
    repeated rows keep a row each; other columns are not looked at.
    """
    bounded(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), _host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    # Only hosts of more than one group need a row here.
    sizes = rows.where(F.col("host").isNotNull()).groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes"), F.count("*").alias("pages")).where(F.col("bytes") > group_bytes).select("host", F.ceil(F.col("bytes") / group_bytes).alias("groups"), "pages")
    sizes = written(sizes, "large-hosts")
    # Sent to all tasks only if they are known to be few; pages are shuffled to them otherwise.
    large = sizes.count()
    near = F.broadcast(sizes) if large <= FEW_HOSTS else sizes
    rows = rows.join(near, "host", "left")
    group = F.when(F.col("host").isNull(), F.xxhash64("page_id", "url")).otherwise(F.pmod(F.xxhash64("page_id", "url"), F.coalesce("groups", F.lit(1))))
    rows = rows.select("host", group.alias("group"), "page_id", "url", "pages", "html")
    out, bounds = "page_id bigint, url string, text string", (run, outside, inside)
    parsed = lambda df: df.mapInArrow(Parse(), "host string, group bigint, page_id bigint, url string, pages bigint, level int, text string")
    dealt = parsed(rows.where("pages IS NULL") if large else rows).repartition("host", "group")
    found = dealt.sortWithinPartitions("host", "group").mapInArrow(HostArrays(*bounds), out)
    if large:
        # One plan, so that the groups' texts are shuffled once for the three times that they are looked at.
        width = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        texts = parsed(rows.where("pages IS NOT NULL")).repartition(width, "host", "group")
        each = sizes.select("host", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).alias("group"))
        with_runs = lambda runs: texts.groupBy("host", "group").cogroup(runs.join(each, "host").select("host", "group", "run", "pages").groupBy("host", "group"))
        named = texts.sortWithinPartitions("host", "group").mapInArrow(NamedRuns(*bounds), "host string, run binary").distinct().withColumn("pages", F.lit(0).cast("bigint"))
        counted = with_runs(named).applyInArrow(_three(Counted(run)), "host string, run binary, pages bigint")
        sums = counted.groupBy("host", "run").agg(F.sum("pages").alias("pages")).join(sizes.select("host", F.col("pages").alias("all")), "host")
        sums = sums.where(F.col("pages") >= min(outside[1], inside[1]) * F.col("all") - 1e-6).select("host", "run", "pages")
        found = found.union(with_runs(sums).applyInArrow(_three(LargeHosts(*bounds)), out))
    return found.withColumnsRenamed({"page_id": id_col, "url": url_col})


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page.

    Null and empty pages, and pages without text, have an empty text and no
    characters; pages of any length are read whole; repeated rows keep a row
    each; an empty table gives no row; columns beside page_id, url and html
    aren't looked at.
    """
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("bigint"))
