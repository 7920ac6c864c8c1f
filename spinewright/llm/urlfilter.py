"""URL filters: rules first, then the reputation of the host.

The reputation is empirical Bayes over a tree. Labelled pages give each host a
count of good pages among its labelled ones. Every level, from suffix to
registered domain to host, is a beta-binomial whose mean is the posterior mean
of the level above and whose strength comes from the data by moments; so a
host without labels takes after its domain. A page passes if the lower bound
of its host's posterior does. All of it is SQL: pages are read once to count by
host, the tree is worked out over hosts alone, and one join gives the verdicts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .shared import written

#: (host and path prefix, verdict): a rule fits its host and what is below it.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Suffixes of two labels under which domains are registered; suffixes_of reads a longer list.
TWO_LABEL_SUFFIXES = ("co.uk", "com.au", "co.jp", "com.br", "co.nz")
MIN_BOUND, Z = 0.5, 1.645
#: Limits of the correlation that a level's moments may give; they keep strengths between 1/9 and 999.
LEAST_RHO, MOST_RHO = 0.001, 0.9


def suffixes_of(lines: Iterable[str]) -> tuple[str, ...]:
    """The suffixes of two labels in a list of public suffixes: one a line, in any case, with comments behind // and rules with * or ! left out."""
    rules = {line.split("//")[0].strip().lower() for line in lines}
    return tuple(sorted(r for r in rules if re.fullmatch(r"[^.*!\s]+\.[^.*!\s]+", r)))


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "''") + "'"


def _rule_case(rules, what: int) -> str:
    """The rule (0) or verdict (1) of the longest rule that fits."""
    cases = []
    for rule in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, _, path = rule[0].partition("/")
        cases.append(f"WHEN (host = {_text(host)} OR right(host, {len(host) + 1}) = {_text('.' + host)}) AND left(path, {len(path) + 1}) = {_text('/' + path)} THEN {_text(rule[what])}")
    return f"CASE {' '.join(cases)} END" if cases else "CAST(NULL AS STRING)"


def _strength(table: str) -> str:
    """(1 - rho) / rho of a level, from sums over its parents (n, s, k, w2, q): the moments' estimate, pooled."""
    between = "q - s * s / n - (s / n) * (1 - s / n) * (k - 1)"
    scale = "(s / n) * (1 - s / n) * (n - w2 / n - (k - 1))"
    return f"(SELECT (1 - rho) / rho FROM (SELECT round(least(greatest(coalesce(sum({between}) / nullif(sum({scale}), 0), {LEAST_RHO}), {LEAST_RHO}), {MOST_RHO}), 6) AS rho FROM {table} WHERE n > 0) AS r)"


_SUMS = "CAST(sum(n) AS DOUBLE) AS n, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS k, CAST(sum(n * n) AS DOUBLE) AS w2, sum(CASE WHEN n > 0 THEN s * s / n ELSE 0 END) AS q"


def _outcomes(labels: str) -> str:
    return f"""outcomes AS (
  SELECT doc_id AS id, min(CASE WHEN quality >= 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good
  FROM {labels} WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id)"""


def _urls(pages: str) -> str:
    return f"""parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {pages}),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts)"""


_COUNTS = "SELECT host, CAST(count(good) AS DOUBLE) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS s FROM urls LEFT JOIN outcomes ON page_id = id GROUP BY host"


def _tree(counts: str, min_bound: float, z: float, two_label_suffixes) -> str:
    two = ", ".join(map(_text, two_label_suffixes)) or "''"
    labels_of = lambda n: " || '.' || ".join(f"split_part(name, '.', {-k})" for k in range(n, 0, -1))
    dots = "length(name) - length(replace(name, '.', ''))"
    return f"""named AS (
  SELECT *, name <> '' AND regexp_replace(name, '^([0-9.]+|.*])$', '') = '' AS address FROM (SELECT host, n, s, regexp_replace(host, ':[0-9]*$', '') AS name FROM {counts}) AS x),
suffixed AS (
  SELECT host, name, n, s, address, {dots} AS dots, CASE WHEN {dots} >= 1 AND {labels_of(2)} IN ({two}) THEN 2 ELSE 1 END AS width FROM named),
hosts AS (
  SELECT host, n, s, CASE WHEN address THEN 'address' WHEN width = 2 THEN {labels_of(2)} ELSE split_part(name, '.', -1) END AS suffix,
    CASE WHEN address OR dots < width THEN name WHEN width = 2 THEN {labels_of(3)} ELSE {labels_of(2)} END AS domain FROM suffixed),
domains AS (SELECT domain, suffix, {_SUMS} FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, {_SUMS} FROM domains GROUP BY suffix),
everything AS (SELECT {_SUMS} FROM suffixes),
strengths AS (
  SELECT (s + 1) / (n + 2) AS mean, {_strength("everything")} AS of_suffix, {_strength("suffixes")} AS of_domain, {_strength("domains")} AS of_host
  FROM (SELECT coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM everything) AS e),
suffix_means AS (
  SELECT suffix, ((SELECT of_suffix * mean FROM strengths) + s) / ((SELECT of_suffix FROM strengths) + n) AS mean FROM suffixes),
domain_means AS (
  SELECT d.domain, ((SELECT of_domain FROM strengths) * m.mean + d.s) / ((SELECT of_domain FROM strengths) + d.n) AS mean
  FROM domains AS d JOIN suffix_means AS m ON d.suffix = m.suffix),
posteriors AS (
  SELECT host, (of_host * mean + s) / (of_host + n) AS mean, of_host + n AS size
  FROM (SELECT h.host, h.n, h.s, m.mean, (SELECT of_host FROM strengths) AS of_host FROM hosts AS h JOIN domain_means AS m ON h.domain = m.domain) AS x),
reputation AS (
  SELECT host AS known, CASE WHEN mean - {z} * sqrt(mean * (1 - mean) / (size + 1)) >= {min_bound} THEN 'allow' ELSE 'block' END AS verdict FROM posteriors)"""


def _verdicts(reputation: str, rules) -> str:
    return f"SELECT page_id, host, path, {_rule_case(rules, 0)} AS rule, coalesce({_rule_case(rules, 1)}, verdict) AS verdict FROM urls LEFT JOIN {reputation} ON host = known"


def filter_sql(pages: str, labels: str, rules=RULES, min_bound: float = MIN_BOUND, z: float = Z, two_label_suffixes=TWO_LABEL_SUFFIXES) -> str:
    """All of it as one statement, in SQL that Spark and other engines share."""
    tree = _tree("counts", min_bound, z, two_label_suffixes)
    return f"WITH {_outcomes(labels)},\n{_urls(pages)},\ncounts AS ({_COUNTS}),\n{tree}\n{_verdicts('reputation', rules)}"


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, min_bound: float = MIN_BOUND, z: float = Z, two_label_suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages.

    labels (doc_id, quality, toxic) judge pages by id; of several labels of
    one page the worst holds, and null ids or qualities say nothing. A url that
    is null or lacks ``://`` has an empty host and path, and that host has a
    reputation like any other. Repeated rows keep a row each, extra columns
    aren't looked at, and without labels the means are one half. Domains are
    registered under two_label_suffixes, and else under the last label; a port
    belongs to the host alone, and an address is a domain of its own.
    """
    spark, own = pages.sparkSession, pages.select("page_id", "url")
    counts = written(spark.sql(f"WITH {_outcomes('{labels}')}, {_urls('{pages}')} {_COUNTS}", pages=own, labels=labels.select("doc_id", "quality", "toxic")), "host-counts", short=True)
    # Written too, so that the join deals a host with very many pages anew.
    known = written(spark.sql(f"WITH {_tree('{counts}', min_bound, z, two_label_suffixes)} SELECT known, verdict FROM reputation", counts=counts), "reputation", short=True)
    return spark.sql(f"WITH {_urls('{pages}')} {_verdicts('{known}', rules)}", pages=own, known=known)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict.

    A url that is null or lacks ``://`` has an empty host and path; urls of any
    length are read whole; repeated rows keep a row each; of several labels of
    a page the worst holds; with no labels all means are one half, and no pages
    give no row; columns beside page_id, url and the labels aren't looked at.
    """
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = {"op4_url_filter": filter_sql("pages", "labels")}
