"""A made-up library over the tables part, supplier and events, in SQL that several engines share.

One file for each event; books come from parts and authors from suppliers.
Whether a folder's files have tags in capitals, with a subtitle and so on
hangs on the folder, so that its files make one edition; a few files differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROOT = "/lib"

LIBRARY = """
WITH seeds AS (
  SELECT event_id AS e, (event_id * 7919 + 104729) % 1000003 AS h, event_id % (SELECT count(*) FROM part) AS pk, event_id % (SELECT count(*) FROM supplier) AS sk FROM events),
named AS (
  SELECT e, h, h % 3 AS v, (pk * 31 + (h % 3) * 17) % 97 AS g, p_name AS p, s_name AS s FROM seeds JOIN part ON pk = p_partkey JOIN supplier ON sk = s_suppkey),
made AS (
  SELECT e, h,
    CASE WHEN h % 31 = 0 THEN '' WHEN g % 11 = 0 THEN s || ' - ' || p WHEN g % 13 = 0 THEN '_Unknown Author/' || p || '/' || CAST(v AS STRING) ELSE s || '/' || p || '/ed' || CAST(v AS STRING) END AS folder,
    CASE WHEN h % 9 = 1 THEN '01 - 02 - ' WHEN h % 9 = 2 THEN s || ' - ' ELSE '' END || 'Chapter ' || CAST(e AS STRING) || CASE WHEN h % 5 = 0 THEN '.2' ELSE '' END || '.' ||
      CASE h % 8 WHEN 0 THEN 'm4b' WHEN 1 THEN 'flac' WHEN 2 THEN 'MP3' WHEN 3 THEN 'txt' ELSE 'mp3' END AS name,
    CASE WHEN h % 23 = 0 THEN '' WHEN g % 7 = 1 THEN upper(s) WHEN g % 7 = 2 THEN s || ' - narrator' WHEN g % 7 = 3 THEN s || ' (reader)' WHEN g % 7 = 4 THEN ' Zed; ' || s ELSE s END AS raw_author,
    CASE WHEN h % 29 = 0 THEN '' WHEN g % 6 = 1 THEN 'The ' || p WHEN g % 6 = 2 THEN p || ': A Tale' WHEN g % 6 = 3 THEN p || ' (Unabridged)' WHEN g % 6 = 4 THEN p || ': Series 2 Extra' WHEN g % 6 = 5 THEN p || ' [B0ABCDEFGH]' ELSE p END AS raw_book,
    CASE WHEN h % 4 = 0 THEN '' ELSE 'Part ' || CAST(h % 3 AS STRING) || CASE WHEN h % 7 = 0 THEN '.2' ELSE '' END END AS raw_title,
    CASE h % 5 WHEN 0 THEN '' WHEN 1 THEN '0' || CAST(h % 4 AS STRING) WHEN 2 THEN CAST(h % 4 AS STRING) || '/12' ELSE CAST(h % 4 AS STRING) END AS raw_track,
    CASE h % 6 WHEN 0 THEN '2/3' WHEN 1 THEN '1' WHEN 2 THEN '012' ELSE '' END AS raw_disc,
    CASE WHEN g % 5 = 0 THEN 'Saga: One' WHEN g % 5 = 1 THEN p ELSE '' END AS raw_series,
    CASE g % 3 WHEN 0 THEN '' WHEN 1 THEN '3/5' ELSE '007' END AS raw_series_index,
    CASE WHEN g % 4 = 0 THEN '' ELSE CAST(2000 + g % 9 AS STRING) || '-05-01' END AS raw_year,
    64000 + (g % 3) * 64000 + (g % 2) * 400 AS bitrate, 600 + (h % 4) * 0.7e0 AS duration, 1000 + h % 50 AS size, 'f' || CAST(h % 3 AS STRING) AS fp, CASE WHEN h % 41 = 7 THEN 'unreadable' END AS error
  FROM named)
SELECT e, h, folder, name, CASE WHEN folder = '' THEN '/lib/' || name ELSE '/lib/' || folder || '/' || name END AS path, raw_author, raw_book, raw_title, raw_track, raw_disc, raw_series, raw_series_index, raw_year,
  CAST(bitrate AS BIGINT) AS bitrate, CAST(duration AS DOUBLE) AS duration, CAST(size AS BIGINT) AS size, fp, error FROM made
"""


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made-up library's files with raw tags as columns.

    Events are a few files of many short rows, so that their splits would be a
    few tasks; their ids are dealt to as many as shuffles have, in their order, in which
    what is written packs best.
    """
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier", "events")}
    tables["events"] = tables["events"].select("event_id").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    sql = LIBRARY
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(sql, **tables)
