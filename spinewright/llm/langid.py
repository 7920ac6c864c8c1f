"""Language ID by compression.

For each language a dictionary of raw text is put together from a bounded
sample of labelled documents. A text is compressed once with every dictionary,
in chunks, so that the dictionary counts all the way through a long text; the
language with the fewest bytes wins, and a narrow margin is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import bounded

#: Bounds of what is learned from: snippets of each language, characters of each, and snippets of all languages; with more
#: languages than that allows, each has fewer, one at least.
SNIPPETS, SNIPPET_CHARS, ALL_SNIPPETS = 96, 1000, 40_000
CHUNK = 16 << 10
MIN_MARGIN = 0.02
UNKNOWN = "und"
_ASCII_LETTER = K.byte_set((65, 90), (97, 122))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", snippets: int = SNIPPETS, chars: int = SNIPPET_CHARS) -> list[tuple[str, bytes]]:
    """(language, dictionary) pairs, the most frequent language first.

    Of each language at most that many snippets are taken, each of one text at
    a place that its hash gives; texts are chosen by the smallest hashes. Rows
    without text or language are left out.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    snippets = max(1, min(snippets, ALL_SNIPPETS // max(1, len(counts))))
    h = F.xxhash64("text")
    at = 1 + F.pmod(h, F.greatest(F.length("text") - chars, F.lit(1)))
    picked = rows.select("lang", h.alias("h"), F.substring("text", at.cast("int"), F.lit(chars)).alias("part")).withColumn("salt", F.pmod("h", F.lit(32)))
    for keys in (("lang", "salt"), ("lang",)):  # in two steps, so that no task gets all of a frequent language
        n = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "part"))
        picked = picked.withColumn("n", n).where(F.col("n") <= (snippets if keys == ("lang",) else max(8, snippets // 8)))
    parts: dict[str, list] = {}
    for r in picked.select("lang", "h", "part").collect():
        parts.setdefault(r.lang, []).append((r.h, r.part))
    return [(r.lang, "\n".join(p for _, p in sorted(parts[r.lang])).encode()) for r in counts]


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.dictionaries, self.tools = dictionaries, None

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "tools": None}

    def _tools(self):
        if self.tools is None:
            import zstandard as z

            self.tools = []
            for _, raw in self.dictionaries:
                d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=1)
                self.tools.append(z.ZstdCompressor(level=1, dict_data=d, write_content_size=False, write_checksum=False))
        return self.tools

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, names = self._tools(), [n for n, _ in self.dictionaries]
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            view = memoryview(np.ascontiguousarray(data))
            langs, scores = [], []
            for d in range(batch.num_rows):
                a, b = int(offsets[d]), int(offsets[d + 1])
                if not tools or not (_ASCII_LETTER[data[a:b]].any() or any(c.isalpha() for c in bytes(view[a:b]).decode())):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                sizes = [0] * len(tools)
                for s in range(a, b, CHUNK):
                    part = view[s : min(b, s + CHUNK)]
                    for k, tool in enumerate(tools):
                        sizes[k] += len(tool.compress(part))
                best = min(range(len(sizes)), key=sizes.__getitem__)
                second = min((x for k, x in enumerate(sizes) if k != best), default=0)
                langs.append(names[best])
                scores.append((second - sizes[best]) / second if second else 1.0)
            K.tidy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], min_margin: float = MIN_MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of each row of docs.

    score is the share of bytes by which the best dictionary beats the next
    one; below min_margin the row is rejected, and lang_pred is only a guess.
    Null texts and texts without a letter are ``und`` with score 0, as is all
    when nothing was learned. On a tie the more frequent language wins.
    """
    bounded(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col)).mapInArrow(Classifier(dictionaries), "id bigint, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", (F.col("score") < min_margin).alias("rejected"))


def _fold(col):
    return F.crc32(col.cast("string")) % 5


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from four folds of five.

    Null texts and texts without a letter are ``und``; texts of any length are
    compressed whole; repeated rows keep a row each; on a tie the more frequent
    language wins; with nothing to learn from all is ``und``, and an empty table
    gives no row; a null doc_id isn't held out; columns beside doc_id, text and
    lang aren't looked at.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs.where(_fold(F.col("doc_id")) != 0)))
    return found.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
