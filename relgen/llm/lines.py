"""Removal of boilerplate lines by the number of distinct sites that carry them.

Each line with ``min_words`` words is known by two 64-bit hashes of its trimmed bytes.  Lines that occur
``sites`` times at least get a HyperLogLog sketch of their sites, merged by aggregation.  A sketch far
from the threshold decides; lines near it get an exact distinct count.  A line on ``sites`` sites or more
goes from every document but the first (least doc_id) that has it, so that no text leaves the corpus whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgen.llm import kernel as K
from relgen.llm.tables import apart, written

TRIM = b" \t\x0b\x0c\r"
#: Relative distance from the threshold beyond which a sketch decides; its standard error is 1.6 %.
MARGIN = 0.15


def _hashes(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in K.slices(batch):
                words = K.words_of(data, off)
                if not len(words.start):
                    continue
                # a line's words are those between two line feeds of one text
                feed = np.zeros(len(data) + 1, dtype=np.int64)
                np.cumsum(data == 10, out=feed[1:])
                text = np.repeat(np.arange(part.num_rows), words.counts())
                line = feed[words.start] - feed[off[text]]
                new = np.ones(len(text), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(text)))
                first, size = first[size >= min_words], size[size >= min_words]
                s, e = words.start[first], words.end[first + size - 1]
                one, two = (K.bytes_hash(data, s, e, salt) for salt in (1, 2))
                at = pa.array(text[first])
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(line[first].astype(np.int32)), K.signed(one), K.signed(two)], ["doc_id", "site", "line", "one", "two"])

    return run


def boilerplate(lines: DataFrame, sites: int) -> DataFrame:
    """(one, two, first_doc) of the lines on ``sites`` sites or more."""
    # both small tables are written, so that their joins have exchanges on both sides and a hot line can be split
    often = lines.groupBy("one", "two").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") >= sites).drop("n")
    often = written(often, "often")
    some = written(lines.select("one", "two", "site").join(often, ["one", "two"]), "frequent-lines")
    spread = written(some.groupBy("one", "two", "first_doc").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(12))).alias("spread")), "spreads")
    low, high = sites * (1 - MARGIN) - 1, sites * (1 + MARGIN) + 1
    near = spread.where(F.col("spread").between(low, high)).select("one", "two")
    exact = some.join(near, ["one", "two"], "left_semi").groupBy("one", "two", "first_doc").agg(F.countDistinct("site").alias("spread"))
    return written(spread.where(F.col("spread") > high).unionByName(exact.where(F.col("spread") >= sites)).select("one", "two", "first_doc"), "boilerplate")


def _without(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            gone = columns.pop("__gone")
            count = np.zeros(batch.num_rows, dtype=np.int64)
            at = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                texts = columns["text"].to_pylist()
                for i in at.tolist():
                    drop = set(gone[i].as_py())
                    old = (texts[i] or "").split("\n")
                    kept = [x for j, x in enumerate(old) if j not in drop]
                    count[i] = len(old) - len(kept)
                    texts[i] = "\n".join(kept)
                columns["text"] = pa.array(texts, batch.schema.field("text").type)
            columns["lines_removed"] = pa.array(count)
            yield pa.RecordBatch.from_arrays([columns[n] for n in [*names, "lines_total", "lines_removed"]], [*names, "lines_total", "lines_removed"])

    return run


def remove_boilerplate(docs: DataFrame, sites: int = 10, min_words: int = 1, site: str = "source") -> DataFrame:
    """All columns of ``docs`` with boilerplate lines taken out of ``text``, and lines_total and lines_removed (bigint).

    A null site is a site of its own.  Null and empty texts, and rows without a doc_id, come back as they
    are; a line may repeat inside a document and counts once a site; rows that repeat a doc_id are copies
    of one text, so all rows of the first document keep a line.  An empty table gives an empty result, and
    a very long text is one row.  Columns of the input with these names are replaced.
    """
    whole, (docs, back) = docs, apart(docs, ("doc_id", "text", site))
    names = docs.columns
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), "text")
    lines = written(own.mapInArrow(_hashes(min_words), "doc_id bigint, site string, line int, one bigint, two bigint"), "lines")
    marks = lines.join(boilerplate(lines, sites), ["one", "two"]).where("doc_id <> first_doc").groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("line").alias("__gone"))
    joined = docs.join(marks, docs["doc_id"] == marks["__doc"], "left").select(*(docs[c] for c in names), (F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1).cast("bigint").alias("lines_total"), "__gone")
    made = joined.mapInArrow(_without(names), T.StructType([*docs.schema.fields, T.StructField("lines_total", T.LongType()), T.StructField("lines_removed", T.LongType())]))
    return made.select(*(b for c, b in zip(whole.columns, back, strict=True) if c not in ("lines_total", "lines_removed")), "lines_total", "lines_removed")


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", F.col("lines_total").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS body,
         len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM l
), b AS (
  SELECT body, min(doc_id) AS first_doc FROM k WHERE words >= 1 GROUP BY body HAVING count(DISTINCT site) >= 10
), r AS (
  SELECT k.doc_id, k.pos, k.line, b.body IS NOT NULL AND k.words >= 1 AND k.doc_id <> b.first_doc AS gone
  FROM k LEFT JOIN b ON k.body = b.body
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""
