"""Exact removal of repeated 50-word passages by super-k-mer partitioning.

Windows of ``k`` consecutive words are never shuffled one by one.  Consecutive windows with the same
minimiser (the least hash of an ``m``-word run inside them) form a super-k-mer.  Only super-k-mers whose
minimiser occurs in two documents can hold a repeated window; each different one of those travels once,
as a packed string with its first document, to the bucket of its minimiser, where sorting the windows
finds the first document of each.  The verdicts return to all occurrences by the super-k-mer's hash.

A minimiser of more than ``hot`` different super-k-mers is split: its windows travel singly, dealt by the
hash of the whole window; copies of one super-k-mer are no burden, as they travel once.  Windows are told apart by 128 bits of hash, super-k-mers of one minimiser by 64
bits; neither is linear in words or bytes.  A text of any length is one row, and one numpy pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgen.llm import kernel as K
from relgen.llm.tables import grouped_stream, written

MAX_RUN = 512


def super_kmers(words: K.Words, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, minimiser, hash) of each super-k-mer of some texts."""
    h, n, w = words.hash, len(words.hash), k - m + 1
    count = np.maximum(words.counts() - k + 1, 0)
    if not count.sum():
        return tuple(np.zeros(0, dtype=np.int64 if i < 3 else np.uint64) for i in range(5))
    g = np.zeros(n, dtype=np.uint64)
    at = np.arange(n - m + 1)
    g[at] = K.span_hash(h, at, at + m, 3)
    least, span = g, 1
    while span * 2 <= w:
        least[: n - span] = np.minimum(least[: n - span], least[span:])
        span *= 2
    at = K.ranges(words.off[:-1], count)
    least = np.minimum(least[at], least[at + (w - span)])
    text = np.repeat(np.arange(len(count)), count)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    if size.max() > MAX_RUN:
        parts = -(-size // MAX_RUN)
        step = K.ranges(np.zeros(len(parts), np.int64), parts) * MAX_RUN
        first = np.repeat(first, parts) + step
        size = np.minimum(np.repeat(size, parts) - step, MAX_RUN)
    at0 = at[first]
    whole = K.span_hash(h, at0, at0 + size + (k - 1), 5)
    return text[first], at0 - words.off[text[first]], size, least[first], whole


def _occurrences(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in K.slices(batch):
                text, start, size, least, whole = super_kmers(K.words_of(data, off), k, m)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(text)), rows.column(1).take(pa.array(text)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), K.signed(least), K.signed(whole)], ["doc_id", "copy", "start", "n", "least", "whole"])

    return run


def _packed(k: int):
    """One row for each super-k-mer that travels; a hot one becomes a row for each of its windows."""
    names = ["route", "packed", "least", "whole", "at", "first_doc", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, go in zip(*(batch.column(i) for i in range(3)), strict=True):
                out: list[tuple] = []
                raw = text.as_py().encode()
                words = raw.split()
                h = None
                for x in go.as_py():
                    s, n = x["start"], x["n"]
                    if not x["hot"]:
                        out.append((x["least"], b" ".join(words[s : s + n + k - 1]).decode(), x["least"], x["whole"], 0, doc.as_py(), x["more"]))
                        continue
                    if h is None:
                        h = K.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hash
                    at = np.arange(s, s + n)
                    for i, r in enumerate(K.span_hash(h, at, at + k, 6).view(np.int64).tolist()):
                        out.append((r, b" ".join(words[s + i : s + i + k]).decode(), x["least"], x["whole"], i, doc.as_py(), x["more"]))
                if out:
                    cols = list(zip(*out, strict=True))
                    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def _sorted_windows(k: int):
    """Sorts all windows of complete buckets; runs of windows with the same first document are one row."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        words = K.words_of(*K.text_buffers(column["packed"]))
        count = words.counts() - k + 1
        at = K.ranges(words.off[:-1], count)
        owner = np.repeat(np.arange(len(count)), count)
        doc = column["first_doc"].to_numpy()
        one, two = (K.span_hash(words.hash, at, at + k, salt) for salt in (6, 7))
        order = np.lexsort((doc[owner], two, one))
        new = np.ones(len(order), dtype=bool)
        a, b = order[1:], order[:-1]
        new[1:] = (one[a] != one[b]) | (two[a] != two[b])
        first = np.empty(len(order), dtype=np.int64)
        first[order] = doc[owner[order[np.flatnonzero(new)]]][np.cumsum(new) - 1]
        useful = (first < doc[owner]) | column["more"].to_numpy(zero_copy_only=False)[owner]
        cut = np.ones(len(at), dtype=bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (first[1:] != first[:-1])
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, len(at)))
        keep = useful[begin]
        begin, size = begin[keep], size[keep]
        own = owner[begin]
        offset = at[begin] - words.off[own] + column["at"].to_numpy()[own]
        yield pa.RecordBatch.from_arrays([column["least"].take(pa.array(own)), column["whole"].take(pa.array(own)), pa.array(offset.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(first[begin])], ["least", "whole", "at", "n_dup", "first_doc"])

    return run


def repeated_spans(docs: DataFrame, k: int = 50, m: int = 8, hot: int = 10_000) -> DataFrame:
    """(doc_id, copy, spans): word spans (start, length) of windows that also start in a document with a smaller doc_id; ``copy`` is the text's hash."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("copy"), "text").where("doc_id is not null and text is not null")
    every = written(docs.mapInArrow(_occurrences(k, m), "doc_id bigint, copy bigint, start int, n int, least bigint, whole bigint"), "super-k-mers")
    shared = every.groupBy("least").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("whole") == F.max("whole")).alias("alone")).where("lo < hi").select("least", "alone")
    # a written table gets an exchange of its own in the join, so that the other side of a hot minimiser can be split
    shared = written(shared, "shared-minimisers")
    some = written(every.join(shared, "least"), "shared")
    kinds = written(some.groupBy("least", "whole", "alone").agg(F.min(F.struct("doc_id", "copy", "start", "n")).alias("one"), F.max("doc_id").alias("hi")).select("least", "whole", "alone", "one.*", (F.col("hi") > F.col("one.doc_id")).alias("more")), "kinds")
    split = written(kinds.where("not alone").groupBy("least").agg(F.count("*").alias("kinds")).where(F.col("kinds") > hot).select("least", F.lit(True).alias("hot")), "hot-minimisers")
    # where a minimiser has one super-k-mer only, all its occurrences are the same and nothing need travel
    copies = kinds.where("alone").select("least", "whole", F.lit(0).alias("at"), F.col("n").alias("n_dup"), F.col("doc_id").alias("first_doc"))
    travelling = kinds.where("not alone").join(split, "least", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    go = travelling.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "n", "least", "whole", "hot", "more")).alias("go"))
    packed = docs.join(go, ["doc_id", "copy"]).select("doc_id", "text", "go").mapInArrow(_packed(k), "route bigint, packed string, least bigint, whole bigint, at int, first_doc bigint, more boolean")
    runs = grouped_stream(packed, ["route"], _sorted_windows(k), "least bigint, whole bigint, at int, n_dup int, first_doc bigint")
    verdicts = written(runs.unionByName(copies), "verdicts")
    marks = some.join(verdicts, ["least", "whole"]).where("first_doc < doc_id")
    return marks.select("doc_id", "copy", (F.col("start") + F.col("at")).alias("from"), (F.col("n_dup") + F.lit(k - 1)).alias("length")).distinct().groupBy("doc_id", "copy").agg(F.collect_list(F.struct("from", "length")).alias("spans"))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for doc, text, spans in zip(*(batch.column(i) for i in range(3)), strict=True):
            words = (text.as_py() or "").encode().split()
            total = len(words)
            if spans.is_valid:
                gone = np.zeros(total + 1, dtype=np.int64)
                for x in spans.as_py():
                    if x["from"] < total:
                        gone[x["from"]] += 1
                        gone[min(total, x["from"] + x["length"])] -= 1
                gone = np.cumsum(gone)[:total] > 0
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            kept = b" ".join(words).decode()
            out.append((doc.as_py(), total, total - len(words), kept))
            size += len(kept)
            if size > 8 << 20:
                yield _rows(out)
                out, size = [], 0
        if out:
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, k: int = 50, m: int = 8, hot: int = 10_000) -> DataFrame:
    """Removes each word covered by a ``k``-word window that also starts in a document with a smaller doc_id.

    Returns (doc_id, n_words, n_removed, kept): kept words joined by one space.  Null texts are empty;
    rows without a doc_id come back whole and take no part; texts shorter than ``k`` words lose nothing;
    windows repeated inside one document alone stay; rows that repeat a doc_id are one document, whose texts
    have windows of their own and are told apart by hash.  Other columns are ignored, and an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    return own.join(repeated_spans(docs, k, m, hot), ["doc_id", "copy"], "left").select("doc_id", "text", "spans").mapInArrow(_cleaned, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def kept_sha256(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM d),
s AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS p, unnest(list_transform(range(1, len(words) - 48), lambda i: md5(array_to_string(words[i : i + 49], ' ')))) AS h FROM d WHERE len(words) >= 50),
f AS (SELECT doc_id, p, CAST(min(doc_id) OVER (PARTITION BY h) < doc_id AS INTEGER) AS again FROM s),
c AS (SELECT w.doc_id, w.p, w.word, max(coalesce(f.again, 0)) OVER (PARTITION BY w.doc_id ORDER BY w.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM w LEFT JOIN f ON f.doc_id = w.doc_id AND f.p = w.p),
g AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
