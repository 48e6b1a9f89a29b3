"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are lower-cased (A-Z) and split at ASCII characters other than letters and digits.  The document
frequency of every benchmark n-gram is counted over the whole corpus; an item's seeds are the rarer half
of its n-grams and all that occur in few documents, so that each item keeps seeds however often it leaked.
Around the seeds a passage shares with an item, local alignment of words (match 2, mismatch and gap -1)
scores copies, edited copies and paraphrases; the score is a share of the item's perfect score.  A passage
that scores as ``RUN`` equal words or more counts for items of any length, and items below ``MIN_WORDS`` words
only as whole exact copies.  Items of fewer words than an n-gram are not sought, as prose is full of them.

Items go to the tasks in blocks of bounded size; each block costs two passes over the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgen.llm import kernel as K

GRAM, MIN_WORDS, RARE, SLACK, THRESHOLD = 3, 8, 10, 12, 0.5
#: An alignment that scores as so many equal words counts however long its item is.
RUN = 25
#: Bytes of benchmark text that a task holds at once.
BLOCK_BYTES = 16 << 20
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = True


def plain_words(data: np.ndarray, off: np.ndarray) -> K.Words:
    spaced = np.where(_PLAIN[data], np.uint8(0x20), data)
    return K.words_of(spaced, off, lower=True)


class Items:
    """Some benchmark items: their words' hashes and their n-grams."""

    def __init__(self, ids: list, texts: list[str], gram: int, min_words: int) -> None:
        column = pa.array(texts, pa.string())
        words = plain_words(*K.text_buffers(column))
        n = words.counts()
        keep = [i for i in range(len(texts)) if n[i] >= gram]
        self.least = [1.0 if n[i] < min_words else 0.0 for i in keep]
        self.ids = [ids[i] for i in keep]
        self.words = [words.hash[words.off[i] : words.off[i + 1]] for i in keep]
        grams = [_grams(w, gram) for w in self.words]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        self.known, self.code = np.unique(flat, return_inverse=True)
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``grams`` that hold a known n-gram, and its code."""
        maybe = np.flatnonzero(self.filter[(grams >> np.uint64(44)).astype(np.int64)])
        code = np.minimum(np.searchsorted(self.known, grams[maybe]), len(self.known) - 1)
        real = self.known[code] == grams[maybe]
        return maybe[real], code[real]

    def seed(self, frequency: np.ndarray, rare: int) -> None:
        """Chooses each item's seeds; ``frequency``: of each known n-gram."""
        often = frequency[self.code]
        order = np.lexsort((self.at, often, self.item))
        rank = np.empty(len(order), dtype=np.int64)
        first = np.searchsorted(self.item, np.arange(len(self.ids) + 1))
        rank[order] = np.arange(len(order)) - first[self.item]
        size = np.diff(first)[self.item]
        use = (2 * rank < size) | (often <= rare)
        of = np.flatnonzero(use)
        of = of[np.argsort(self.code[of], kind="stable")]
        self.seeds, self.seed_off = of, np.searchsorted(self.code[of], np.arange(len(self.known) + 1))


def _grams(h: np.ndarray, gram: int) -> np.ndarray:
    n = max(len(h) - gram + 1, 0)
    g = np.zeros(n, dtype=np.uint64)
    for j in range(gram if n else 0):
        g += K.mix(h[j : j + n], 40 + j)
    return K.mix(g, 50)


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over pairs of word sequences, many at a time: (score, end in the passage)."""
    b, rows, cols = len(items), max(map(len, items)), max(map(len, passages))
    q, t = np.zeros((b, rows), np.uint64), np.zeros((b, cols), np.uint64)
    ql, tl = np.array([len(x) for x in items]), np.array([len(x) for x in passages])
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        q[i, : len(x)], t[i, : len(y)] = x, y
    inside = np.arange(cols)[None, :] < tl[:, None]
    up = np.zeros((b, cols), np.int32)
    best, end = np.zeros(b, np.int32), np.zeros(b, np.int64)
    slope = np.arange(cols, dtype=np.int32)[None, :]
    for r in range(rows):
        same = (t == q[:, r : r + 1]) & inside & (ql > r)[:, None]
        from_diagonal = np.zeros_like(up)
        from_diagonal[:, 1:] = up[:, :-1]
        h = np.maximum(np.maximum(from_diagonal + np.where(same, 3, 0).astype(np.int32) - 1, up - 1), 0)
        h = np.maximum.accumulate(h + slope, axis=1) - slope  # gaps in the item
        up = np.where(inside, h, 0)
        now = up.argmax(axis=1)
        value = up[np.arange(b), now]
        better = value > best
        best[better], end[better] = value[better], now[better] + 1
    return best, end


def find(items: Items, words: K.Words, gram: int, slack: int, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, word after the last) of the best passage for each text and item over the threshold."""
    if not items.ids or not len(words.hash):
        return []
    at, code = items.hits(_grams(words.hash, gram))
    text = np.searchsorted(words.off, at, "right") - 1
    inside = at + gram <= words.off[text + 1]
    at, code, text = at[inside], code[inside], text[inside]
    n = np.diff(items.seed_off)[code]
    which = items.seeds[K.ranges(items.seed_off[:-1][code], n)]
    at, text = np.repeat(at, n), np.repeat(text, n)
    if not len(at):
        return []
    item, shift = items.item[which], at - items.at[which]
    order = np.lexsort((shift, item, text))
    text, item, shift = text[order], item[order], shift[order]
    length = np.array([len(w) for w in items.words])[item]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (shift[1:] > shift[:-1] + length[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1
    begin = np.maximum(shift[first] - slack, words.off[text[first]])
    finish = np.minimum(shift[last] + length[first] + slack, words.off[text[first] + 1])
    size = np.argsort(finish - begin, kind="stable")
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    for k in range(0, len(size), 64):
        part = size[k : k + 64]
        qs = [items.words[item[first[i]]] for i in part]
        score, end = align(qs, [words.hash[begin[i] : finish[i]] for i in part])
        share = score / np.array([2 * len(q) for q in qs])
        least = np.maximum([items.least[item[first[i]]] for i in part], np.minimum(threshold, RUN / np.array([len(q) for q in qs])))
        good = np.flatnonzero(share >= least)
        if not len(good):
            continue
        # the alignment of the reversed sequences ends where the passage begins
        _, back = align([qs[g][::-1] for g in good], [words.hash[begin[part[g]] : begin[part[g]] + end[g]][::-1] for g in good])
        for g, r in zip(good.tolist(), back.tolist(), strict=True):
            i = part[g]
            x, base = int(text[first[i]]), int(words.off[text[first[i]]])
            stop = int(begin[i] + end[g]) - base
            key, value = (x, int(item[first[i]])), (float(share[g]), stop - r, stop)
            if key not in found or value[0] > found[key][0]:
                found[key] = value
    return [(*k, *v) for k, v in sorted(found.items())]


def item_blocks(benchmark: DataFrame, gram: int, min_words: int, block_bytes: int) -> Iterator[Items]:
    """The benchmark's items in blocks whose texts have about ``block_bytes`` bytes."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).distinct().collect()
        rows.sort(key=lambda r: (str(r[0]), r[1]))
        block = Items([r[0] for r in rows], [r[1] for r in rows], gram, min_words)
        if block.ids:
            yield block


def _frequencies(items: Items, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.known), dtype=np.int64)
        for batch in batches:
            for _, data, off in K.slices(batch):
                words = plain_words(data, off)
                if len(words.hash) >= gram:
                    at, code = items.hits(_grams(words.hash, gram))
                    text = np.searchsorted(words.off, at, "right") - 1
                    inside = at + gram <= words.off[text + 1]
                    pairs = np.unique(text[inside] * len(items.known) + code[inside])
                    total += np.bincount(pairs % len(items.known), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["code", "n"])

    return run


def _seeded(texts: DataFrame, items: Items, gram: int, rare: int) -> Items:
    """The number of distinct n-grams in a block bounds what returns to the driver."""
    frequency = np.zeros(len(items.known), dtype=np.int64)
    for code, n in texts.mapInArrow(_frequencies(items, gram), "code bigint, n bigint").groupBy("code").agg(F.sum("n")).collect():
        frequency[code] = n
    items.seed(frequency, rare)
    return items


def _passages(items: Items, gram: int, slack: int, threshold: float, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in K.slices(batch):
                if hits := find(items, plain_words(data, off), gram, slack, threshold):
                    text, item, score, start, end = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array([items.ids[i] for i in item], id_type), pa.array(score), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "item_id", "score", "start_word", "end_word"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, min_words: int = MIN_WORDS, rare: int = RARE, slack: int = SLACK, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): each item's best passage in each document over the threshold.

    Null texts hold nothing; rows without a doc_id or item_id take no part; items below ``min_words`` words
    are found as whole copies only; equal items are found each, of equal scores in a document the first passage; rows that repeat a doc_id give a row each, the best of them
    counting.  Other columns are ignored, and empty tables give an empty result.  A very long text is one
    row, read whole.
    """
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    id_field = benchmark.schema["item_id"].dataType
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", id_field), T.StructField("score", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType())])
    id_type = pa.string() if isinstance(id_field, T.StringType) else pa.int32() if isinstance(id_field, T.IntegerType) else pa.int64()
    out = docs.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark, gram, min_words, block_bytes):
        out = out.union(texts.mapInArrow(_passages(_seeded(texts, items, gram, rare), gram, slack, threshold, id_type), schema))
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word"), -F.col("end_word")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def _clean(items: Items, gram: int, slack: int, threshold: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in K.slices(batch):
                bad = {x[0] for x in find(items, plain_words(data, off), gram, slack, threshold)}
                yield part.filter(pa.array([i not in bad for i in range(part.num_rows)])) if bad else part

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, min_words: int = MIN_WORDS, rare: int = RARE, slack: int = SLACK, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark passage; no shuffle of texts.

    Null and empty texts and rows without a doc_id are judged by their text like others; repeated rows
    stay or go together; empty tables take nothing away.
    """
    texts = docs.where("text is not null").select("doc_id", "text")
    for items in item_blocks(benchmark, gram, min_words, block_bytes):
        docs = docs.mapInArrow(_clean(_seeded(texts, items, gram, rare), gram, slack, threshold, 0), docs.schema)
    return docs
