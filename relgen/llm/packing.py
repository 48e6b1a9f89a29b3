"""Packing of tokenised documents into fixed windows, each filled with lexical neighbours of a seed.

Every document's whole windows become sequences of their own where it is tokenised.  Its rest, below one
window, goes to a shard of about ``shard`` documents.  Shards are ranges of a routing key that brings texts
with like tokens together: their TF-IDF vectors are projected on the main directions of a sample's, a tree
of median cuts orders the projections, and its leaves are ordered along their own main direction.  Retrieval
is local to a shard; the README has its recall.  In a shard a BM25 inverted index over token ids, with
document frequencies of the whole corpus, scores the unused rests by all tokens of each seed; the best fill
its window greedily, the last one cut where the window ends.  When a list is used up the index is asked
again; rests in their order follow only when no unused one shares a token with the seed.  A task packs its
shards one after the other; what is left of one goes to the next, and the last window is cut into
sequences whose sizes are powers of two, so that nothing needs padding.

Token ids are those of the tokenizers library: text is cut before each word as its pre-tokeniser does,
and each different piece of a task is encoded once.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgen.llm import kernel as K
from relgen.llm.tables import written

WINDOW, END, SHARD, VOCABULARY = 2048, 1, 2000, 50_304
K1, B, NEIGHBOURS = 1.2, 0.75, 64
#: A token in over one of so many rests of a shard has a row of the index.
DENSE = 16
#: Different pieces that a task remembers at most.
PIECES = 1 << 19
#: About so many rests teach the routing, in so many directions; a leaf of its tree has ``LEAF`` of them at least.
SAMPLE, DIRECTIONS, LEAF = 8192, 64, 64
#: White space that is not ASCII changes how runs of spaces are cut; such texts are encoded whole.
_ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80")


def default_tokenizer() -> tuple[str, str, str]:
    """(ranks file, pattern, ...) of the byte-level vocabulary byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts; pieces met before come from a hash table, which starts anew when it is full."""

    def __init__(self, ranks_file: str, pattern: str, most: int = PIECES) -> None:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= VOCABULARY:
            raise ValueError(f"ids of {VOCABULARY} and more don't fit")
        self.model = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.most, self.bits = most, int(2 * most - 1).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.entry = np.full(1 << self.bits, -1, dtype=np.int32)
        self.n, self.flat, self.off = 0, np.zeros(1 << 20, dtype=np.uint16), np.zeros(self.most + 1, dtype=np.int64)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        slot = self._slots(h)
        out = self.entry[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            out[todo] = self.entry[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[slot[todo]] != h[todo])]
        return out

    def _learn(self, h: np.ndarray, texts: list[str]) -> None:
        """``h``: distinct hashes without an entry."""
        ids = [self.model.encode_ordinary(t) for t in texts]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        at, total = int(self.off[self.n]), int(sizes.sum())
        while at + total > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[at : at + total] = np.fromiter((x for y in ids for x in y), np.uint16, total)
        self.off[self.n + 1 : self.n + len(ids) + 1] = at + np.cumsum(sizes)
        entry, slot, todo = np.arange(self.n, self.n + len(ids), dtype=np.int32), self._slots(h), np.arange(len(ids))
        while len(todo):
            free = todo[self.entry[slot[todo]] < 0]
            self.entry[slot[free]] = entry[free]  # of several for one slot the last stays
            self.keys[slot[free]] = h[free]
            own = self.entry[slot[todo]] == entry[todo]
            self.keys[slot[todo[own]]] = h[todo[own]]
            todo = todo[~own]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        self.n += len(ids)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        n_texts, n = len(off) - 1, len(data)
        if not n:
            return np.zeros(0, np.uint16), np.zeros(n_texts + 1, np.int64)
        words = K.words_of(data, off)
        cut = np.zeros(n + 1, dtype=bool)
        cut[off] = True
        cut[words.end] = True
        text = np.repeat(np.arange(n_texts), words.counts())
        inner = words.start > off[text]
        s = words.start[inner]
        cut[s - 1] = True
        cut[words.start[~inner]] = True
        cut[s[data[s - 1] != 0x20]] = True
        start = np.flatnonzero(cut[:n])
        end = np.append(start[1:], n)
        h = K.bytes_hash(data, start, end)
        index = self._find(h)
        if len(new := np.flatnonzero(index < 0)):
            _, where = np.unique(h[new], return_index=True)
            where = new[where]
            if self.n + len(where) > self.most:
                self._clear()
                _, where = np.unique(h, return_index=True)
                if len(where) > self.most:  # one long text of very many different pieces
                    self.most, self.bits = len(where), int(2 * len(where) - 1).bit_length()
                    self._clear()
            raw = data.tobytes()
            self._learn(h[where], [raw[a:b].decode() for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            index = self._find(h)
        size = self.off[index + 1] - self.off[index]
        ids = self.flat[K.ranges(self.off[index], size)]
        first = np.searchsorted(start, off)
        at = np.append(0, np.cumsum(size))[first]
        return self._odd(data, off, ids, at)

    def _odd(self, data: np.ndarray, off: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if not _ODD_SPACE.search(raw):
            return ids, at
        parts = []
        for i in range(len(off) - 1):
            own = raw[off[i] : off[i + 1]]
            parts.append(np.array(self.model.encode_ordinary(own.decode()), np.uint16) if _ODD_SPACE.search(own) else ids[at[i] : at[i + 1]])
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokens(ranks_file: str, pattern: str, window: int, end_id: int):
    names = ["doc_id", "doc_tokens", "crcs", "first_sequence", "rest", "terms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder(ranks_file, pattern)
        # even sequence ids are whole windows of one document, odd ones are packed
        sequence = TaskContext.get().partitionId() << 32
        frequency = np.zeros(VOCABULARY, dtype=np.int64)
        for batch in batches:
            for part, data, off in K.slices(batch):
                ids, at = encoder.encode(data, off)
                tokens, crcs, firsts, rests = [], [], [], []
                ends = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
                owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
                pairs = np.unique((owner * VOCABULARY + ends).astype(np.int32 if len(at) * VOCABULARY < 2**31 else np.int64))
                frequency += np.bincount(pairs % VOCABULARY, minlength=VOCABULARY)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    n = (b - a) // window
                    tokens.append(b - a)
                    firsts.append(sequence * 2)
                    crcs.append([crc(ends[a + i * window : a + (i + 1) * window]) for i in range(n)])
                    rests.append(ends[a + n * window : b].tobytes())
                    sequence += n
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(firsts, pa.int64()), pa.array(rests, pa.binary()), pa.nulls(len(tokens), pa.list_(pa.int64()))], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([frequency.tolist()], pa.list_(pa.int64()))], names)

    return run


class Router:
    """Orders rests so that those with like tokens lie together; learned from a sample of them."""

    def __init__(self, sample: list[np.ndarray], idf: np.ndarray) -> None:
        self.idf = idf
        owner, token, weight = self._vectors(sample)
        n, base = len(sample), np.random.default_rng(0).standard_normal((VOCABULARY, DIRECTIONS))
        for _ in range(3):  # subspace iteration towards the main directions
            there = self._sums(owner, n, token, weight, np.linalg.qr(base)[0])
            base = self._sums(token, VOCABULARY, owner, weight, there)
        self.base = np.linalg.qr(base)[0].astype(np.float32)
        points = self._points(sample)
        self.depth = max(0, int(np.log2(max(n, 1) / LEAF)))
        self.way = np.zeros((2 << self.depth, DIRECTIONS), np.float32)
        self.cut = np.zeros(2 << self.depth, np.float32)
        at = np.ones(n, np.int64)
        for level in range(self.depth + 1):
            for node in range(1 << level, 2 << level):
                own = points[at == node]
                if len(own) > 1:
                    self.way[node] = np.linalg.svd(own - own.mean(axis=0), full_matrices=False)[2][0]
                    self.cut[node] = np.median(own @ self.way[node])
            if level < self.depth:
                at = self._down(points, at)

    def _vectors(self, rests: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rest, token, weight) of the rests' TF-IDF vectors of length 1."""
        size = [len(r) for r in rests]
        flat = np.concatenate(rests).astype(np.int64) if rests else np.zeros(0, np.int64)
        pair, times = np.unique(np.repeat(np.arange(len(rests)), size) * VOCABULARY + flat, return_counts=True)
        owner, token = pair // VOCABULARY, pair % VOCABULARY
        weight = self.idf[token] * times * (K1 + 1) / (times + K1)
        length = np.sqrt(np.bincount(owner, weights=weight**2, minlength=len(rests)))
        return owner, token, weight / np.maximum(length, 1e-9)[owner]

    @staticmethod
    def _sums(to: np.ndarray, n: int, of: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(to, weights=values[of, j] * weight, minlength=n) for j in range(values.shape[1])], axis=1)

    def _points(self, rests: list[np.ndarray]) -> np.ndarray:
        owner, token, weight = self._vectors(rests)
        points = self._sums(owner, len(rests), token, weight, self.base)
        return (points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def _down(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 2 * at + ((points * self.way[at]).sum(axis=1) > self.cut[at])

    def keys(self, rests: list[np.ndarray]) -> np.ndarray:
        points = self._points(rests)
        at = np.ones(len(rests), np.int64)
        for _ in range(self.depth):
            at = self._down(points, at)
        along = np.clip(((points * self.way[at]).sum(axis=1) + 1) / 2, 0, 1)
        return (at << 32) + (along * (2**32 - 1)).astype(np.int64)


def _routed(router: Router):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rests = [np.frombuffer(x, np.uint16) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(router.keys(rests), pa.int64())], ["doc_id", "doc_tokens", "rest", "key"])

    return run


class Index:
    """BM25 inverted index of a shard's rests over token ids: rows for tokens of many rests, lists for the others."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray) -> None:
        n = len(rests)
        size = np.array([len(r) for r in rests], dtype=np.int64)
        flat = np.concatenate(rests).astype(np.int64) if n else np.zeros(0, np.int64)
        pair, times = np.unique((flat * n + np.repeat(np.arange(n), size)).astype(np.int32 if n * VOCABULARY < 2**31 else np.int64), return_counts=True)
        token, doc = np.divmod(pair, np.asarray(max(n, 1), pair.dtype))
        norm = K1 * (1 - B + B * size / max(size.mean() if n else 1, 1))
        weight = (idf[token] * times * (K1 + 1) / (times + norm[doc])).astype(np.float32)
        many = np.bincount(token, minlength=VOCABULARY) * DENSE > n
        self.row = np.where(many, np.cumsum(many) - 1, -1)
        self.rows = np.zeros((int(many.sum()), n), np.float32)
        dense = many[token]
        self.rows[self.row[token[dense]], doc[dense]] = weight[dense]
        self.doc, self.weight = doc[~dense].astype(np.int64), weight[~dense]
        self.at = np.searchsorted(token[~dense], np.arange(VOCABULARY + 1))
        self.n = n

    def scores(self, query: np.ndarray) -> np.ndarray:
        terms = np.unique(query).astype(np.int64)
        row = self.row[terms]
        at = K.ranges(self.at[terms], self.at[terms + 1] - self.at[terms])
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n) + self.rows[row[row >= 0]].sum(axis=0)

    def neighbours(self, query: np.ndarray, used: np.ndarray, most: int) -> np.ndarray:
        """The best unused documents that share a token with the query, best first."""
        score = self.scores(query)
        score[used] = 0
        top = np.argpartition(-score, min(most, self.n) - 1)[:most]
        top = top[np.argsort(-score[top], kind="stable")]
        return top[score[top] > 0]


def pack(rests: list[np.ndarray], idf: np.ndarray, window: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Yields windows in turn: (tokens in it, pieces as (document, first token of its rest, tokens))."""
    index = Index(rests, idf)
    begin = np.zeros(len(rests), dtype=np.int64)
    size = np.array([len(r) for r in rests], dtype=np.int64)
    used = size == 0
    carry, nextup = -1, 0
    while True:
        seed = carry
        while seed < 0 and nextup < len(rests):
            seed = nextup if not used[nextup] else -1
            nextup += 1
        if seed < 0:
            return
        pieces, room, carry = [], window, -1
        query = rests[seed]
        waiting: list[int] = [seed]
        alike = True
        while room:
            if not waiting and alike:
                waiting = index.neighbours(query, used, NEIGHBOURS).tolist()
                alike = bool(waiting)
            if not waiting:
                while nextup < len(rests) and used[nextup]:
                    nextup += 1
                if nextup == len(rests):
                    break
                waiting = [nextup]
            d = waiting.pop(0)
            n = min(room, int(size[d] - begin[d]))
            pieces.append((d, int(begin[d]), n))
            room -= n
            begin[d] += n
            if begin[d] == size[d]:
                used[d] = True
            else:
                carry = d
        if carry >= 0:
            used[carry] = True  # its remainder is the next seed
        yield window - room, pieces


def halved(pieces: list[tuple], total: int) -> Iterator[list[tuple]]:
    """Cuts a last window of ``total`` tokens into windows whose sizes are powers of two, which need no padding."""
    pieces = pieces[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        room, out = total & (1 << bit), []
        while room:
            d, begin, n = pieces.pop()
            out.append((d, begin, min(n, room)))
            if n > room:
                pieces.append((d, begin + room, n - room))
            room -= min(n, room)
        if out:
            yield out


def _packed(idf: np.ndarray, window: int, shard: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = (TaskContext.get().partitionId() << 32) * 2 + 1
        out: list[tuple] = []

        def put(held: list[tuple], pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for d, begin, n in pieces:
                doc, tokens, first, ids = held[d]
                out.append((doc, first + begin, n, crc(ids[begin : begin + n]), tokens, sequence, offset))
                offset += n
            sequence += 2

        def filled(held: list[tuple], last: bool) -> list[tuple]:
            """Packs a shard; what doesn't fill a window goes to the next."""
            for total, pieces in pack([h[3] for h in held], idf, window):
                if total == window:
                    put(held, pieces)
                elif last:
                    for part in halved(pieces, total):
                        put(held, part)
                else:
                    return [(*held[d][:2], held[d][2] + begin, held[d][3][begin : begin + n]) for d, begin, n in pieces]
            return []

        def rows() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[i : i + 50_000], strict=True)], names)
            out.clear()

        held: list[tuple] = []
        for batch in batches:
            for doc, tokens, rest in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.frombuffer(rest, np.uint16)
                held.append((doc, tokens, tokens - len(ids), ids))
                if len(held) >= shard:
                    held = filled(held, False)
                    yield from rows()
        filled(held, True)
        yield from rows()

    return run


def packed(docs: DataFrame, window: int = WINDOW, end_id: int = END, shard: int = SHARD, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and ``end_id``.  Null and empty texts have that id alone; rows without a
    doc_id are packed too, with a null doc_id; rows that repeat a doc_id are packed each.  Other columns
    are ignored, and an empty table gives an empty result.  Very long texts are cut into whole windows
    where they are tokenised; equal scores go to the rest that comes first in its shard's order.
    ``tokenizer``: ranks file and pattern.
    """
    ranks_file, pattern = tokenizer or default_tokenizer()[:2]
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, doc_tokens bigint, crcs array<bigint>, first_sequence bigint, rest binary, terms array<bigint>"
    tokens = written(own.mapInArrow(_tokens(ranks_file, pattern, window, end_id), schema), "tokens")
    # one number for each entry of the fixed vocabulary
    counted = dict(tokens.where("terms is not null").select(F.posexplode("terms").alias("token", "n")).groupBy("token").agg(F.sum("n")).collect())
    frequency = np.array([counted.get(i, 0) for i in range(VOCABULARY)], dtype=float)
    rows = tokens.where("terms is null")
    n = rows.count()
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
    idf[end_id] = 0
    whole = rows.where(F.size("crcs") > 0).select("doc_id", "doc_tokens", "first_sequence", F.posexplode("crcs").alias("i", "ids_crc32")).select("doc_id", (F.col("i").cast("bigint") * window).alias("start"), F.lit(window).cast("bigint").alias("length"), "ids_crc32", "doc_tokens", (F.col("first_sequence") + 2 * F.col("i")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rests = rows.where(F.length("rest") > 0).select("doc_id", "doc_tokens", "rest")
    some = rests.where(F.pmod(F.xxhash64("doc_id", "rest"), F.lit(max(1, n // SAMPLE))) == 0).select("rest").collect()
    router = Router([np.frombuffer(x, np.uint16) for x in sorted(bytes(r[0]) for r in some)], idf)
    # written, as range partitioning reads its input twice
    routed = written(rests.mapInArrow(_routed(router), "doc_id bigint, doc_tokens bigint, rest binary, key bigint"), "routed")
    # a partition has as many shards as it takes, one after the other
    partitions = min(-(-n // shard), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rests = routed.repartitionByRange(max(1, partitions), "key", "doc_id").sortWithinPartitions("key", "doc_id").select("doc_id", "doc_tokens", "rest")
    filled = rests.mapInArrow(_packed(idf, window, shard), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return whole.unionByName(filled)
