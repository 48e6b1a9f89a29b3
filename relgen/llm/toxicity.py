"""Toxicity scores by a convolutional text classifier trained in numpy.

Words (lower-cased, split at ASCII punctuation) are hashed to embedding rows; filters over one, two and
three words slide over the whole text, each keeps its greatest response, and a logistic layer scores the
responses.  The first embedding value starts from the word's shrunken log-odds on the training rows, the
rest at random.  Thresholds are calibrated for each language, recognised by the text's own function words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgen.llm import kernel as K
from relgen.llm.decontaminate import plain_words
from relgen.llm.tables import written

BUCKET_BITS, SIZE, FILTERS, WIDTHS = 20, 8, 8, (1, 2, 3)
#: Labelled rows of each class that training sees at most, and the words of all of them.
MAX_ROWS, MAX_WORDS = 3000, 50_000_000
# fixed values: frequent function words
FUNCTION_WORDS = {
    "en": "the of and to in is that with for this be by",
    "fr": "le la les des et un une dans du que qui pour",
    "de": "der die das und den von zu nicht mit ist ein eine",
    "es": "el los las y en por para con del una no se",
}
LANGUAGES = tuple(FUNCTION_WORDS)


def _word_hash(words: list[str]) -> np.ndarray:
    return plain_words(*K.text_buffers(pa.array([" ".join(words)]))).hash


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def language(words: K.Words) -> np.ndarray:
    """The index in LANGUAGES of each text; one more for texts without function words."""
    lists = [_word_hash(FUNCTION_WORDS[k].split()) for k in LANGUAGES]
    flat, which = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(flat)
    flat, which = flat[order], which[order]
    at = np.minimum(np.searchsorted(flat, words.hash), len(flat) - 1)
    hit = flat[at] == words.hash
    text = np.repeat(np.arange(len(words.off) - 1), words.counts())[hit]
    n = np.bincount(text * len(lists) + which[at[hit]], minlength=(len(words.off) - 1) * len(lists)).reshape(-1, len(lists))
    return np.where(n.max(axis=1) > 0, n.argmax(axis=1), len(lists))


@dataclass
class Model:
    row: np.ndarray  # of each bucket; 0: unknown
    emb: np.ndarray
    conv: list[np.ndarray]  # for each width: (width, size, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1, np.float32))

    def forward(self, rows: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``rows``: embedding rows of all texts, two zeros after each; returns (logits, pooled, argmax, embedded)."""
        x = self.emb[rows]
        n = len(rows)
        pooled = np.zeros((len(off) - 1, len(self.bias)), np.float32)
        where = np.zeros(pooled.shape, np.int64)
        for k, w in enumerate(self.conv):
            z = x @ w[0]
            for j in range(1, len(w)):
                z[: n - j] += x[j:] @ w[j]
            # windows from the zeros on hold nothing of their own text, and must not see the next one
            z[off[1:] - 1] = z[off[1:] - 2] = 0
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            best = np.maximum.reduceat(z, off[:-1], axis=0)
            pooled[:, cols] = best
            if self.training:
                for i in range(len(off) - 1):
                    where[i, cols] = off[i] + z[off[i] : off[i + 1]].argmax(axis=0)
        pooled = np.maximum(pooled + self.bias, 0)
        return pooled @ self.out + np.float32(self.out_bias), pooled, where, x

    training: bool = False


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    off = np.append(0, np.cumsum([len(r) + 2 for r in rows]))
    flat = np.zeros(off[-1], np.int32)
    for r, a in zip(rows, off[:-1], strict=True):
        flat[a : a + len(r)] = r
    return flat, off


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Model:
    """``texts``: buckets of each text's words."""
    rng = np.random.default_rng(seed)
    labels = labels.astype(np.float32)
    seen = np.zeros((2, 1 << BUCKET_BITS), np.float32)
    for t, y in zip(texts, labels, strict=True):
        seen[int(y), np.unique(t)] += 1
    total = seen.sum(axis=0)
    known = np.flatnonzero(total >= 2)
    row = np.zeros(1 << BUCKET_BITS, np.int32)
    row[known] = np.arange(1, len(known) + 1)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    odds = np.log((seen[1, known] + 1) / (n1 + 2)) - np.log((seen[0, known] + 1) / (n0 + 2))
    emb = np.zeros((len(known) + 1, SIZE), np.float32)
    emb[1:, 1:] = rng.normal(0, 0.3, (len(known), SIZE - 1))
    emb[1:, 0] = odds * total[known] / (total[known] + 4)
    model = Model(row, emb, [rng.normal(0, 0.1, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), training=True)
    for w in model.conv:
        w[0, 0, :] = np.abs(w[0, 0, :]) + 0.3
    model.out[:] = np.abs(model.out)
    rows = [row[t] for t in texts]
    gathered = np.zeros(len(known) + 1, np.float32)
    weight = np.where(labels > 0, 0.5 / max(n1, 1), 0.5 / max(n0, 1)) * len(labels)
    params = [*model.conv, model.bias, model.out]
    m1, m2, step, bias_m = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, 0.0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            # a word is left out at random, so that no single rare word carries a text
            flat, off = padded([np.where(rng.random(len(rows[i])) < 0.1, 0, rows[i]) for i in part])
            logit, pooled, where, x = model.forward(flat, off)
            error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[part]) * weight[part] / len(part)).astype(np.float32)
            grads = [np.zeros_like(w) for w in model.conv]
            g_pool = np.outer(error, model.out) * (pooled > 0)
            touched, g_rows = [], []
            for k, w in enumerate(model.conv):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                at, g = where[:, cols], g_pool[:, cols]
                for j in range(len(w)):
                    p = np.minimum(at + j, len(flat) - 1)
                    grads[k][j] = np.einsum("if,ifs->sf", g, x[p])
                    touched.append(flat[p].ravel())
                    g_rows.append((g[:, :, None] * w[j].T[None]).reshape(-1, SIZE))
            all_grads = [*grads, g_pool.sum(axis=0), pooled.T @ error]
            step += 1
            for i, (p, g) in enumerate(zip(params, all_grads, strict=True)):
                g = g + 1e-4 * p
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.99 * m2[i] + 0.01 * g * g
                p -= (rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            bias_m = 0.9 * bias_m + 0.1 * float(error.sum())
            model.out_bias -= rate * 2 * bias_m
            t = np.concatenate(touched)
            different, at = np.unique(t, return_inverse=True)
            g_emb = np.zeros((len(different), SIZE), np.float32)
            np.add.at(g_emb, at, np.concatenate(g_rows).astype(np.float32))
            # steps of a word shrink with what it has moved, so that rare words learn as well
            gathered[different] += (g_emb**2).sum(axis=1)
            model.emb[different] -= 5 * rate * g_emb / (np.sqrt(gathered[different])[:, None] + 1e-6)
            model.emb[0] = 0
    model.training = False
    return model


def logits(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    out = []
    for a in range(0, len(texts), 64):
        flat, off = padded([model.row[t] for t in texts[a : a + 64]])
        out.append(model.forward(flat, off)[0])
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The logit that parts the classes with the fewest errors, in the middle of the widest such gap."""
    order = np.argsort(score)
    s, y = score[order], label[order]
    wrong = np.append(0, np.cumsum(y)) + np.append(np.cumsum((1 - y)[::-1])[::-1], 0)
    edges = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    gap = np.diff(edges)
    best = np.flatnonzero(wrong == wrong.min())
    k = best[np.argmax(gap[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def calibrate(model: Model, texts: list[np.ndarray], labels: np.ndarray, languages: np.ndarray, least: int = 10) -> None:
    """Shifts each language's logits so that its threshold is 0; languages with few labels get the common one."""
    if not len(texts) or labels.min() == labels.max():
        return
    score = logits(model, texts)
    model.shift[:] = threshold(score, labels)
    for k in range(len(model.shift)):
        own = languages == k
        if min(labels[own].sum(), (1 - labels[own]).sum()) >= least:
            model.shift[k] = threshold(score[own], labels[own])


def _fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, off in K.slices(batch):
            words = plain_words(data, off)
            ids = buckets(words.hash)
            n = words.counts()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([ids[a:b].tobytes() for a, b in zip(words.off[:-1], words.off[1:], strict=True)], pa.binary()), pa.array(language(words).astype(np.int32)), pa.array(n.astype(np.int64))], ["doc_id", "toxic", "fold", "ids", "language", "n"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> Model | None:
    """Trains on folds 1 to 3 and calibrates on fold 4 of crc32(doc_id) mod 5; fold 0 is never seen.

    The sample has ``max_rows`` documents of each class at most, the first by a hash of doc_id, and of these
    whole texts of ``max_words`` words in all at most, the shortest first.  Repeated labels and rows count
    once, documents with labels of both classes not at all.  None without labels of both classes.
    """
    rows = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("other")).where("toxic = other").select("doc_id", "toxic", _fold("doc_id").cast("int").alias("fold")).where("fold <> 0")
    order = F.xxhash64("doc_id")
    sample = rows.where("toxic = 1").orderBy(order, "doc_id").limit(max_rows).union(rows.where("toxic = 0").orderBy(order, "doc_id").limit(max_rows))
    texts = docs.select("doc_id", "text").where("text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = written(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "fold", "text").mapInArrow(_sampled, f"doc_id {kind}, toxic int, fold int, ids binary, language int, n bigint"), "sample")
    # of rows that repeat a doc_id the one with the least hash counts
    one = made.withColumn("h", F.xxhash64("ids")).groupBy("doc_id").agg(F.min(F.struct("h", "n")).alias("x")).select("doc_id", "x.h", "x.n")
    total, chosen = 0, []
    for r in sorted(one.collect(), key=lambda r: (r["n"], r["doc_id"])):
        total += r["n"]
        if total <= max_words:
            chosen.append((r["doc_id"], r["h"]))
    if not chosen:
        return None
    keys = F.broadcast(docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, h bigint"))
    got = made.withColumn("h", F.xxhash64("ids")).join(keys, ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("doc_id", "toxic", "fold", "ids", "language")
    got = sorted(got.collect(), key=lambda r: r["doc_id"])
    ids = [np.frombuffer(r["ids"], np.int32) for r in got]
    y, fold, lang = (np.array([r[c] for r in got], dtype=np.int64) for c in ("toxic", "fold", "language"))
    learn, hold = np.flatnonzero(fold != 4), np.flatnonzero(fold == 4)
    if len(set(y[learn].tolist())) < 2:
        return None
    model = train([ids[i] for i in learn], y[learn])
    calibrate(model, [ids[i] for i in hold], y[hold], lang[hold])
    return model


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in K.slices(batch, most=K.SLICE_BYTES // 2):
                words = plain_words(data, off)
                ids = buckets(words.hash)
                score = np.zeros(part.num_rows)
                if model is not None:
                    flat, at = padded([model.row[ids[a:b]] for a, b in zip(words.off[:-1], words.off[1:], strict=True)])
                    x = model.forward(flat, at)[0].astype(np.float64) - model.shift[language(words)]
                    score = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    The score comes from the text alone.  Null and empty texts have the score of a text without known
    words; a null doc_id is not held out; without labels of both classes every score is 0.  Repeated rows
    are scored each; other columns are ignored, and an empty table gives an empty result.  A very long text
    is scored whole, in one numpy pass.
    """
    model = fit(docs, labels, max_rows)
    out = docs.select("doc_id", "text").mapInArrow(_score(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.coalesce(_fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
