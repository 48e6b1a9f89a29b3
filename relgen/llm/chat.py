"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its texts are
intersected with the sorted token spans by binary search.  Control strings inside texts and roles are
escaped: the escape sign gets a 0 after it, and a control string is broken after its first character by
the sign and a 1; line feeds in roles become the sign and a 2.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
SIGN = "␛"
# fixed values: strings that templates and tokenizers give a meaning
CONTROLS = (TURN, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: str) -> str:
    text = text.replace(SIGN, SIGN + "0")
    for c in CONTROLS:
        text = text.replace(c, c[0] + SIGN + "1" + c[1:])
    return text


def unescape(text: str) -> str:
    return text.replace(SIGN + "1", "").replace(SIGN + "0", SIGN)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The formatted conversation, and the span of each text with whether it is to be learned."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role).replace("\n", SIGN + "2") + "\n", escape(text)
        out += (head, body, END, "\n")
        at += len(head)
        spans.append((at, at + len(body), role == "assistant"))
        at += len(body) + len(END) + 1
    return "".join(out), spans


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, body = part[: -len(END) - 1].partition("\n")
        turns.append((unescape(role.replace(SIGN + "2", "\n")), unescape(body)))
    return turns


def loss_mask(tokens: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token, a sorted (start, end) row, overlaps one of the sorted disjoint spans."""
    if not len(spans) or not len(tokens):
        return np.zeros(len(tokens), dtype=bool)
    k = np.searchsorted(spans[:, 1], tokens[:, 0], "right")
    inside = k < len(spans)
    return inside & (spans[np.minimum(k, len(spans) - 1), 0] < tokens[:, 1])


def masked_texts(formatted: str, tokens: np.ndarray, mask: np.ndarray, spans: np.ndarray) -> list[str]:
    """What the masked tokens cover of each span, unescaped."""
    covered = tokens[mask]
    out = []
    first = np.searchsorted(covered[:, 1], spans[:, 0], "right")
    last = np.searchsorted(covered[:, 0], spans[:, 1], "left")
    for (a, b), i, j in zip(spans.tolist(), first.tolist(), last.tolist(), strict=True):
        parts, at = [], a
        for s, e in covered[i:j].tolist():
            s, e = max(s, at), min(e, b)
            if e > s:
                parts.append(formatted[s:e])
                at = e
        out.append(unescape("".join(parts)))
    return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _format(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.add_special_tokens([TURN, END])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [render([(t["role"] or "", t["text"] or "") for t in turns]) for turns in part.column(1).to_pylist()]
                codes = model.encode_batch([m[0] for m in made], add_special_tokens=False)
                ids, masks, learned = [], [], []
                for (text, spans), code in zip(made, codes, strict=True):
                    learn = np.array([s[:2] for s in spans if s[2] and s[1] > s[0]], dtype=np.int64).reshape(-1, 2)
                    tokens = np.array(code.offsets, dtype=np.int64).reshape(-1, 2)
                    mask = loss_mask(tokens, learn)
                    ids.append(code.ids)
                    masks.append(mask.tolist())
                    learned.append("".join(masked_texts(text, tokens, mask, learn)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_())), pa.array(learned, pa.string())], ["conv_id", "formatted", "ids", "loss_mask", "loss_text"])

    return run


def formatted(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, formatted, ids, loss_mask, loss_text), a row for each conversation.

    Turns go by turn, then role and text; null turns come first, null roles and texts are empty, repeated
    rows are turns of their own, and each row without a conv_id is a conversation of its own.  Assistant texts are to
    be learned.  Other columns are ignored, and an empty table gives an empty result.  A conversation is
    formatted in one task, as it is one sequence of tokens.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = conversations.select("conv_id", "turn", "role", "text", lone.alias("__lone"))
    grouped = rows.groupBy("conv_id", "__lone").agg(turns.alias("turns")).drop("__lone")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return grouped.mapInArrow(_format(tokenizer or default_tokenizer()), f"conv_id {kind}, formatted string, ids array<int>, loss_mask array<boolean>, loss_text string")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, learned in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = read(text)
            body = "".join(f"{r}\n{t}\n" for r, t in turns)
            out.append((len(turns), hashlib.sha256(body.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
        cols = list(zip(*out, strict=True)) or [()] * 5
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest(made: DataFrame) -> DataFrame:
    kind = made.schema["conv_id"].dataType.simpleString()
    return made.select("conv_id", "formatted", "loss_text").mapInArrow(_read_back, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _oracle() -> str:
    def escaped(column: str) -> str:
        sql = f"replace({column}, '{SIGN}', '{SIGN}0')"
        for c in CONTROLS:
            sql = f"replace({sql}, '{c}', '{c[0]}{SIGN}1{c[1:]}')"
        return sql

    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + len(END) + 2} + length(replace({escaped('role')}, chr(10), '{SIGN}2')) + length({escaped('text')})) AS BIGINT) AS formatted_chars
FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM c) GROUP BY conv_id, lone
"""


ORACLE_SQL = _oracle()
