"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once: each turn is a turn mark, its role, a text mark, its text and an end
mark. The marks are special tokens of their own; inside roles and texts a backslash is doubled and
"<|" becomes "<\\|", so no text can hold a mark and the rendering can be undone. The whole rendering
is encoded once, with offsets; the assistant texts' spans and the token spans, both sorted, are
intersected by binary search. Marks are never part of a token with text, so the mask is exact.

Defined cases: a null role or text is empty; turns order by (turn, role, text), so repeated turns
stay, next to each other; each row with a null conv_id is a conversation of its own; bytes that aren't
UTF-8 are read as U+FFFD; an empty table gives an empty result. Other columns play no part. A conversation
becomes one row, so the longest one must fit a task.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNED_ROLE = "assistant"
FORMATTED = "conv_id {0}, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]], role: str = LEARNED_ROLE) -> tuple[str, np.ndarray]:
    """The formatted conversation, and the (start, end) code points of the texts to learn."""
    parts, spans, at = [], [], 0
    for who, text in turns:
        head, body = f"{TURN}{escape(who)}{TEXT}", escape(text)
        if who == role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Undoes render()."""
    return [tuple(map(unescape, turn.removeprefix(TURN).split(TEXT))) for turn in formatted.split(END)[:-1]]


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens overlap a span; all three are sorted."""
    mask = np.zeros(len(starts) + 1, dtype=np.int64)
    first, last = np.searchsorted(ends, spans[:, 0], "right"), np.searchsorted(starts, spans[:, 1], "left")
    some = first < last
    np.add.at(mask, first[some], 1)
    np.add.at(mask, last[some], -1)
    return np.cumsum(mask[:-1]) > 0


_tokenizers: dict = {}


def tokenizer(path: str):
    """The tokenizer file's tokenizer, with the three marks as special tokens."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer, processors

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = False
        made.post_processor = processors.ByteLevel(trim_offsets=False)
        made.add_special_tokens([AddedToken(mark, normalized=False, special=True) for mark in (TURN, TEXT, END)])
        _tokenizers[path] = made
    return _tokenizers[path]


def format_conversations(df: DataFrame, tokenizer_path: str, role: str = LEARNED_ROLE) -> DataFrame:
    """One row per conversation of ``df`` (conv_id, turn, role, text): rendering, tokens with offsets, loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                rendered = [render([(t["role"] or "", t["text"] or "") for t in turns], role) for turns in own.column(1).to_pylist()]
                columns: tuple[list, ...] = ([], [], [], [])
                for (_, spans), found in zip(rendered, tokenizer(tokenizer_path).encode_batch([f for f, _ in rendered], add_special_tokens=False), strict=True):
                    offsets = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
                    for column, value in zip(columns, (found.ids, offsets[:, 0], offsets[:, 1], mask_tokens(offsets[:, 0], offsets[:, 1], spans)), strict=True):
                        column.append(value)
                kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([f for f, _ in rendered], pa.string()), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], ["conv_id", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask"])

    def told(name: str) -> Column:
        return F.make_valid_utf8(F.coalesce(F.col(name), F.lit(""))).alias(name)

    turns = df.select("conv_id", F.struct("turn", told("role"), told("text")).alias("t"))
    own = F.transform(F.array_sort("turns"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    grouped = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.collect_list("t").alias("turns"))
    grouped = grouped.unionByName(turns.filter("conv_id is null").select("conv_id", F.array("t").alias("turns"))).select("conv_id", own)
    return grouped.mapInArrow(run, FORMATTED.format(df.schema["conv_id"].dataType.simpleString()))


def learned_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The text under the mask, unescaped: each run of masked tokens is one assistant text."""
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return "".join(unescape(formatted[starts[a] : ends[b]]) for a, b in zip(first, last, strict=True))


def formatted_digest(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from format_conversations()."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                starts, ends, mask = (np.asarray(batch.column(c)[k].values.to_numpy(zero_copy_only=False)) for c in (2, 3, 4))
                turns, learned = turns_of(text), learned_text(text, starts, ends, mask)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds))], names)

    schema = f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "token_starts", "token_ends", "loss_mask").mapInArrow(run, schema)
