"""Chat formatting with a loss mask aligned by offsets.

A conversation is rendered whole, encoded once with offsets, and a token is under the loss mask if its span meets an
assistant turn's span: both lists are sorted, so the spans of each turn are found by binary search. The template's
marks are added tokens, at which the tokenizer splits, so no token straddles the end of a turn.

Template: <|turn|>role<|text|>text<|end|> for each turn. In roles and texts every control string (the marks above and
those of common chat templates) has its first character escaped by a backslash code, and backslashes are
escaped first, so the rendering can be reversed exactly.

Null roles and texts count as empty. Turns are ordered by turn (nulls first), then role, then text; repeated rows
are turns of their own. Rows with a null conversation id form one conversation. An empty table gives an empty
result. Other columns are not read. A conversation is handled as a whole by one task; that is what it is.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import public_path

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_CODES = {"<": "\\l", "[": "\\b"}
_BACK = {"\\e": "\\", "\\l": "<", "\\b": "["}
_TURN = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _CODES[m[0][0]] + m[0][1:], text.replace("\\", "\\e"))


def unescape(text: str) -> str:
    return re.sub(r"\\[elb]", lambda m: _BACK[m[0]], text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts, in order."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role or '')}{TEXT}", escape(text or "")
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = [(m[1], m[2]) for m in _TURN.finditer(formatted)]
    if sum(len(r) + len(t) for r, t in turns) + len(turns) * len(TURN + TEXT + END) != len(formatted):
        raise ValueError("not a formatted conversation")
    return [(unescape(r), unescape(t)) for r, t in turns]


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token whose span meets one of the spans; all are sorted, so a binary search finds the tokens of each."""
    change = np.zeros(len(starts) + 1, np.int32)
    if spans:
        a, b = np.array(spans).T
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        np.add.at(change, lo, 1)
        np.add.at(change, np.maximum(lo, hi), -1)
    return (np.cumsum(change[:-1]) > 0).astype(np.int32)


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The text under the mask; tokens that share a character (its bytes) count it once."""
    on = np.asarray(mask, bool)
    starts, ends = np.asarray(starts, np.int64)[on], np.asarray(ends, np.int64)[on]
    if not len(starts):
        return ""
    reach = np.maximum.accumulate(ends)
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])  # tokens that do not go on where the text before them ends
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(starts) - 1)
    return unescape("".join([formatted[a:b] for a, b in zip(starts[fresh].tolist(), reach[last].tolist(), strict=True)]))


@functools.lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
    return t


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))


def _format(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts, lists = [], ([], [], [], [])
                for turns in part.column("turns").to_pylist():
                    text, spans = render([(x["role"], x["text"]) for x in turns])
                    enc = t.encode(text, add_special_tokens=False)
                    starts, ends = np.array(enc.offsets, np.int32).reshape(-1, 2).T
                    texts.append(text)
                    for held, v in zip(lists, (np.array(enc.ids, np.int32), starts, ends, token_mask(starts, ends, spans)), strict=True):
                        held.append(v)
                yield pa.RecordBatch.from_arrays([part.column("conv"), pa.array(texts, pa.string()), *map(_lists, lists)], ["conv", "formatted", "input_ids", "token_start", "token_end", "loss_mask"])

    return run


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per conversation: id, formatted, input_ids, token_start, token_end, loss_mask."""
    kind = dict(conversations.dtypes)[conv_col]
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = conversations.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    schema = f"conv {kind}, formatted string, input_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<int>"
    return rows.mapInArrow(_format(tokenizer or public_path()), schema).withColumnRenamed("conv", conv_col)
