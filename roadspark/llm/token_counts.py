"""Token counts of sections: whole documents are encoded once, token spans are interval-joined to sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import batch, bounded_batches, texts
from .tokens import byte_encoder

RULES = ("start", "overlap", "split")


def token_ends(encoder, size: np.ndarray, text: bytes) -> np.ndarray:
    """The end of each token of the text, in bytes; a token may end within a character."""
    return np.cumsum(size[np.asarray(encoder.encode_to_numpy(text.decode("utf-8", "replace")), np.int64)])


def line_starts(data: np.ndarray) -> np.ndarray:
    """Where each section starts, in bytes: a section is a line with its line feed; an empty text is one section."""
    at = np.flatnonzero(data == 10) + 1
    return np.concatenate(([0], at[at < len(data)]))


def allocate(ends: np.ndarray, starts: np.ndarray, size: int, rule: str) -> np.ndarray:
    """Tokens of each section by an interval join of the tokens' spans to the sections' spans.

    start: a token counts where it starts. overlap: where most of its bytes lie, the first such section on ties.
    split: in each section by the share of its bytes there.
    """
    begins = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(starts, begins, "right") - 1
    if rule == "start":
        return np.bincount(first, minlength=len(starts)).astype(float)
    last = np.searchsorted(starts, ends - 1, "right") - 1
    inside = first == last
    out = np.bincount(first[inside], minlength=len(starts)).astype(float)
    bounds = np.append(starts, size)
    for t in np.flatnonzero(~inside).tolist():
        own = np.arange(first[t], last[t] + 1)
        share = np.minimum(bounds[own + 1], ends[t]) - np.maximum(bounds[own], begins[t])
        if rule == "split":
            out[own] += share / share.sum()
        else:
            out[own[np.argmax(share)]] += 1
    return out


def section_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: str | None = None,
    rule: str = "overlap",
) -> DataFrame:
    """(doc_id, section, start, end, n_tokens) for each line of each row; start and end count code points.

    Each text is encoded once, as a whole, by a byte-level vocabulary whose ids have known bytes, so the ids give the
    exact spans. A token that crosses the border of two sections is allocated by ``rule`` (see :func:`allocate`); the
    sums over the sections of a text are its number of tokens. Null and empty texts are one section of no tokens;
    repeated rows give repeated sections; an empty table gives none.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = byte_encoder(path)
        for b in batches:
            counts, ids, parts = [], b.column(0), []
            for t in texts(b.column(1)):
                data = np.frombuffer(t, np.uint8)
                starts = line_starts(data)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                at = chars[np.append(starts, len(data))]
                n = allocate(token_ends(encoder, size, t), starts, len(data), rule) if t else np.zeros(1)
                parts.append((np.arange(len(starts)), at[:-1], at[1:], n))
                counts.append(len(starts))
            if parts:
                repeated = ids.take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                yield batch(schema, (repeated, *(np.concatenate(c) for c in zip(*parts))))

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens double")
