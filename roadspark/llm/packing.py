"""Best-fit packing of token sequences: packed per partition, then underfull bins tree-merged as items."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import batch, bounded_batches, drop, materialize, texts
from .tokens import id_bytes

#: Pieces or bins that a task packs at once.
BLOCK = 200_000
#: A bin with no more room than this is emitted by the first round; each later round doubles it.
SLACK = 16
#: Groups whose underfull bins meet in the next round.
FAN_IN = 8


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, best fit decreasing: the fullest open bin with room, or else a new one.

    The open bins are stacked by their room; the bits of one integer tell which rooms exist.
    """
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = bins = 0
    size = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = size[i]
        if fit := rooms >> n:
            room = n + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        bin_of[i], offset[i] = b, capacity - room
        if left := room - n:
            stacks[left].append(b)
            rooms |= 1 << left
    return bin_of, offset


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int) -> DataFrame:
    """Tokenise and pack each partition: a row for each piece with its local bin, offset there and the bin's fill."""
    bounded_batches(docs.sparkSession)
    kinds = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "part": "int", "bin": "long", "offset": "long", "fill": "long"}
    schema = pa.schema([(n, pa.int32() if k == "int" else pa.int64()) for n, k in kinds.items()])

    def packed(rows: list[tuple], part: int, block: int) -> pa.RecordBatch:
        doc, piece, start, length, crc = zip(*rows)
        size = np.array(length, np.int64)
        bin_of, offset = best_fit(size, capacity)
        fill = np.bincount(bin_of, size).astype(np.int64)[bin_of]
        number = (part << 36 | block << 20) + bin_of
        return batch(schema, (doc, piece, start, size, crc, np.full(len(rows), part, np.int32), number, offset, fill))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, rows = TaskContext.get().partitionId(), 0, []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                ids = id_bytes(tokenizer, text) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
                    if len(rows) == BLOCK:
                        yield packed(rows, part, block)
                        block, rows = block + 1, []
        if rows:
            yield packed(rows, part, block)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def merged(bins: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """Pack the bins of each group as items: (bin, part, into, base, fill) with the new bin, the place in it, its fill."""
    kinds = {"bin": "long", "part": "int", "into": "long", "base": "long", "fill": "long"}
    schema = pa.schema([(n, pa.int32() if k == "int" else pa.int64()) for n, k in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .hamming import whole_groups

        for t in whole_groups(batches, ["part"]):
            part, number, fill = (t.column(c).to_numpy() for c in ("part", "bin", "fill"))
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                for block, lo in enumerate(range(0, len(own), BLOCK)):
                    at = own[lo : lo + BLOCK]
                    into, base = best_fit(fill[at], capacity)
                    full = np.bincount(into, fill[at]).astype(np.int64)[into]
                    yield batch(schema, (number[at], part[at], (level << 57 | p << 36 | block << 20) + into, base, full))

    dealt = bins.withColumn("part", (F.col("part") / FAN_IN).cast("int")).repartition(max(1, groups), "part")
    return dealt.sortWithinPartitions("part", "bin").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = 2048,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text's ids are followed by id 0; only what is longer than ``capacity`` is cut, into pieces of that length with
    a shorter last one. Every partition packs its pieces best fit decreasing. Bins with almost no room are final;
    the others of ``FAN_IN`` partitions meet as items of the next round, until one group is left; the room that makes
    a bin final doubles each round, so that the groups stay small. Null and empty texts are the single id 0, and pack
    like any other; repeated rows and rows without doc_id are packed each by itself; an empty table gives no rows.
    Only lengths and places are shuffled, never texts; each round is stored, so a lost task repeats the same bins.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    pieces = materialize(token_pieces(docs, id_col, text_col, path, capacity), "pieces")
    groups = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    slack, level = SLACK, 1
    bins = pieces.where((F.col("offset") == 0) & (F.col("fill") < capacity - slack)).select("bin", "part", "fill")
    moves = None
    while True:
        groups = -(-groups // FAN_IN)
        done = materialize(merged(bins, groups, capacity, level), f"merge{level}")
        step = done.select("bin", "into", "base")
        if moves is None:
            moves = step
        else:  # what lay in a bin that moved again lies deeper in the new one
            again = step.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("base").alias("more"))
            moves = moves.join(again, "into", "left").select(
                "bin", F.coalesce("next", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")
            )
        if groups == 1:
            break
        slack, level = 2 * slack, level + 1
        bins = done.where((F.col("base") == 0) & (F.col("fill") < capacity - slack)).select(F.col("into").alias("bin"), "part", "fill")
    return pieces.join(moves, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
