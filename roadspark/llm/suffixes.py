"""Repeated byte windows by a depth-limited radix sort of suffixes, and their removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hamming import runs, whole_groups
from .store import batch, drop, materialize, release, texts, utf8
from .windows import Copies, Tokens, byte_tokens, compare_stretches, covered, cut, gram_hashes, keyed, known, lists_of, span_lists, stretches

#: Bytes of a digit of the radix sort.
DIGIT = 8
#: Different stretches of a minimizer beyond which its windows are counted one by one, in aggregates that combine before a shuffle.
HOT = 1 << 15

SPANS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])


def radix_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered through ``depth`` bytes: (suffixes that equal another one of their group, group of each).

    Each most-significant-digit pass sorts within the groups that the passes before left; a suffix alone in its group
    leaves. What is together after the last pass is equal through ``depth`` bytes. Groups lie side by side.
    """
    padded = np.concatenate((data, np.zeros(DIGIT, np.uint8)))
    words = np.ndarray((len(data) + 1,), ">u8", padded.data, strides=(1,))
    active, label = np.arange(len(starts)), group
    for at in range(0, depth, DIGIT):
        if not len(active):
            break
        digit = words[starts[active] + at].astype(np.uint64)
        if depth - at < DIGIT:
            digit >>= np.uint64(8 * (DIGIT - (depth - at)))
        order = np.lexsort((digit, label))
        digit, label, active = digit[order], label[order], active[order]
        change = np.ones(len(active), bool)
        change[1:] = (digit[1:] != digit[:-1]) | (label[1:] != label[:-1])
        first = np.flatnonzero(change)
        size = np.diff(np.append(first, len(active)))
        label = np.repeat(np.arange(len(first)), size)
        keep = np.repeat(size > 1, size)
        label, active = label[keep], active[keep]
    return active, label


def repeated_runs(t: pa.Table, size: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that also start in a document of smaller id: (doc_id, row, first window, windows).

    The table has stretches of windows, sorted by minimizer, bytes and doc_id; whole groups of a minimizer.
    """
    gram, doc, row, start = (t.column(c).to_numpy() for c in ("gram", "doc_id", "row", "start"))
    data, at = utf8(t.column("bytes"))
    same = t.column("bytes").combine_chunks().dictionary_encode().indices
    same = (same.combine_chunks() if isinstance(same, pa.ChunkedArray) else same).to_numpy()
    bound = runs([gram, same])
    head, copies = bound[:-1], np.diff(bound)  # equal stretches lie together, the smallest id first
    windows = at[1:] - at[:-1] - size + 1
    later = doc > np.repeat(doc[head], copies)
    count = windows[head]
    base = np.concatenate(([0], np.cumsum(count)))
    suffix = np.arange(base[-1]) - np.repeat(base[:-1] - at[head], count)
    owner = np.repeat(np.arange(len(head)), count)
    minimizer = np.repeat(np.cumsum(np.concatenate(([0], gram[head][1:] != gram[head][:-1]))), count)
    found, label = radix_groups(data, suffix, minimizer, size)
    least = doc[head][owner]
    if len(found):
        first = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
        of_group = np.minimum.reduceat(least[found], first)
        least[found] = np.repeat(of_group, np.diff(np.append(first, len(found))))
    hit = least < doc[head][owner]  # windows of the first copies; those of later copies repeat all
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])
    lo = np.flatnonzero(new)
    length = np.diff(np.append(lo, len(hit)))
    lo, length = lo[hit[lo]], length[hit[lo]]
    mine = owner[lo]
    offset = lo - base[mine]
    # rows of the smallest id share the stretch's own runs: a text may hold the stretch more than once
    own = np.flatnonzero(~later)
    group_of_row = np.repeat(np.arange(len(head)), copies)[own]
    a, b = np.searchsorted(mine, group_of_row, "left"), np.searchsorted(mine, group_of_row, "right")
    times = b - a
    rows = np.repeat(own, times)
    which = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - a, times)
    full = np.flatnonzero(later)
    return (
        np.concatenate((doc[full], doc[rows])),
        np.concatenate((row[full], row[rows])),
        np.concatenate((start[full], start[rows] + offset[which])),
        np.concatenate((windows[full], length[which])),
    )


def _stretch_rows(met: DataFrame, kind: Tokens) -> DataFrame:
    """(gram, doc_id, row, start, bytes) of the stretches whose windows have to be compared."""
    schema = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, row = b.column(0).fill_null(0).to_numpy(), b.column(1).to_numpy()  # rows without id have no lists
            compared, copies = list(lists_of(b.column(3))), Copies(b.column(4))
            if not any(map(len, compared)):
                continue
            data, at = utf8(b.column(2))
            tokens, own_at = byte_tokens(b.column(2))
            for text, first, n, grams, whole in stretches(tokens, own_at, kind):
                keep = known(text, grams.view(np.int64), compared) & ~copies.flags(text, whole)
                if keep.any():
                    text, first, n, grams = text[keep], first[keep], n[keep], grams[keep]
                    yield batch(schema, (grams.view(np.int64), ids[text], row[text], first - own_at[text], cut(data, first + at[0], n + kind.size - 1)))

    return met.select("doc_id", "row", "text", "grams", "copies").mapInArrow(run, "gram long, doc_id long, row long, start long, bytes binary")


def hot_windows(met: DataFrame, kind: Tokens) -> DataFrame:
    """(a, b, doc_id, row, start) of each window whose minimizer is hot; (a, b) is a 128-bit hash of the window."""
    schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "doc_id", "row", "start")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, row, compared = b.column(0).to_numpy(), b.column(1).to_numpy(), list(lists_of(b.column(3)))
            tokens, at = kind.hashed(b.column(2))
            for text, first, n, grams, _ in stretches(tokens, at, kind):
                keep = known(text, grams.view(np.int64), compared)
                if not keep.any():
                    continue
                text, first, n = text[keep], first[keep], n[keep]
                lo = int(first[0])
                own = tokens[lo : int(first[-1] + n[-1]) + kind.size - 1]
                place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                x, y = (gram_hashes(own, kind.size, seed)[place - lo].view(np.int64) for seed in (101, 202))
                of = np.repeat(text, n)
                yield batch(schema, (x, y, ids[of], row[of], place - at[of]))

    rows = met.where("size(hot_grams) > 0").select("doc_id", "row", "text", "hot_grams")
    return rows.mapInArrow(run, "a long, b long, doc_id long, row long, start long")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, gram: int = 16, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row; kept is the text without repeated bytes, as bytes.

    A byte goes if a window of ``size`` bytes that covers it also starts in a document of smaller id; windows are
    judged on the input. Stretches of windows with one minimizer that a smaller id has as a whole repeat; of the
    others the suffixes are dealt out by minimizer and radix-sorted through ``size`` bytes. Windows of minimizers in
    more than ``hot`` different stretches are told apart by a 128-bit hash instead, in aggregates that combine before
    their shuffle. Null texts are empty; rows of equal doc_id do not bear on each other; rows without doc_id keep all
    and are nobody's source; an empty table gives an empty one.
    """
    own, kind = keyed(docs, id_col, text_col), Tokens(size, gram, byte_tokens)
    lists = compare_stretches(own, kind, False, hot)
    release(docs.sparkSession)
    met = own.join(lists, "doc_id", "left")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["gram"]):
            doc, row, start, n = repeated_runs(t, size)
            yield batch(SPANS, (doc, row, start, n + size - 1))

    dealt = _stretch_rows(met, kind).repartition("gram").sortWithinPartitions("gram", "bytes", "doc_id")
    spans = dealt.mapInArrow(sort, "doc_id long, row long, start long, length long")
    if lists.where("size(hot_grams) > 0").take(1):
        windows = materialize(hot_windows(met, kind), "hot")
        first = materialize(windows.groupBy("a", "b").agg(F.min("doc_id").alias("first")), "first")
        more = windows.join(first, ["a", "b"]).where("doc_id > first")
        more = materialize(more.select("doc_id", "row", "start", F.lit(size).cast("long").alias("length")), "spans")
        drop(windows, first)
        spans = spans.unionByName(more)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, copies = b.column(1).to_numpy(), Copies(b.column(3))
            where: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
            if copies.some:
                tokens, at = byte_tokens(b.column(2))
                for text, first, n, _, whole in stretches(tokens, at, kind):
                    keep = np.flatnonzero(copies.flags(text, whole))
                    bound = runs([text[keep]])
                    for lo, hi in zip(bound[:-1], bound[1:]):
                        i, own = int(text[keep[lo]]), keep[lo:hi]
                        where[i].append((first[own] - at[i], n[own] + size - 1))
            rows = []
            for i, (t, *found) in enumerate(zip(texts(b.column(2)), *(lists_of(b.column(c)) for c in (4, 5, 6)))):
                mine = found[0] == row[i]
                where[i].append((found[1][mine], found[2][mine]))
                starts, lengths = (np.concatenate(x) for x in zip(*where[i]))
                if not len(starts):
                    rows.append((len(t), 0, 0, t))
                    continue
                gone = covered(len(t), starts, lengths)
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                rows.append((len(t), len(t) - len(kept), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)), kept))
            if rows:
                yield batch(schema, (b.column(0), *zip(*rows)))

    full = met.select("doc_id", "row", "text", "copies").join(span_lists(spans), "doc_id", "left")
    full = full.select("doc_id", "row", "text", "copies", "rows", "starts", "lengths")
    return full.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`suffix_dedup`."""
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

