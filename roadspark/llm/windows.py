"""Which windows of a corpus repeat: minimizers choose a few places of each text, and only shared ones are followed.

A window of ``size`` tokens has one minimizer, the k-gram of least hash in it (the first on ties). It depends on the
window alone, so equal windows have equal minimizers: windows whose minimizer occurs once cannot repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hamming import runs
from .store import Kept, batch, bounded_batches, materialize, texts, utf8

#: Tokens handled at once; longer texts are cut into overlapping parts.
PART = 1 << 16
#: Low bits of a k-gram's rank that hold its place, so that the first of equals is least.
PLACE_BITS = 28
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass(frozen=True)
class Tokens:
    """How a text becomes hashed tokens, and which windows of them are looked for."""

    size: int
    gram: int
    hashed: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_ODD, PART + 1), _powers(_INVERSE, PART + 1)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(tokens: np.ndarray) -> np.ndarray:
    """Sums of a polynomial in an odd base, whose differences give the hash of any span."""
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * _UP[: len(tokens)], out=sums[1:])
    return sums


def gram_hashes(tokens: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` tokens; another seed gives an independent one."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = prefix_sums(mixed(tokens, seed) if seed else tokens)
    return mixed((sums[size:] - sums[:-size]) * _DOWN[:n], seed)


def parts(at: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Spans of tokens that hold every window of every text once, each at most ``PART`` long."""
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + PART, "right")) - 1
        if j > i:
            yield int(at[i]), int(at[j])
            i = j
            continue
        for lo in range(int(at[i]), int(at[i + 1]) - size + 1, PART - size + 1):
            yield lo, min(lo + PART, int(at[i + 1]))
        i += 1


def stretches(tokens: np.ndarray, at: np.ndarray, kind: Tokens) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with the same minimizer: (text, first window, windows, hash of the minimizer, hash of all).

    The last is a hash of the whole stretch from its first window to its last.
    """
    size, wide = kind.size, kind.size - kind.gram + 1
    for lo, hi in parts(at, size):
        own = tokens[lo:hi]
        n = len(own) - size + 1
        if n <= 0:
            continue
        sums = prefix_sums(own)
        grams = mixed((sums[kind.gram :] - sums[: -kind.gram]) * _DOWN[: len(own) - kind.gram + 1])
        rank = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
        least, span = rank, 1
        while 2 * span <= wide:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        least = np.minimum(least[:n], least[wide - span : wide - span + n])
        new = np.ones(n, bool)
        np.not_equal(least[1:], least[:-1], out=new[1:])
        outside = np.zeros(n, bool)  # windows that reach into the next text
        for e in at[np.searchsorted(at, lo, "right") : np.searchsorted(at, hi, "left")].tolist():
            outside[max(0, e - size + 1 - lo) : max(0, e - lo)] = True
            if e - lo < n:
                new[e - lo] = True
        bound = np.flatnonzero(new | outside)
        real = ~outside[bound]
        first, end = bound[real], np.append(bound[1:], n)[real]
        if not len(first):
            continue
        text = np.searchsorted(at, first + lo, "right") - 1
        place = least[first] & np.uint64((1 << PLACE_BITS) - 1)
        n = end - first
        whole = mixed((sums[end + size - 1] - sums[first]) * _DOWN[first] ^ n.astype(np.uint64), 303)
        yield text, first + lo, n, grams[place.astype(np.int64)], whole


_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 11) for b in range(256)], np.uint64)


def byte_tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = utf8(col)
    return _BYTES[data[at[0] : at[-1]]], at - at[0]


class _WordHashes(Kept):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, 13)
        if len(word) <= 64:
            self[word] = found
        return found


_words = _WordHashes()
#: Words whose hashes a worker keeps.
KEPT = 300_000


def word_tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words are what ASCII white space parts."""
    get, made, at = _words.ready(KEPT).__getitem__, [], [0]
    for t in texts(col):
        own = t.split()
        made.append(np.fromiter(map(get, own), np.uint64, len(own)))
        at.append(at[-1] + len(own))
    return np.concatenate(made) if made else np.empty(0, np.uint64), np.array(at)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, text): row tells texts of the same id apart."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.select("doc_id", F.xxhash64("text").alias("row"), "text")


def compare_stretches(docs: DataFrame, kind: Tokens, within: bool, hot: int) -> DataFrame:
    """(doc_id, copies, grams, hot_grams, again) of each id, stored.

    copies: hashes of stretches that a smaller doc_id has as a whole, so that all their windows repeat. again: those
    that no smaller id has, but the same one at an earlier place; only asked for ``within`` texts. grams: minimizers
    whose windows have yet to be compared, as they have other stretches too; of equal stretches only the first takes
    part. hot_grams: those with more than ``hot`` different stretches. Rows are read as a stream, sorted by minimizer
    and stretch; a task holds at most ``hot`` different stretches of a minimizer.
    """
    names = ("gram", "whole", "doc_id", "start") if within else ("gram", "whole", "doc_id")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            tokens, at = kind.hashed(b.column(1))
            for text, first, _, grams, whole in stretches(tokens, at, kind):
                own = (grams.view(np.int64), whole.view(np.int64), ids[text], first - at[text])[: len(names)]
                one = distinct(grams, whole, text)  # a stretch that a text repeats is one row, or two: source and copy
                if within:
                    rest = np.setdiff1d(np.arange(len(text)), one)
                    one = np.union1d(one, rest[distinct(grams[rest], whole[rest], text[rest])])
                yield batch(schema, (c[one] for c in own))

    out = pa.schema([("doc_id", pa.int64()), ("kind", pa.int8()), ("value", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[pa.RecordBatch] = []

        def put(kind_: int, ids: np.ndarray, values: np.ndarray) -> None:
            if len(ids):
                made.append(batch(out, (ids, np.full(len(ids), kind_, np.int8), values)))

        def firsts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            last = None  # minimizer, stretch, its smallest doc_id, the doc_id just seen
            for b in batches:
                if not b.num_rows:
                    continue
                gram, whole, ids = (b.column(i).to_numpy() for i in range(3))
                head = np.ones(len(gram), bool)
                head[1:] = (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])
                least = ids[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]
                before = np.concatenate((ids[:1], ids[:-1]))
                if last and last[:2] == (gram[0], whole[0]):
                    head[0] = False
                    n = int(np.argmax(head)) if head.any() else len(head)
                    least[:n] = last[2]
                    before[0] = last[3]
                later = ~head & (ids > least) & (ids != before)  # once for each text
                put(0, ids[later], whole[later])
                if within:
                    later = ~head & (ids == least)
                    put(3, ids[later], whole[later])
                last = (gram[-1], whole[-1], least[-1], ids[-1])
                yield gram[head], ids[head]

        for gram, ids, much in runs_in_stream(firsts(), hot):
            first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            size = np.diff(np.append(first, len(gram)))
            differ = size > 1 if within else np.maximum.reduceat(ids, first) != np.minimum.reduceat(ids, first)
            keep = np.repeat(differ, size) | much
            put(2 if much else 1, ids[keep], gram[keep])
            yield from made
            made.clear()
        yield from made

    found = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(emit, ", ".join(f"{n} long" for n in names))
    rows = found.repartition("gram").sortWithinPartitions(*names).mapInArrow(compare, "doc_id long, kind tinyint, value long")
    lists = ("copies", "grams", "hot_grams", "again")
    return materialize(
        rows.groupBy("doc_id").agg(*(F.collect_list(F.when(F.col("kind") == k, F.col("value"))).alias(n) for k, n in enumerate(lists))),
        "stretches",
    )


def distinct(grams: np.ndarray, whole: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The first of each group of equal rows. Rows are sorted by a mixture of the three, and compared in all of them."""
    order = np.argsort(mixed(grams ^ whole * _ODD) + text.astype(np.uint64), kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = (grams[order][1:] == grams[order][:-1]) & (whole[order][1:] == whole[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.sort(order[~same])


def known(text: np.ndarray, values: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Flags of the stretches whose value is in the list of its text."""
    keep = np.zeros(len(text), bool)
    bound = runs([text])
    for lo, hi in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if len(own := lists[text[lo]]):
            keep[lo:hi] = np.isin(values[lo:hi], own)
    return keep


class Copies:
    """Which stretches of a batch of texts an earlier place has as a whole; to be asked in their order."""

    def __init__(self, copies: pa.Array, again: pa.Array | None = None):
        self.copies, self.again = list(lists_of(copies)), list(lists_of(again)) if again is not None else None
        self.some = any(map(len, self.copies)) or bool(self.again) and any(map(len, self.again))
        self.seen: set[tuple[int, int]] = set()

    def flags(self, text: np.ndarray, whole: np.ndarray) -> np.ndarray:
        whole = whole.view(np.int64)
        out = known(text, whole, self.copies)
        if self.again is not None:
            for i in np.flatnonzero(known(text, whole, self.again)).tolist():
                key = (int(text[i]), int(whole[i]))
                out[i] = out[i] or key in self.seen  # the first one of the text is the source
                self.seen.add(key)
        return out


def runs_in_stream(parts_: Iterator[tuple[np.ndarray, np.ndarray]], hot: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, ids, hot) of sorted keys that come in parts: whole runs, or parts of a run of more than ``hot`` rows."""
    key, ids, running = np.empty(0, np.int64), np.empty(0, np.int64), None
    for more, more_ids in parts_:
        key, ids = np.concatenate((key, more)), np.concatenate((ids, more_ids))
        if running is not None:
            n = int(np.searchsorted(key, running, "right"))
            if n:
                yield key[:n], ids[:n], True
            key, ids = key[n:], ids[n:]
            running = None if len(key) else running
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield from _by_heat(key[:last], ids[:last], hot)
            key, ids = key[last:], ids[last:]
        if len(key) > hot:
            running = key[-1]
            yield key, ids, True
            key, ids = key[:0], ids[:0]
    if len(key):
        yield from _by_heat(key, ids, hot)


def _by_heat(key: np.ndarray, ids: np.ndarray, hot: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    large = np.repeat(size > hot, size)
    for own, flag in ((large, True), (~large, False)):
        if own.any():
            yield key[own], ids[own], flag


def cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary column of these spans of the data."""
    at = np.zeros(len(start) + 1, np.int32)
    np.cumsum(size, out=at[1:])
    index = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data[index])])


def span_lists(spans: DataFrame) -> DataFrame:
    """(doc_id, rows, starts, lengths): the spans (doc_id, row, start, length) of each id, at most as many as its tokens."""
    return spans.groupBy("doc_id").agg(*(F.collect_list(c).alias(f"{c}s") for c in ("row", "start", "length")))


def covered(n: int, starts, lengths) -> np.ndarray:
    """Which of n tokens lie in some span."""
    change = np.zeros(n + 1, np.int64)
    if starts is not None and len(starts):
        np.add.at(change, np.asarray(starts, np.int64), 1)
        np.add.at(change, np.asarray(starts, np.int64) + np.asarray(lengths, np.int64), -1)
    return np.cumsum(change[:n]) > 0


def lists_of(col: pa.Array) -> Iterator[np.ndarray]:
    """Each list of longs; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    values, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    for i in range(len(col)):
        yield values[at[i] : at[i + 1]] if col[i].is_valid else values[:0]

