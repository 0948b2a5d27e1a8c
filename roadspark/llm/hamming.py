"""Links between 64-bit fingerprints at a small Hamming distance: pigeonhole buckets, bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: Rows of a bucket that one task compares with each other; larger buckets are dealt out as pairs of chunks.
CHUNK = 4096
#: Buckets below this size are compared side by side in one set of bit planes.
SMALL = 64


def blocks(parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``parts`` nearly equal blocks of 64 bits."""
    cut = [64 * i // parts for i in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cut, cut[1:])]


def table_bits(parts: int, radius: int) -> int:
    """The bits below the number of the table in a key."""
    return max(sum(bits for _, bits in chosen) for chosen in combinations(blocks(parts), parts - radius))


def planes(fps: np.ndarray) -> list[int]:
    """Bit planes: the i-th bit of plane b is bit b of the i-th fingerprint."""
    rows = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little")
    return [int.from_bytes(p.tobytes(), "little") for p in packed]


def _bits(mask: int, n: int) -> np.ndarray:
    raw = np.frombuffer(mask.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little", count=n))


def _int(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def within(vertical: list[int], shift: int, alive: int, radius: int) -> int:
    """Lanes i of ``alive`` whose fingerprint differs in at most ``radius`` bits from that of lane i + shift.

    The counters of all lanes are vertical too: planes of a binary count, to which a carry-save adder puts one plane
    of differences at a time. A lane leaves once its count exceeds the radius; the block ends when none is left.
    """
    width = radius.bit_length()
    count = [0] * width
    for plane in vertical:
        carry = (plane ^ (plane >> shift)) & alive
        for k in range(width):
            count[k], carry = count[k] ^ carry, count[k] & carry
        alive &= ~carry  # beyond what the counter holds
        if not alive:
            return 0
    if radius + 1 == 1 << width:
        return alive
    above, equal = 0, alive
    for k in reversed(range(width)):
        if radius >> k & 1:
            equal &= count[k]
        else:
            above |= equal & count[k]
            equal &= ~count[k]
    return alive & ~above


def _roots_of(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        i = root[i]
    return i


def _join(root: np.ndarray, hit: np.ndarray, shift: int, verify: Callable[[int, int], bool] | None) -> np.ndarray:
    """Union the rows of each hit with the row ``shift`` below it, unless they are connected already."""
    hit = hit[root[hit] != root[hit + shift]]
    if not len(hit):
        return root
    for i, j in zip(hit.tolist(), (hit + shift).tolist()):
        a, b = _roots_of(root, i), _roots_of(root, j)
        if a != b and (verify is None or verify(i, j)):
            root[max(a, b)] = min(a, b)
    while not np.array_equal(root, up := root[root]):
        root = up
    return root


def forest(fps: np.ndarray, group: np.ndarray, largest: int, radius: int) -> np.ndarray:
    """For each row the first row of its component among the rows of its group, linked within the radius.

    Rows of a group are neighbours; no group has more than ``largest`` rows. Distances are counted bit-sliced.
    """
    n = len(fps)
    root = np.arange(n)
    vertical = planes(fps)
    for shift in range(1, min(largest, n)):
        same = group[:-shift] == group[shift:]
        alive = _int(same)
        if not alive:
            break
        root = _join(root, _bits(within(vertical, shift, alive, radius), n), shift, None)
    return root


def verified_forest(fps: np.ndarray, bound: np.ndarray, table: np.ndarray, radius: int, parts: int, verify: Callable[[int, int], bool] | None) -> np.ndarray:
    """As :func:`forest` for groups that begin at each bound, pair by pair, where ``verify`` has the last word on a link.

    A pair that agrees in the blocks of several tables is left to the first of them, so it is verified once.
    """
    n = len(fps)
    root, end, at, shift = np.arange(n), np.repeat(bound[1:], np.diff(bound)), np.arange(n), 1
    tables = list(combinations(blocks(parts), parts - radius))
    while True:
        at = at[at + shift < end[at]]
        if not len(at):
            return root
        differ = fps[at] ^ fps[at + shift]
        near = np.bitwise_count(differ) <= radius
        hit, differ = at[near], differ[near]
        if verify and len(hit):
            first = np.full(len(hit), len(tables))
            for number in reversed(range(len(tables))):
                mask = np.uint64(sum(((1 << bits) - 1) << lo for lo, bits in tables[number]))
                first[(differ & mask) == 0] = number
            hit = hit[first == table[hit]]
        root = _join(root, hit, shift, verify)
        shift += 1


def parts_for(rows: int) -> int:
    """Blocks so many that buckets stay small, though fingerprints are not spread evenly; any number gives the same links."""
    return 4 if rows < 1 << 22 else 5 if rows < 1 << 26 else 6 if rows < 1 << 32 else 7


def bucket_cells(fps: DataFrame, fp: str, radius: int, parts: int, chunk: int) -> DataFrame:
    """``fps`` with columns key and cell: two fingerprints within the radius share a (key, cell) at least once.

    Of ``parts`` blocks at most ``radius`` differ, so some ``parts - radius`` blocks agree: one key for each choice.
    Keys of a single row go; a key of more than ``chunk`` rows is dealt out as all pairs of its chunks.
    """
    keys, width = [], table_bits(parts, radius)
    for number, chosen in enumerate(combinations(blocks(parts), parts - radius)):
        key = F.lit(0).cast("long")
        for lo, bits in chosen:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << bits) - 1)))
        keys.append(key.bitwiseOR(F.lit(number << width)))
    spread = fps.withColumn("key", F.explode(F.array(*keys)))
    counts = materialize(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    if parts == 4 and radius == 3:  # four blocks of 16 bits have 2**18 keys at most, 4 MB
        counts = F.broadcast(counts)
    met = spread.join(counts, "key").withColumn("c", F.ceil(F.col("n") / chunk).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64(fp, F.lit(7)), F.col("c")).cast("int"))
    other = F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda j: j != F.col("own"))
    cells = F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(
        F.transform(other, lambda j: F.least(j, F.col("own")) * F.col("c") + F.greatest(j, F.col("own")))
    )
    return met.withColumn("cell", F.explode(cells)).drop("n", "c", "own")


def runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where a new key begins, in rows that lie sorted by keys; the end is last."""
    if not len(keys[0]):
        return np.zeros(1, np.int64)
    change = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [len(keys[0])]))


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of sorted rows that never part a group: what follows the last change of key waits for more."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        at = runs([table.column(k).to_numpy() for k in by])
        cut = int(at[-2])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        rows = table.num_rows - cut
        least = max(least, 2 * rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def hamming_links(
    fps: DataFrame,
    fp: str,
    node: str,
    radius: int = 3,
    parts: int = 5,
    chunk: int = CHUNK,
    sliced: bool = True,
    text: str | None = None,
    verify: Callable[[bytes, bytes], bool] | None = None,
) -> DataFrame:
    """(a, b) links that span the components of fingerprints within ``radius`` bits; node tells the rows apart.

    Within a cell, a component of m rows gives m - 1 links to its first row, never all pairs; every pair within the
    radius is compared in some cell, so no link between different fingerprints is lost. ``sliced`` compares bit
    planes; else pairs are counted one by one, and ``verify`` has the last word on each, from the rows' ``text``.
    """
    kind = fps.schema[node].dataType.simpleString()
    width = table_bits(parts, radius)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", "cell"], 20_000 if verify else 50_000):
            key, cell = (t.column(c).to_numpy() for c in ("key", "cell"))
            value, ids = t.column("fp").to_numpy().view(np.uint64), t.column("node").combine_chunks()
            at = runs([key, cell])
            if sliced:
                size = np.diff(at)
                group = np.repeat(np.arange(len(size)), size)
                root = np.arange(len(value))
                if (few := size[group] < SMALL).any():
                    own = np.flatnonzero(few)
                    root[own] = own[forest(value[own], group[own], SMALL, radius)]
                for g in np.flatnonzero(size >= SMALL):
                    own = np.arange(at[g], at[g + 1])
                    root[own] = own[forest(value[own], group[own], len(own), radius)]
            else:
                said = [x.encode() for x in t.column("text").to_pylist()] if verify else None
                check = (lambda i, j: verify(said[i], said[j])) if verify else None
                root = verified_forest(value, at, key >> width, radius, parts, check)
            linked = np.flatnonzero(root != np.arange(len(root)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(linked)), ids.take(pa.array(root[linked]))], ["a", "b"])

    columns = [F.col(fp).alias("fp"), F.col(node).alias("node"), *([F.col(text).alias("text")] if text else [])]
    dealt = bucket_cells(fps.select(*columns), "fp", radius, parts, chunk)
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell", "fp")
    return dealt.mapInArrow(compare, f"a {kind}, b {kind}")
