"""Nearest neighbours by inner product along shifted Hilbert curves: neighbouring key windows, merged and reranked."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hamming import runs, whole_groups
from .store import batch, bounded_batches

#: Rows that the curves are fitted on at most, and queries that the window is measured on at most: those of least hash.
SAMPLE, PROBES = 4096, 64
#: Dimensions and bits of each of a curve's keys, and the curves at hand.
DIMENSIONS, BITS, CURVES = 8, 7, 4
#: Curves that are merged at least, as neighbours that one parts may lie together along another.
LEAST = 2
#: Rows of a block of consecutive keys as far as the sample tells them apart; blocks at most; rows and queries of a cell.
BLOCK, BLOCKS, CELL = 128, 1024, 16384
#: Share of the probes' true neighbours that the window must hold.
RECALL = 0.95


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of cell numbers, by Gray code and rotation of each bit plane."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= np.where(flip, 0, swap) if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


@dataclass
class Curves:
    """Projections, shifts and block borders of each curve."""

    mean: np.ndarray
    norm: float
    axes: list[np.ndarray]
    low: list[np.ndarray]
    width: list[np.ndarray]
    borders: list[np.ndarray]

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """One more component, so that the largest inner product is the least distance among vectors of equal norm."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(1)))
        return np.column_stack((x, rest)) - self.mean

    def keys(self, lifted: np.ndarray, curve: int) -> np.ndarray:
        cell = (lifted @ self.axes[curve] - self.low[curve]) / self.width[curve] * (1 << BITS)
        return hilbert(np.clip(cell, 0, (1 << BITS) - 1).astype(np.int64), BITS)

    def blocks(self, x: np.ndarray, query: bool, curve: int) -> np.ndarray:
        return np.searchsorted(self.borders[curve], self.keys(self.lifted(x, query), curve), "right")


def fit(sample: np.ndarray, norm: float, blocks: int, curves: int, seed: int = 7) -> Curves:
    """Curves from a bounded sample: principal axes first, then random turns of the leading ones, each shifted."""
    made = Curves(np.zeros(sample.shape[1] + 1), norm, [], [], [], [])
    x = made.lifted(sample, False)
    made.mean = x.mean(0)
    x = x - made.mean
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    draw = np.random.default_rng(seed)
    for c in range(curves):
        lead = axes[: DIMENSIONS * (1 if c == 0 else 4)].T
        turn = np.linalg.qr(draw.standard_normal((lead.shape[1], lead.shape[1])))[0]
        own = (lead @ turn)[:, :DIMENSIONS] if c else lead[:, :DIMENSIONS]
        seen = x @ own
        span = np.ptp(seen, axis=0) + 1e-9
        made.axes.append(own)
        made.low.append(seen.min(0) - span * draw.random(seen.shape[1]) * 0.5)
        made.width.append(span * 1.5)
        keys = np.sort(made.keys(x, c))
        made.borders.append(np.unique(keys[np.linspace(0, len(keys), blocks + 1).astype(int)[1:-1]]))
    return made


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, vector, score) of each query's k best other vectors, by exact scores; ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    first = runs([ids])[:-1]
    for lo in range(0, len(q), 512):
        own, own_ids = q[lo : lo + 512], q_ids[lo : lo + 512]
        near = own @ x.T
        a, b = np.searchsorted(ids, own_ids, "left"), np.searchsorted(ids, own_ids, "right")
        for i in np.flatnonzero(b > a).tolist():
            near[i, a[i] : b[i]] = -np.inf
        if len(first) > 2 * k:  # the k-th best of different ids: a repeated row takes no other's place
            each = near if len(first) == len(ids) else np.maximum.reduceat(near, first, axis=1)
            least = -np.partition(-each, k - 1, axis=1)[:, k - 1]
            least = least - 1e-9 * np.maximum(1, np.abs(least))
        else:
            least = np.full(len(own), -np.finfo(float).max)
        row, col = np.nonzero(near >= least[:, None])
        score = np.einsum("ij,ij->i", own[row], x[col])
        order = np.lexsort((-score, ids[col], row))
        row, col, score = row[order], col[order], score[order]
        once = np.ones(len(row), bool)  # an id counts once, by its best row
        once[1:] = (row[1:] != row[:-1]) | (ids[col][1:] != ids[col][:-1])
        row, col, score = row[once], col[once], score[once]
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        bound = runs([row])
        place = np.arange(len(row)) - np.repeat(bound[:-1], np.diff(bound))
        top = place < k
        yield own_ids[row[top]], ids[col[top]], score[top]


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v array<double>) of the rows that take part, and the width of their vectors."""
    v = F.col("v")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.where("id is not null and v is not null and size(v) > 0").where(F.coalesce(fine, F.lit(False)))
    common = own.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    width = common["width"] if common else 0
    return own.where(F.size("v") == width), width


def _probe(rows: DataFrame, probes: np.ndarray, probe_ids: np.ndarray, width: int, k: int) -> list:
    """The true neighbours of a few queries with their vectors, by a scan of all rows."""
    kinds = "query long, id long, score double, v array<double>"
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("v", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, x = b.column(0).to_numpy(), _matrix(b.column(1), width)
                at = {i: j for j, i in enumerate(ids.tolist())}
                for q, i, s in best(probes, probe_ids, x, ids, k):
                    yield batch(schema, (q, i, s, [x[at[j]] for j in i.tolist()]))

    found = rows.mapInArrow(run, kinds).groupBy("query", "id").agg(F.max("score").alias("score"), F.max_by("v", "score").alias("v"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).collect()


def choose_window(curves: Curves, probes: np.ndarray, probe_ids: np.ndarray, truth: list, target: float) -> tuple[int, int]:
    """(curves, blocks to either side): the cheapest choice of ``LEAST`` curves or more whose windows hold ``target`` of
    the true neighbours."""
    blocks = max(len(b) for b in curves.borders) + 1
    if not truth:
        return min(LEAST, len(curves.axes)), blocks
    at = {i: j for j, i in enumerate(probe_ids.tolist())}
    q = probes[[at[r["query"]] for r in truth]]
    x = np.array([r["v"] for r in truth], float)
    apart = np.array([np.abs(curves.blocks(q, True, c) - curves.blocks(x, False, c)) for c in range(len(curves.axes))])
    choices = []
    for c in range(min(LEAST, len(apart)), len(apart) + 1):
        least = apart[:c].min(0)
        for w in range(blocks):
            if (least <= w).mean() >= target:
                choices.append((c * min(blocks, 2 * w + 1), c, w))
                break
    _, c, w = min(choices)
    return c, w


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best found for each row whose id is divisible by ``every``.

    Curves are fitted on at most ``SAMPLE`` rows, the number of curves and the width of their windows on the true
    neighbours of at most ``PROBES`` queries, so that ``recall`` of them is found at the least work; every row is
    indexed. Rows fall into blocks of consecutive keys, queries into the blocks of their windows; a block with many
    rows or queries is dealt out as cells of bounded size. Cells give exact scores, which are merged. Vectors that
    are null, zero, hold nulls or what is not finite, or are not as wide as most, take no part, nor do rows without
    id; rows of one id count once; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows, width = usable(vectors, id_col, vector_col)
    is_query = F.col("id") % every == 0
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(square)).alias("norm")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not total["n"]:
        return spark.createDataFrame([], result)
    least = [F.xxhash64("id"), F.col("id")]
    sample = np.array([r["v"] for r in rows.orderBy(*least).limit(SAMPLE).collect()], float)
    chosen = rows.where(is_query).dropDuplicates(["id"]).orderBy(*least).limit(PROBES).collect()
    if not chosen:
        return spark.createDataFrame([], result)
    probes, probe_ids = np.array([r["v"] for r in chosen], float), np.array([r["id"] for r in chosen])
    blocks = min(BLOCKS, max(1, -(-total["n"] // block)), len(sample))
    curves = fit(sample, total["norm"] or 0.0, blocks, CURVES)
    n_curves, reach = choose_window(curves, probes, probe_ids, _probe(rows, probes, probe_ids, width, k), recall)
    found = _cells(rows, curves, n_curves, reach, width, every, k)
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _cells(rows: DataFrame, curves: Curves, n_curves: int, reach: int, width: int, every: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the best of each cell, for each query in it."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(curves)  # axes and borders: as large as dimensions and blocks
    counted = pa.schema([("curve", pa.int32()), ("block", pa.int32()), ("query", pa.bool_()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1), width)
            for c in range(n_curves):
                for query in (False, True):
                    own = x[ids % every == 0] if query else x
                    at, n = np.unique(shared.value.blocks(own, query, c), return_counts=True)
                    yield batch(counted, ([c] * len(at), at, [query] * len(at), n))

    sizes = [np.zeros((2, len(curves.borders[c]) + 1), np.int64) for c in range(n_curves)]
    sums = rows.mapInArrow(count, "curve int, block int, query boolean, n long").groupBy("curve", "block", "query").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # one row for each block
        sizes[r["curve"]][int(r["query"]), r["block"]] = r["n"]
    # consecutive blocks share a panel of about CELL rows, so that a query has few cells; what is larger is split
    splits = []
    for s in sizes:
        panel = np.unique((np.cumsum(s[0]) - s[0]) // CELL, return_inverse=True)[1]
        ends = np.concatenate(([0], np.cumsum(s[1])))
        at, n = np.arange(s.shape[1]), panel[-1] + 1
        low = np.array([at[panel == p].min() for p in range(n)])
        high = np.append(low[1:], len(at))
        asked = ends[np.minimum(high + reach, len(at))] - ends[np.maximum(low - reach, 0)]
        splits.append((panel, np.maximum(1, -(-np.bincount(panel, s[0]).astype(np.int64) // (2 * CELL))), np.maximum(1, -(-asked // CELL))))

    kinds = "curve int, panel int, salt int, chunk int, query boolean, id long, v array<double>"
    schema = pa.schema([("curve", pa.int32()), ("panel", pa.int32()), ("salt", pa.int32()), ("chunk", pa.int32()), ("query", pa.bool_()), ("id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1), width)
            mix = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for c, (panel, salts, chunks) in enumerate(splits):
                at = panel[shared.value.blocks(x, False, c)]
                times = chunks[at]
                own = np.repeat(np.arange(len(ids)), times)
                chunk = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
                yield batch(schema, ([c] * len(own), at[own], mix[own] % salts[at[own]], chunk, [False] * len(own), ids[own], b.column(1).take(pa.array(own))))
                asks = np.flatnonzero(ids % every == 0)
                if not len(asks):
                    continue
                at = shared.value.blocks(x[asks], True, c)
                lo, hi = panel[np.maximum(at - reach, 0)], panel[np.minimum(at + reach, len(panel) - 1)]
                times = hi - lo + 1
                own = np.repeat(np.arange(len(asks)), times)
                block = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times) + lo[own]
                times = salts[block]
                again = np.repeat(np.arange(len(own)), times)
                salt = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                own, block = asks[own[again]], block[again]
                yield batch(schema, ([c] * len(own), block, salt, mix[own] % chunks[block], [True] * len(own), ids[own], b.column(1).take(pa.array(own))))

    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = ["curve", "panel", "salt", "chunk"]
        for t in whole_groups(batches, by, 4096):
            query, ids, x = (t.column("query").to_numpy(), t.column("id").to_numpy(), _matrix(t.column("v"), width))
            bound = runs([t.column(c).to_numpy() for c in by])
            for lo, hi in zip(bound[:-1].tolist(), bound[1:].tolist()):
                asks = lo + int(np.count_nonzero(~query[lo:hi]))
                if lo < asks < hi:
                    for found in best(x[asks:hi], ids[asks:hi], x[lo:asks], ids[lo:asks], k):
                        yield batch(out, found)

    dealt = rows.mapInArrow(deal, kinds)
    by = ["curve", "panel", "salt", "chunk"]
    return dealt.repartition(*by).sortWithinPartitions(*by, "query").mapInArrow(search, "query_id long, vec_id long, score double")
