"""Shortest paths of all demand inside tasks: a network of bounded size is sent to each, and a task relaxes a block of
sources at once. Only what is asked leaves a task, never the distances from a source to all nodes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hops of all networks that are sent to the tasks at most, 16 bytes each; larger ones are left to joins.
HOPS = 2_000_000
#: Sources of a block at most, distances of a block, and candidates and nodes at a time.
BLOCK, HELD, CHUNK, ROWS = 256, 1 << 24, 1 << 21, 1024
#: Hops into a node up to which they are relaxed side by side with those of other nodes.
SLOTS = 32
#: Distances in 16 bits: what stands for no path, and the units of weights that are tried, all exact in binary.
FAR, UNITS = 0x7FFF, tuple(2.0**-k for k in range(9))


@dataclass
class Net:
    """Hops (u, v, w) sorted by v and u; u and v are places in the sorted ``nodes``."""

    nodes: np.ndarray
    u: np.ndarray
    v: np.ndarray
    w: np.ndarray

    def __post_init__(self) -> None:
        self.degree = np.bincount(self.v, minlength=len(self.nodes))
        self.start = np.cumsum(self.degree) - self.degree
        # the largest unit of which all weights are small multiples; their sums are exact in it as they are in doubles
        fits = (x for x in UNITS if len(self.w) and self.w.min() >= 0 and self.w.max() / x < FAR and (self.w / x == np.floor(self.w / x)).all())
        self.unit = next(fits, None)

    def same(self, other: Net) -> bool:
        return all(np.array_equal(getattr(self, k), getattr(other, k)) for k in ("nodes", "u", "v", "w"))

    def places(self, ids: np.ndarray) -> np.ndarray:
        """The place of each node, -1 for one that the network lacks."""
        at = np.minimum(np.searchsorted(self.nodes, ids), len(self.nodes) - 1)
        return np.where(self.nodes[at] == ids, at, -1) if len(self.nodes) else np.full(len(ids), -1)

    def _met(self, hop: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(hops, where a new v begins, these v) of some hops at a time."""
        step = max(1, CHUNK // width)
        for lo in range(0, len(hop), step):
            at = hop[lo : lo + step]
            to = self.v[at]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            yield at, first, to[first]

    def _relaxed(self, sources: np.ndarray, far: float, w: np.ndarray) -> np.ndarray:
        """The least sum of ``w`` from each source (columns) to each node (rows), ``far`` if there is no path. A round
        relaxes the nodes with a hop from a node that the last one changed: the j-th hops into many nodes at once, all
        hops into a node of many."""
        n = len(self.nodes)
        out = np.full((n, len(sources)), far, w.dtype)
        out[sources, np.arange(len(sources))] = 0
        light = np.argsort(-self.degree, kind="stable")
        light = light[self.degree[light] <= SLOTS]
        heavy = np.flatnonzero(self.degree[self.v] > SLOTS)
        buffer = np.empty((ROWS, len(sources)), w.dtype)
        changed = np.zeros(n, bool)
        changed[sources] = True
        for _ in range(n + 1):
            ready = np.zeros(n, bool)
            ready[self.v[changed[self.u]]] = True
            hop = heavy[changed[self.u[heavy]]]
            changed = np.zeros(n, bool)
            some = light[ready[light]]
            for lo in range(0, len(some), ROWS):
                at = some[lo : lo + ROWS]
                old = out[at]
                new, first, degree = old.copy(), self.start[at], -self.degree[at]
                for j in range(-int(degree[0])):
                    m = int(np.searchsorted(degree, -j))  # nodes of more than j hops
                    own, met = first[:m] + j, buffer[:m]
                    np.take(out, self.u[own], axis=0, out=met, mode="clip")
                    met += w[own, None]
                    np.minimum(new[:m], met, out=new[:m])
                less = (new < old).any(1)
                out[at[less]] = new[less]
                changed[at[less]] = True
            for at, first, to in self._met(hop, len(sources)):
                new = np.minimum.reduceat(out[self.u[at]] + w[at, None], first, axis=0)
                less = (new < out[to]).any(1)
                out[to[less]] = np.minimum(out[to[less]], new[less])
                changed[to[less]] = True
            if not changed.any():
                return out
        raise RuntimeError("distances are not final after as many rounds as there are nodes")

    def search(self, sources: np.ndarray) -> Found:
        """The least cost from each source (columns) to each node (rows)."""
        if self.unit:
            w = (self.w / self.unit).astype(np.uint16)
            out = self._relaxed(sources, FAR, w)
            if int(out.max(initial=0, where=out < FAR)) + int(w.max()) < FAR:  # else a path may have been taken for none
                return Found(self, out, w, self.unit, FAR)
        return Found(self, self._relaxed(sources, np.inf, self.w), self.w, 1.0, np.inf)

    def distances(self, sources: np.ndarray) -> np.ndarray:
        """The least cost from each source (columns) to each node (rows); infinite if there is no path."""
        found = self.search(sources)
        return np.where(found.out == found.far, np.inf, found.out * found.unit)

    def blocks(self, sources: np.ndarray) -> Iterator[np.ndarray]:
        step = max(1, min(BLOCK, HELD // max(1, len(self.nodes)) if self.unit else HELD // 4 // max(1, len(self.nodes))))
        for lo in range(0, len(sources), step):
            yield sources[lo : lo + step]


class Found:
    """Distances in units from a block of sources (columns) to the nodes (rows) of a network."""

    def __init__(self, net: Net, out: np.ndarray, w: np.ndarray, unit: float, far: float) -> None:
        self.net, self.out, self.w, self.unit, self.far = net, out, w, unit, far
        self.last: np.ndarray | None = None

    def cost(self, end: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The distance of some nodes from the sources ``of``; infinite if there is no path."""
        own = self.out[end, of]
        return np.where(own == self.far, np.inf, own * self.unit)

    def before(self, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The last hop of a shortest path from the sources ``of`` to these other nodes: the one from the smallest node.
        What was looked for once is kept."""
        net, width = self.net, self.out.shape[1]
        if self.last is None:
            self.last = np.full(self.out.size, -1, np.int32)
        key = at.astype(np.int64) * width + of
        new = np.unique(key[self.last[key] < 0])
        degree = net.degree[new // width]
        ends = np.cumsum(degree)
        lo = 0
        while lo < len(new):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - degree[lo] + CHUNK, "right")))
            own, n = new[lo:hi], degree[lo:hi]
            node, source = own // width, own % width
            first = np.cumsum(n) - n
            each = np.repeat(np.arange(hi - lo), n)
            hop = np.repeat(net.start[node] - first, n) + np.arange(n.sum())
            tight = np.flatnonzero(self.out[net.u[hop], source[each]] + self.w[hop] == self.out[node, source][each])
            own_, at_ = np.unique(each[tight], return_index=True)  # hops into a node are in order of u
            self.last[own[own_]] = hop[tight[at_]]
            lo = hi
        return self.last[key]

    def walk(self, end: np.ndarray, of: np.ndarray, src: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which pairs are not at their source yet, the hops by which they were reached), from the ends backwards."""
        now, open_, steps = end.copy(), np.flatnonzero(end != src), 0
        while len(open_):
            if steps > len(self.net.nodes):
                raise RuntimeError("a path comes back to one of its nodes: a cycle without cost")
            hop = self.before(now[open_], of[open_])
            yield open_, hop
            now[open_] = self.net.u[hop]
            open_, steps = open_[now[open_] != src[open_]], steps + 1


def networks(hops: dict[str, DataFrame]) -> dict[str, Net] | None:
    """The networks of hops (u, v, w), stored tables; none if they are too large to be sent or have odd weights."""
    if sum(df.count() for df in hops.values()) > HOPS:
        return None
    out = {}
    for name, df in hops.items():
        t = df.select("u", "v", F.col("w").cast("double").alias("w")).where("u is not null and v is not null").toArrow()
        u, v, w = (t.column(c).to_numpy() for c in ("u", "v", "w"))
        if not np.isfinite(w).all():
            return None
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        u, v = at[: len(u)].astype(np.int32), at[len(u) :].astype(np.int32)
        order = np.lexsort((u, v))
        out[name] = Net(nodes, u[order], v[order], w[order])
    return out


def _by_source(od: DataFrame) -> DataFrame:
    """(o, asked): the pairs of each origin in one row, dealt to several tasks for each core, small as they may be."""
    parts = 8 * od.sparkSession.sparkContext.defaultParallelism
    own = od.select(F.col("o").cast("long").alias("o"), F.struct(F.col("d").cast("long").alias("d"), F.col("w").cast("double").alias("w")).alias("a"))
    return own.repartition(parts, "o").groupBy("o").agg(F.collect_list("a").alias("asked"))


def _pairs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(o, d, w, whether both ends are known) of the pairs of a batch."""
    lists = b.column(1)
    size = np.diff(lists.offsets.to_numpy())
    asked = lists.flatten()
    d, o = asked.field(0), b.column(0)
    known = np.repeat(o.is_valid().to_numpy(zero_copy_only=False), size) & d.is_valid().to_numpy(zero_copy_only=False)
    return np.repeat(o.fill_null(0).to_numpy(), size), d.fill_null(0).to_numpy(), asked.field(1), known


def routed(nets: dict[str, Net], od: DataFrame) -> DataFrame:
    """(o, d, w, *names) of each pair, with its least cost in each network; null if there is no path, for a pair without
    demand and for one of one place."""
    kinds = {"o": pa.int64(), "d": pa.int64(), **{n: pa.float64() for n in ("w", *nets)}}
    names = list(nets)
    like = {n: next(m for m in names if nets[m].same(nets[n])) for n in names}  # equal networks are searched once
    searched = {n: nets[n] for n in names if like[n] == n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, d, w, known = _pairs(b)
            weight = w.fill_null(0.0).to_numpy()
            known &= (weight > 0) & (o != d)
            costs: dict[str, np.ndarray] = {}
            for name, net in searched.items():
                cost = costs[name] = np.full(len(o), np.inf)
                src, end = net.places(o), net.places(d)
                own = np.flatnonzero(known & (src >= 0) & (end >= 0))
                own = own[np.argsort(src[own], kind="stable")]
                for block in net.blocks(np.unique(src[own])):
                    lo, hi = np.searchsorted(src[own], [block[0], block[-1] + 1])
                    at = own[lo:hi]
                    cost[at] = net.search(block).cost(end[at], np.searchsorted(block, src[at]))
            made = [pa.array(costs[like[n]], mask=np.isinf(costs[like[n]])) for n in names]
            ends = [pa.array(x, mask=~y) for x, y in ((o, _valid(b, 0)), (d, _valid(b, 1)))]
            yield pa.RecordBatch.from_arrays([*ends, w, *made], schema=pa.schema(list(kinds.items())))

    return _by_source(od).mapInArrow(run, "o long, d long, w double" + "".join(f", `{n}` double" for n in nets))


def _valid(b: pa.RecordBatch, which: int) -> np.ndarray:
    """Whether the origins (0) or destinations (1) of the pairs of a batch are not null."""
    lists = b.column(1)
    if which:
        return lists.flatten().field(0).is_valid().to_numpy(zero_copy_only=False)
    return np.repeat(b.column(0).is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))


def paths(net: Net, od: DataFrame) -> DataFrame:
    """(o, d, w, path) of each pair that has a path: the nodes of a shortest one, the smallest node before each on ties."""
    schema = pa.schema([("o", pa.int64()), ("d", pa.int64()), ("w", pa.float64()), ("path", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, d, w, known = _pairs(b)
            src, end = net.places(o), net.places(d)
            own = np.flatnonzero(known & (src >= 0) & (end >= 0))
            own = own[np.argsort(src[own], kind="stable")]
            for block in net.blocks(np.unique(src[own])):
                lo, hi = np.searchsorted(src[own], [block[0], block[-1] + 1])
                at, found = own[lo:hi], net.search(block)
                of = np.searchsorted(block, src[at])
                there = np.isfinite(found.cost(end[at], of))
                at, of = at[there], of[there]
                if not len(at):
                    continue
                steps = [now := end[at]]
                for open_, hop in found.walk(end[at], of, src[at]):
                    now = now.copy()
                    now[open_] = net.u[hop]
                    steps.append(now)
                walk = np.array(steps)[::-1]  # from the origin, which short paths repeat
                last = np.ones(walk.shape, bool)
                last[:-1] = walk[:-1] != walk[1:]
                size = last.sum(0)
                nodes = net.nodes[walk.T[last.T]]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(nodes))
                yield pa.RecordBatch.from_arrays([pa.array(o[at]), pa.array(d[at]), w.take(pa.array(at)), lists], schema=schema)

    return _by_source(od).mapInArrow(run, "o long, d long, w double, path array<bigint>")


def loads(net: Net, od: DataFrame) -> DataFrame:
    """(u, v, load): the demand of the paths of :func:`paths` over each hop, added up in each task; null for hops that
    only pairs without a demand take."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("load", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, uses, told = np.zeros(len(net.u)), np.zeros(len(net.u), bool), np.zeros(len(net.u), bool)
        for b in batches:
            o, d, w, known = _pairs(b)
            weight, given = w.fill_null(0.0).to_numpy(), w.is_valid().to_numpy(zero_copy_only=False)
            src, end = net.places(o), net.places(d)
            own = np.flatnonzero(known & (src >= 0) & (end >= 0))
            own = own[np.argsort(src[own], kind="stable")]
            for block in net.blocks(np.unique(src[own])):
                lo, hi = np.searchsorted(src[own], [block[0], block[-1] + 1])
                at, found = own[lo:hi], net.search(block)
                of = np.searchsorted(block, src[at])
                there = np.isfinite(found.cost(end[at], of))
                at, of = at[there], of[there]
                for open_, hop in found.walk(end[at], of, src[at]):
                    some = given[at[open_]]
                    total += np.bincount(hop, weight[at[open_]], len(total))
                    uses[hop] = told[hop[some]] = True
        some = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(net.nodes[net.u[some]]), pa.array(net.nodes[net.v[some]]), pa.array(total[some], mask=~told[some])], schema=schema)

    return _by_source(od).mapInArrow(run, "u long, v long, load double")


def priced(net: Net, paths_: DataFrame) -> DataFrame:
    """(o, d, w, hops, cost) of each path, by the cost of its hops; a hop that the network lacks is an error."""
    schema = pa.schema([("o", pa.int64()), ("d", pa.int64()), ("w", pa.float64()), ("hops", pa.int32()), ("cost", pa.float64())])
    n = max(1, len(net.nodes))
    name = net.v.astype(np.int64) * n + net.u

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column(3).offsets.to_numpy())
            at = net.places(b.column(3).flatten().to_numpy())
            of = np.repeat(np.arange(len(size)), size)
            inner = of[1:] == of[:-1]
            u, v = at[:-1][inner], at[1:][inner]
            hop = np.minimum(np.searchsorted(name, v * n + u), max(0, len(name) - 1))
            if len(hop) and (not len(name) or (np.minimum(u, v) < 0).any() or (name[hop] != v * n + u).any()):
                raise RuntimeError("a path has a hop without an arc")
            cost = np.bincount(of[1:][inner], net.w[hop], len(size)) if len(hop) else np.zeros(len(size))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array((size - 1).astype(np.int32)), pa.array(cost)], schema=schema)

    own = paths_.select(*(F.col(c).cast(k) for c, k in (("o", "long"), ("d", "long"), ("w", "double"), ("path", "array<bigint>"))))
    return own.mapInArrow(run, "o long, d long, w double, hops int, cost double")


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): the strong components of hops (u, v), no more than ``HOPS``, named by their largest node; one
    task goes depth-first through all of them."""
    schema = pa.schema([("node", pa.int64()), ("component", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        nodes, at = np.unique(np.concatenate([t.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
        u, v = at[: t.num_rows], at[t.num_rows :]
        order, n = np.argsort(u, kind="stable"), len(nodes)
        to, ends = v[order].tolist(), np.cumsum(np.bincount(u, minlength=n)).tolist()
        next_ = [0, *ends[:-1]]  # the hop of each node that is looked at next
        found, low, of, count = [0] * n, [0] * n, [-1] * n, 0
        for root in range(n):
            if found[root]:
                continue
            count += 1
            found[root] = low[root] = count
            way, open_ = [root], [root]
            while way:
                x = way[-1]
                if next_[x] < ends[x]:
                    y = to[next_[x]]
                    next_[x] += 1
                    if not found[y]:
                        count += 1
                        found[y] = low[y] = count
                        way.append(y)
                        open_.append(y)
                    elif of[y] < 0 and found[y] < low[x]:
                        low[x] = found[y]
                    continue
                way.pop()
                if way and low[x] < low[way[-1]]:
                    low[way[-1]] = low[x]
                if low[x] == found[x]:
                    at_ = len(open_) - 1
                    while open_[at_] != x:
                        at_ -= 1
                    name = max(open_[at_:])
                    for y in open_[at_:]:
                        of[y] = name
                    del open_[at_:]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[np.array(of, np.int64)])], schema=schema)

    own = pairs.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    return own.repartition(1).mapInArrow(run, "node long, component long")
