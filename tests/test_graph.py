"""Fixpoints on small graphs against plain Python."""

import itertools
import random

import pytest

from roadspark.operators import graph
from roadspark.operators.aggregates import rank_accuracy


def made(spark, rows):
    return spark.createDataFrame([(u, v, k, float(w)) for u, v, k, w in rows], "u long, v long, k long, length double")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    out = []
    for u, v in itertools.permutations(range(9), 2):
        if draw.random() < 0.22:
            out += [(u, v, k, draw.randrange(1, 6)) for k in range(draw.choice([1, 1, 2]))]
    return out + [(20, 21, 0, 1), (21, 20, 0, 2), (21, 22, 0, 3)]


def shortest(rows):
    nodes = sorted({x for r in rows for x in r[:2]})
    d = {(a, b): 0 if a == b else float("inf") for a in nodes for b in nodes}
    for u, v, _, w in rows:
        d[u, v] = min(d[u, v], w)
    for k, i, j in itertools.product(nodes, nodes, nodes):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    return nodes, d


def test_distances_and_paths(spark, rows):
    nodes, d = shortest(rows)
    od = spark.createDataFrame([(a, b, 1.0) for a in nodes for b in nodes] + [(0, 99, 1.0), (99, 0, 1.0)], "o long, d long, w double")
    arcs = made(spark, rows)
    got = {(r["o"], r["d"]): r["cost"] for r in graph.od_costs(arcs, od).collect()}
    assert got == {p: c for p, c in d.items() if 0 < c < float("inf")}
    paths = graph.od_paths(arcs, od)
    assert {(r["o"], r["d"]) for r in paths.collect()} == {p for p, c in d.items() if c < float("inf")}
    assert all(r["path"][0] == r["o"] and r["path"][-1] == r["d"] for r in paths.collect())
    assert {(r["o"], r["d"]): r["cost"] for r in graph.path_cost(arcs, paths, "length").collect()} == {p: c for p, c in d.items() if c < float("inf")}


def test_search_in_tasks(spark, rows, monkeypatch):
    """Tasks keep no row for each origin and node, and larger networks give the same by joins."""
    from roadspark.operators import evaluate, search

    nodes, d = shortest(rows)
    od = spark.createDataFrame([(a, b, 1.0 + (a > b)) for a in nodes for b in nodes] + [(0, 99, 1.0), (99, 0, 1.0), (0, 3, 0.0), (None, 1, 1.0), (1, None, 1.0)], "o long, d long, w double")
    arcs = made(spark, rows).selectExpr("*", "true car_allowed", "k = 0 bike_allowed", "'safe' safety", "length car_cost_current", "2 * length bike_cost_penalty")
    told = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    paths = graph.od_paths(arcs, od)
    joins = graph.distances

    def none(*args, **kwargs):
        raise AssertionError("distances to all nodes are not asked for")

    monkeypatch.setattr(graph, "distances", none)
    monkeypatch.setattr(evaluate, "distances", none)
    by_tasks = [told(f()) for f in (lambda: graph.priced_od(arcs, od), lambda: paths, lambda: graph.path_cost(arcs, paths, "length"), lambda: evaluate.all_costs(arcs, od.distinct()))]
    assert len(by_tasks[0]) == od.count() and {len(eval(x)) for x in by_tasks[3]} == {7}
    monkeypatch.setattr(graph, "distances", joins)
    monkeypatch.setattr(evaluate, "distances", joins)
    monkeypatch.setattr(search, "HOPS", 0)
    assert by_tasks[1] == told(graph.od_paths(arcs, od))
    assert by_tasks == [told(f()) for f in (lambda: graph.priced_od(arcs, od), lambda: paths, lambda: graph.path_cost(arcs, paths, "length"), lambda: evaluate.all_costs(arcs, od.distinct()))]


def test_components(spark, rows):
    nodes, d = shortest(rows)
    inf = float("inf")
    want = {a: max(b for b in nodes if d[a, b] < inf and d[b, a] < inf) for a in nodes}
    arcs = made(spark, rows)
    assert {r["node"]: r["component"] for r in graph.strong_components(arcs).collect()} == want
    assert not graph.is_strongly_connected(arcs)
    big = graph.largest_strong_component(arcs)
    assert graph.is_strongly_connected(big)
    assert not graph.is_strongly_connected(arcs.limit(0))


def test_bridges(spark, rows):
    def parts(edges):
        left, n = {x for e in edges for x in e}, 0
        while left:
            todo, n = [left.pop()], n + 1
            while todo:
                x = todo.pop()
                near = {b for a, b in edges if a == x} | {a for a, b in edges if b == x}
                todo += near & left
                left -= near
        return n

    ring = [(30, 31, 0, 1), (31, 32, 0, 1), (32, 30, 0, 1), (32, 40, 0, 1), (40, 32, 0, 1), (40, 41, 0, 1), (40, 41, 1, 1)]
    every = rows + ring
    pairs = {(min(u, v), max(u, v)) for u, v, _, _ in every}
    keys = {p: {k for u, v, k, _ in every if (min(u, v), max(u, v)) == p} for p in pairs}
    nodes = {x for p in pairs for x in p}
    base = parts(pairs)
    want = set()
    for p in pairs:
        rest = pairs - {p}
        lone = sum(x not in {y for q in rest for y in q} for x in p)
        if len(keys[p]) == 1 and parts(rest) + lone > base:
            want.add(p)
    assert {tuple(r) for r in graph.bridges(made(spark, every)).collect()} == want
    assert (32, 40) in want and (40, 41) not in want and nodes


def brandes(rows):
    nodes, d = shortest(rows)
    best = {}
    for u, v, _, w in rows:
        best[u, v] = min(best.get((u, v), w), w)
    out = {}
    for s, t in itertools.permutations(nodes, 2):
        if d[s, t] == float("inf"):
            continue

        def paths(x):
            if x == s:
                return [[]]
            return [p + [(u, x)] for (u, v), w in best.items() if v == x and d[s, u] + w == d[s, x] for p in paths(u)]

        found = paths(t)
        for p in found:
            for e in p:
                out[e] = out.get(e, 0) + 1 / len(found)
    n = len(nodes)
    ties = {e: sum(1 for u, v, _, w in rows if (u, v) == e and w == best[e]) for e in best}
    return {(u, v, k): out.get((u, v), 0) / (n * (n - 1)) / ties[u, v] if w == best[u, v] else 0.0 for u, v, k, w in rows}


def test_betweenness(spark, rows):
    small = [r for r in rows if r[0] < 7 and r[1] < 7]
    arcs = made(spark, small)
    exact = graph.edge_betweenness(arcs)
    got = {(r["u"], r["v"], r["k"]): r["betweenness"] for r in exact.collect()}
    want = brandes(small)
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)
    same = rank_accuracy(exact, graph.edge_betweenness(arcs, k=1000)).first()
    assert same["mean_relative_error"] < 1e-6 and same["spearman"] > 0.999


def test_imputation_stops_when_nothing_changes(spark):
    nodes = spark.createDataFrame([(1, 10.0), (2, None), (3, float("nan")), (4, None), (9, None)], "node_id long, elevation double")
    arcs = made(spark, [(1, 2, 0, 1), (2, 3, 0, 1), (4, 4, 0, 1)])
    got = {r["node_id"]: r["elevation"] for r in graph.impute_by_neighbours(nodes, arcs).collect()}
    assert got == {1: 10.0, 2: 10.0, 3: 10.0, 4: None, 9: None}


def test_no_result_is_left_unfinished(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROUNDS", 2)
    line = spark.createDataFrame([(i, i + 1, 0, 1.0) for i in range(6)], "u long, v long, k long, length double")
    start = spark.createDataFrame([(0,)], "node long")
    assert graph.reachable(line, start).count() == 7
    assert {r["component"] for r in graph.weak_components(line).collect()} in ({0}, {6})
    with pytest.raises(RuntimeError):
        graph.distances(graph.cheapest(line), start.toDF("src"))


def test_closest_pairs_against_all_pairs(spark):
    import random

    from roadspark.operators.heuristics import closest_pairs

    draw = random.Random(4)
    at = {i: (float(draw.randrange(60)), float(draw.randrange(60))) for i in range(120)}
    nodes = spark.createDataFrame([(i, *p) for i, p in at.items()] + [(500, None, 1.0)], "node_id long, x double, y double")
    for n, k in ((60, 5), (3, 5), (60, 1), (0, 5)):
        left, right = list(range(n)), [*range(60, 120), 500]
        frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "node long")
        got = [(round(r["far"], 9), r["a"], r["b"]) for r in closest_pairs(frame(left), frame(right), nodes, k).orderBy("far", "a", "b").collect()]
        far = lambda a, b: round(((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5, 9)
        assert got == sorted((far(a, b), a, b) for a in left for b in right if b != 500)[:k]


def net_of(hops):
    import numpy as np

    from roadspark.operators.search import Net

    u, v, w = (np.array(x) for x in zip(*sorted(hops, key=lambda h: (h[1], h[0]))))
    return Net(np.arange(max(u.max(), v.max()) + 1), u.astype(np.int32), v.astype(np.int32), w.astype(float))


def test_search_of_small_whole_weights():
    """Sums of few bits are exact, ends of many hops and long ways included; what 16 bits cannot hold is searched in doubles."""
    import numpy as np

    draw = random.Random(3)
    n = 60
    pairs = {(draw.randrange(n), draw.randrange(n)) for _ in range(240)} | {(a, 7) for a in range(n - 1) if a != 7}  # 7 is the end of many
    hops = [(u, v, draw.randrange(1, 40) / 4) for u, v in pairs if u != v] + [(n, 3, 1.0)]  # nothing leads to node n
    for factor, unit in ((1.0, 0.25), (1.1, None), (4000.0, None), (3000.0, 1.0)):
        net = net_of([(u, v, w * factor) for u, v, w in hops])
        w = {(u, v): x for u, v, x in zip(net.u.tolist(), net.v.tolist(), net.w.tolist())}
        want = np.full((n + 1, n + 1), np.inf)
        want[np.arange(n + 1), np.arange(n + 1)] = 0
        for _ in range(n + 1):
            for (u, v), x in w.items():
                want[v] = np.minimum(want[v], want[u] + x)
        found = net.search(np.arange(n + 1))
        assert net.unit == unit
        assert (found.out.dtype == np.uint16) == (factor == 1.0)
        assert (net.distances(np.arange(n + 1)) == want).all()
        there = np.argwhere(np.isfinite(want) & (want > 0))
        end, of = there[:, 0], there[:, 1]
        hop = found.before(end, of)
        for e, o, h in zip(end.tolist(), of.tolist(), hop.tolist()):
            assert net.v[h] == e and net.u[h] == min(u for (u, v), x in w.items() if v == e and want[u, o] + x == want[e, o])


def test_importance_without_paths(spark, rows, monkeypatch):
    """Tasks add up what their paths carry, and give what the paths give; components of bounded networks need no rounds."""
    from roadspark.operators import evaluate, search

    nodes, _ = shortest(rows)
    od = spark.createDataFrame([(a, b, 1.0 + (a > b)) for a in nodes for b in nodes] + [(0, 99, 1.0), (99, 0, 1.0), (20, 22, None), (None, 1, 1.0)], "o long, d long, w double")
    arcs = made(spark, rows)
    told = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    want, comps = told(graph.edge_importance(arcs, graph.od_paths(arcs, od))), told(graph.strong_components(arcs))
    with monkeypatch.context() as m:
        m.setattr(search, "HOPS", 0)
        assert told(graph.od_importance(arcs, od)) == want and told(graph.strong_components(arcs)) == comps
    for where, name in ((search, "paths"), (graph, "joined_paths"), (graph, "_spread")):
        monkeypatch.setattr(where, name, None)
    assert told(graph.od_importance(arcs, od)) == want and told(graph.strong_components(arcs)) == comps
    # cells are told alike with a flag for each and without
    ends = spark.createDataFrame([(n, 900.0 * n, 130.0 * n * n - 4000.0) for n in nodes], "node_id long, x double, y double")
    area = told(evaluate.coverage(arcs, ends))
    monkeypatch.setattr(evaluate, "BOX", 0)
    assert told(evaluate.coverage(arcs, ends)) == area
