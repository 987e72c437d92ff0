import random

import pytest

from tests.conftest import rows
from urbanloom.operators import hierarchy as hierarchy_module
from urbanloom.operators.hierarchy import build, cycles, descendants, hierarchy, links

EDGES = "p long, c long"


def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    full = {}
    for a in out:
        seen, todo = set(), list(out[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        full[a] = seen
    return full


def expected_cycles(edges):
    r = reach(edges)
    return sorted((a, min(b for b in r[a] if a in r.get(b, ()))) for a in r if a in r[a])


def graph(seed, n=40, m=45):
    rnd = random.Random(seed)
    return sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)})


@pytest.mark.parametrize(("seed", "kernel"), [(1, 10**6), (2, 0)])
def test_cycles_of_random_graphs(spark, seed, kernel):
    edges = graph(seed)
    assert rows(cycles(spark.createDataFrame(edges, EDGES), kernel)) == sorted(expected_cycles(edges), key=repr)


def test_long_ring_is_contracted(spark):
    edges = [(i, (i + 1) % 24) for i in range(24)] + [(100, 0), (5, 200), (7, 7)]
    assert rows(cycles(spark.createDataFrame(edges, EDGES), 5)) == sorted([(i, 0) for i in range(24)], key=repr)


def test_dense_group_goes_by_colouring(spark):
    edges = [(a, b) for a in range(6) for b in range(6) if a != b] + [(5, 20), (20, 21), (21, 20), (21, 22), (22, 20), (22, 21), (20, 22)]
    assert rows(cycles(spark.createDataFrame(edges, EDGES), 3)) == sorted(expected_cycles(edges), key=repr)


@pytest.mark.parametrize(("kernel", "n"), [(10**6, 40), (8, 14)])
def test_hierarchy_and_descendants(spark, kernel, n):
    rnd = random.Random(7)
    edges = [(rnd.randrange(max(0, i - 6), i), i) for i in range(1, n)] + [(100 + i, 101 + i) for i in range(n // 4)] + [(3, n - 2), (500, 501), (501, 500), (501, 502)]
    cyc, paths, extra = build(spark.createDataFrame(sorted(set(edges)), EDGES), kernel)
    assert {r[0] for r in cyc.collect()} == {500, 501}
    free = [e for e in set(edges) if not {500, 501} & set(e)]
    parent = {}
    for p, c in sorted(free):
        parent.setdefault(c, p)
    got = {r["node"]: r for r in hierarchy(paths).collect()}
    assert set(got) == {x for e in edges for x in e} - {500, 501}
    for node, r in got.items():
        path = [node]
        while path[0] in parent:
            path.insert(0, parent[path[0]])
        assert (r["path"], r["depth"], r["root"], r["parent"]) == (path, len(path) - 1, path[0], parent.get(node))
    full = reach(free)
    assert {tuple(r) for r in descendants(paths, extra).collect()} == {(a, b) for a in full for b in full[a]}


def test_empty_null_and_repeated_links(spark):
    df = spark.createDataFrame([(1, 2, "x"), (1, 2, "y"), (None, 3, ""), (4, None, None)], "a long, b long, p string")
    assert rows(links(df, "a", "b")) == [(1, 2)]
    empty = spark.createDataFrame([], EDGES)
    cyc, paths, extra = build(empty)
    assert cyc.count() == paths.count() == extra.count() == hierarchy(paths).count() == descendants(paths, extra).count() == 0


@pytest.mark.parametrize("run", [256, 3])
def test_folding_without_pairs(spark, monkeypatch, run):
    monkeypatch.setattr(hierarchy_module, "CHAIN_RUN", run)
    rnd = random.Random(9)
    edges = sorted({(rnd.randrange(max(0, i - 4), i), i) for i in range(1, 40)} | {(3, 30), (7, 22), (200, 5), (100, 101), (101, 100)})
    _, paths, extra = build(spark.createDataFrame(edges, EDGES))
    values = {i: (rnd.randrange(1000) if i % 5 else None) for i in [*range(40), 200, 300]}
    own = spark.createDataFrame([(i, v, v) for i, v in values.items()], "id long, lo long, hi long")
    full = reach([e for e in edges if e[0] not in (100, 101)])
    want = []
    for i in values:
        seen = [values[j] for j in {i, *full.get(i, ())} if values.get(j) is not None]
        want.append((i, min(seen, default=None), max(seen, default=None)))
    assert rows(hierarchy_module.rolled_up(own, "id", paths, extra, {"lo": "min", "hi": "max"})) == sorted(want, key=repr)


def shapes(n):
    """Long graphs of about 2 * n links, with the nodes of each that reach themselves."""
    ladder = [(i, (i + 1) % n) for i in range(n)] + [(i, n + i) for i in range(0, n)] + [(n + i, i) for i in range(0, n)]
    ring = [(10 * n + i, 10 * n + (i + 1) % n) for i in range(n)]
    star = [(20 * n, 20 * n + i) for i in range(1, n)] + [(20 * n + 5, 20 * n)]
    chain = [(30 * n + i, 30 * n + i + 1) for i in range(n)]
    return ladder + ring + star + chain, {(i, 0) for i in range(2 * n)} | {(10 * n + i, 10 * n) for i in range(n)} | {(20 * n, 20 * n), (20 * n + 5, 20 * n)}


def test_long_ladder_ring_star_and_chain_are_contracted(spark):
    """The way of links that don't fit a task: few rounds, whatever the length."""
    edges, want = shapes(4_000)
    started = spark.sparkContext.statusTracker()
    df = spark.createDataFrame(edges, EDGES)
    spark.sparkContext.setJobGroup("contract", "contract")
    found = {tuple(r) for r in cycles(df, 1_500).collect()}
    jobs = len(started.getJobIdsForGroup("contract"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert found == want
    assert jobs < 500
