"""Parent-child links to full hierarchies: cycles apart, then heavy paths.

Cycle separation contracts the links: nodes without parents or without children can't lie on a cycle and are raked off;
runs of nodes with one parent and one child are spliced out, an independent set of them a round; nodes that are each
other's child are merged. This shrinks trees, long chains, rings and ladders geometrically. What is left below
``kernel_links`` is decided in one task, anything above (dense groups, whose diameter is small) by colouring.

The links without cyclic nodes are a forest (each node under its smallest parent; further parents are kept apart as extra
links). Subtree sizes follow from the same contraction. The child with the largest subtree continues its parent's chain;
every way to a root crosses at most log2(n) chains, so a node's path is a short list of chain segments, and its
descendants are the nodes with a segment of its chain that ends at or below its place. Chains are handled in runs of
CHAIN_RUN nodes, so that no chain is ever held in one row or task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.session import cut

#: Links up to which one task may finish a contraction (24 bytes a link in arrays).
KERNEL_LINKS = 1_000_000
#: Nodes of a chain that are kept in one row.
CHAIN_RUN = 256


def links(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Distinct links (p, c); rows with a null end link nothing."""
    return df.select(F.col(parent).cast("long").alias("p"), F.col(child).cast("long").alias("c")).dropna().distinct()


def strong_components(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its strong component) of each node of components of two or more; Tarjan's method, without recursion."""
    nodes, at = np.unique(np.concatenate([p, c]), return_inverse=True)
    n = len(nodes)
    src, dst = at[: len(p)], at[len(p) :]
    order = np.argsort(src, kind="stable")
    start = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    to = dst[order].tolist()
    index, low, on, comp = [-1] * n, [0] * n, [False] * n, [-1] * n
    stack: list[int] = []
    count = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, start[root])]
        while work:
            v, k = work.pop()
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            else:
                low[v] = min(low[v], low[to[k - 1]])
            while k < start[v + 1]:
                w = to[k]
                k += 1
                if index[w] < 0:
                    work.append((v, k))
                    work.append((w, start[w]))
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on[w] = False
                        members.append(w)
                        if w == v:
                            break
                    if len(members) > 1:
                        least = min(members)  # nodes are sorted
                        for w in members:
                            comp[w] = least
    comp_of = np.array(comp)
    cyclic = comp_of >= 0
    return nodes[cyclic], nodes[comp_of[cyclic]]


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        node, cycle = strong_components(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(cycle, pa.int64())], names=["node", "cycle"])


def _rake(edges: DataFrame) -> DataFrame:
    """Links whose parent is a child and whose child is a parent: only these can lie on a cycle."""
    return edges.join(edges.select(F.col("c").alias("p")).distinct(), "p", "left_semi").join(edges.select(F.col("p").alias("c")).distinct(), "c", "left_semi").select("p", "c")


def _chance(node: Column, turn: int) -> Column:
    return F.xxhash64(node, F.lit(turn))


def _splice(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links without an independent set of nodes that have one parent and one child, and these nodes (v, u, w)."""
    single = (
        edges.groupBy(F.col("c").alias("v")).agg(F.count("*").alias("i"), F.min("p").alias("u")).filter("i = 1")
        .join(edges.groupBy(F.col("p").alias("v")).agg(F.count("*").alias("o"), F.min("c").alias("w")).filter("o = 1"), "v").select("v", "u", "w")
    )
    single = cut(single)
    names = single.select(F.col("v").alias("n"), _chance(F.col("v"), turn).alias("h"))
    ranked = single.withColumn("h", _chance(F.col("v"), turn)).join(names.select(F.col("n").alias("u"), F.col("h").alias("hu")), "u", "left").join(names.select(F.col("n").alias("w"), F.col("h").alias("hw")), "w", "left")
    taken = cut(ranked.filter((F.col("u") != F.col("v")) & (F.col("hu").isNull() | (F.col("h") < F.col("hu"))) & (F.col("hw").isNull() | (F.col("h") < F.col("hw")))).select("v", "u", "w"))
    out = taken.select("v")
    kept = edges.join(out.select(F.col("v").alias("p")), "p", "left_anti").join(out.select(F.col("v").alias("c")), "c", "left_anti")
    return kept.select("p", "c").unionAll(taken.select(F.col("u").alias("p"), F.col("w").alias("c"))).distinct(), taken


def _merge(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links without some of the nodes that are both parent and child of another, and these nodes (v, u): v goes up in u.

    By a coin for each node, tails go up in the smallest heads that they are linked with both ways.
    """
    heads = lambda c: _chance(F.col(c), turn) % 2 == 0
    both = edges.join(edges.select(F.col("c").alias("p"), F.col("p").alias("c")), ["p", "c"], "left_semi")
    taken = cut(both.filter(~heads("p") & heads("c")).groupBy(F.col("p").alias("v")).agg(F.min("c").alias("u")))
    named = edges.join(taken.select(F.col("v").alias("p"), F.col("u").alias("up")), "p", "left").join(taken.select(F.col("v").alias("c"), F.col("u").alias("uc")), "c", "left")
    return named.select(F.coalesce("up", "p").alias("p"), F.coalesce("uc", "c").alias("c")).distinct(), taken


def _colour(edges: DataFrame) -> DataFrame:
    """Strong components (node, cycle) without a bound on the links: forward maxima, then backward within a colour."""
    found = None
    while not edges.isEmpty():
        colour = cut(edges.select(F.col("p").alias("node")).union(edges.select("c")).distinct().withColumn("k", F.col("node")))
        while True:
            sent = edges.join(colour.select(F.col("node").alias("p"), "k"), "p").groupBy(F.col("c").alias("node")).agg(F.max("k").alias("m"))
            new = cut(colour.join(sent, "node", "left").select("node", F.greatest("k", "m").alias("k"), (F.col("m") > F.col("k")).alias("moved")))
            colour = new.drop("moved")
            if new.filter("moved").isEmpty():
                break
        tinted = cut(edges.join(colour.select(F.col("node").alias("p"), F.col("k").alias("kp")), "p").join(colour.select(F.col("node").alias("c"), F.col("k").alias("kc")), "c").filter("kp = kc").select("p", "c", F.col("kp").alias("k")))
        reached = frontier = cut(colour.filter("node = k"))
        while True:
            frontier = cut(tinted.join(frontier.select(F.col("node").alias("c"), "k"), ["c", "k"]).select(F.col("p").alias("node"), "k").distinct().join(reached, "node", "left_anti"))
            if frontier.isEmpty():
                break
            reached = cut(reached.unionAll(frontier))
        many = reached.groupBy("k").agg(F.count("*").alias("n"), F.min("node").alias("cycle")).filter("n > 1")
        part = reached.join(many, "k").select("node", "cycle")
        found = part if found is None else found.unionAll(part)
        found = cut(found)
        edges = cut(_rake(edges.join(reached.select(F.col("node").alias("p")), "p", "left_anti").join(reached.select(F.col("node").alias("c")), "c", "left_anti")))
    return found if found is not None else edges.select(F.col("p").alias("node"), F.col("c").alias("cycle"))


def cycles(edges: DataFrame, kernel_links: int = KERNEL_LINKS) -> DataFrame:
    """(node, cycle) of every node that reaches itself over ``edges`` (p, c); cycle is the smallest node of its group.

    A node linked to itself is a cycle, too. Empty links give an empty table. ``edges`` must be distinct.
    """
    loops = [cut(edges.filter("p = c").select(F.col("p").alias("node")))]
    edges = cut(_rake(edges.filter("p <> c")))
    size, turn, stalled, splicing, undone = edges.count(), 0, 0, True, []
    while size > kernel_links and stalled < 2:
        turn += 1
        if splicing:
            edges, taken = _splice(edges, turn)
            loops.append(taken.filter("u = w").select(F.col("u").alias("node")))
        else:
            edges, taken = _merge(edges, turn)
            loops.append(taken.select(F.col("u").alias("node")).distinct())
        undone.append(taken)
        edges = cut(_rake(edges.filter("p <> c")))
        before, size = size, edges.count()
        # what no longer helps gives way to the other
        stalled = stalled + 1 if size > 0.9 * before else 0
        splicing = splicing != (stalled > 0)
    if size <= kernel_links:
        groups = edges.coalesce(1).mapInArrow(_kernel, "node long, cycle long")
    else:
        groups = _colour(edges)
    # a node linked to itself, or to a spliced-out node and back, or in which others went up, is a group of its own unless it is in a larger one
    alone = loops[0]
    for x in loops[1:]:
        alone = alone.unionAll(x)
    own = alone.distinct().select("node", F.col("node").alias("cycle"), F.lit(True).alias("alone"))
    one = lambda df: df.groupBy("node").agg(F.min_by(F.struct("cycle", "alone"), F.struct("alone", "cycle")).alias("g")).select("node", "g.cycle", "g.alone")
    groups = one(groups.select("node", "cycle", F.lit(False).alias("alone")).unionAll(own))
    for taken in reversed(undone):
        groups = cut(groups)
        end = lambda name: groups.select(F.col("node").alias(name), F.col("cycle").alias(f"c{name}"), F.col("alone").alias(f"a{name}"))  # noqa: E731, B023
        if "w" in taken.columns:
            # a node that was spliced out between two nodes is in their group if they are in one
            inner = taken.join(end("u"), "u").join(end("w"), "w").filter("cu = cw").select(F.col("v").alias("node"), F.col("cu").alias("cycle"), (F.col("au") & F.col("aw")).alias("alone"))
        else:
            inner = taken.join(end("u"), "u").select(F.col("v").alias("node"), F.col("cu").alias("cycle"), F.col("au").alias("alone"))
        groups = one(groups.unionAll(inner))
    if not undone:
        return groups.select("node", "cycle")
    groups = cut(groups)
    least = groups.groupBy("cycle").agg(F.min("node").alias("least"))
    return groups.join(least, "cycle").select("node", F.col("least").alias("cycle"))


def _forest_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, size) of the kernel's nodes from rows (node, parent, acc, extra); parents are before children in no order."""
    got = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(4)] for b in batches]
    if not got:
        return
    node, parent, acc, extra = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(node)
    node, parent, acc, extra = node[order], parent[order], acc[order].astype(np.int64), extra[order].astype(np.int64)
    has = ~np.isnan(parent.astype(float))
    up = np.full(len(node), -1)
    up[has] = np.searchsorted(node, parent[has].astype(np.int64))
    waiting = np.bincount(up[has], minlength=len(node))
    total, ready = acc.copy(), np.flatnonzero(waiting == 0)
    while len(ready):
        ready = ready[up[ready] >= 0]
        np.add.at(total, up[ready], total[ready] + extra[ready])
        np.subtract.at(waiting, up[ready], 1)
        ready = np.unique(up[ready])
        ready = ready[waiting[ready] == 0]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], names=["node", "size"])


def subtree_sizes(forest: DataFrame, kernel_nodes: int = KERNEL_LINKS) -> DataFrame:
    """(node, parent, size) of a forest (node, parent; roots have null): size counts the node and all below it."""
    alive = cut(forest.select("node", "parent", F.lit(1).cast("long").alias("acc"), F.lit(0).cast("long").alias("extra")))
    gone: list[tuple[str, DataFrame]] = []
    turn, count = 0, alive.count()
    while count > kernel_nodes:
        turn += 1
        inner = alive.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"), F.min("node").alias("only"))
        state = cut(alive.join(inner, "node", "left"))
        leaves = cut(state.filter(F.col("kids").isNull()).select("node", "parent", "acc", "extra"))
        gone.append(("leaf", leaves.select("node", F.col("acc").alias("size"))))
        given = leaves.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("acc") + F.col("extra")).alias("given"))
        alive = state.filter(F.col("kids").isNotNull()).join(given, "node", "left").select("node", "parent", (F.col("acc") + F.coalesce("given", F.lit(0))).alias("acc"), "extra")
        alive = cut(alive)
        # splice out nodes with one child and a parent, an independent set of them
        kids = alive.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"), F.min("node").alias("only")).filter("kids = 1")
        single = cut(alive.filter(F.col("parent").isNotNull()).join(kids, "node").select(F.col("node").alias("v"), F.col("parent").alias("u"), F.col("only").alias("w"), F.col("acc").alias("va"), F.col("extra").alias("vx")))
        names = single.select(F.col("v").alias("n"), _chance(F.col("v"), turn).alias("h"))
        ranked = single.withColumn("h", _chance(F.col("v"), turn)).join(names.select(F.col("n").alias("u"), F.col("h").alias("hu")), "u", "left").join(names.select(F.col("n").alias("w"), F.col("h").alias("hw")), "w", "left")
        taken = ranked.filter((F.col("hu").isNull() | (F.col("h") < F.col("hu"))) & (F.col("hw").isNull() | (F.col("h") < F.col("hw"))))
        taken = cut(taken.join(alive.select(F.col("node").alias("w"), F.col("extra").alias("wx")), "w").select("v", "u", "w", "va", "vx", "wx"))
        gone.append(("run", taken.select(F.col("v").alias("node"), "w", (F.col("va") + F.col("wx")).alias("base"))))
        lifted = taken.select(F.col("w").alias("node"), F.col("u").alias("new_parent"), (F.col("va") + F.col("vx")).alias("more"))
        alive = cut(
            alive.join(taken.select(F.col("v").alias("node")), "node", "left_anti").join(lifted, "node", "left")
            .select("node", F.coalesce("new_parent", "parent").alias("parent"), "acc", (F.col("extra") + F.coalesce("more", F.lit(0))).alias("extra"))
        )
        count = alive.count()
    sizes = alive.coalesce(1).mapInArrow(_forest_sizes, "node long, size long")
    for kind, part in reversed(gone):
        if kind == "leaf":
            sizes = sizes.unionAll(part)
        else:
            sizes = cut(sizes)
            sizes = sizes.unionAll(part.join(sizes.select(F.col("node").alias("w"), "size"), "w").select("node", (F.col("base") + F.col("size")).alias("size")))
    return cut(forest.join(sizes, "node").select("node", "parent", "size"))


def heavy_paths(forest: DataFrame, kernel_nodes: int = KERNEL_LINKS) -> DataFrame:
    """(node, parent, size, chain, pos, segments) of a forest (node, parent).

    chain is the topmost node of the node's chain, pos its place there from 0. segments: array of (chain, upto) from the
    root's chain to the node's own, upto being the last place on each; its last entry is (chain, pos).
    """
    sized = subtree_sizes(forest, kernel_nodes)
    heavy = sized.filter(F.col("parent").isNotNull()).groupBy("parent").agg(F.max_by("node", F.struct("size", -F.col("node"))).alias("node")).select("node", F.lit(True).alias("heavy"))
    # places along the chains by pointer doubling: a node knows the node ``dist`` above it on its chain, until that is the top
    known = cut(sized.join(heavy, "node", "left").select("node", "parent", "size", F.when(F.col("heavy"), F.col("parent")).otherwise(F.col("node")).alias("ptr"), F.when(F.col("heavy"), 1).otherwise(0).cast("long").alias("dist")))
    done = known.filter("dist = 0")
    active = known.filter("dist > 0")
    while True:
        step = cut(active.join(known.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2")), "ptr").select("node", "parent", "size", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"), (F.col("dist2") == 0).alias("top")))
        finished, active = step.filter("top").drop("top"), step.filter("not top").drop("top")
        done = done.unionAll(finished)
        if active.isEmpty():
            break
        known = cut(done.unionAll(active))
        done = known.join(active.select("node"), "node", "left_anti")
        active = known.join(active.select("node"), "node", "left_semi")
    placed = cut(done.select("node", "parent", "size", F.col("ptr").alias("chain"), F.col("dist").alias("pos")))
    # chains hang in a tree of logarithmic height
    tops = placed.filter("node = chain").select("chain", F.col("parent").alias("node"))
    hangs = tops.filter(F.col("node").isNotNull()).join(placed.select("node", F.col("chain").alias("upper"), F.col("pos").alias("upto")), "node").select("chain", "upper", "upto")
    empty = "array<struct<chain:bigint,upto:bigint>>"
    ready = cut(tops.filter(F.col("node").isNull()).select("chain", F.expr(f"cast(array() as {empty})").alias("above")))
    waiting, layers = cut(hangs), ready
    while True:
        ready = cut(waiting.join(ready.select(F.col("chain").alias("upper"), "above"), "upper").select("chain", F.concat("above", F.array(F.struct(F.col("upper").alias("chain"), "upto"))).alias("above")))
        if ready.isEmpty():
            break
        layers = layers.unionAll(ready)
    own = F.array(F.struct("chain", F.col("pos").alias("upto")))
    return placed.join(layers, "chain").select("node", "parent", "size", "chain", "pos", F.concat("above", own).alias("segments"))


def build(edges: DataFrame, kernel_links: int = KERNEL_LINKS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cycles, paths, extra) of links (p, c): see ``cycles`` and ``heavy_paths``; extra are further links (p, c) of the forest.

    Nodes on cycles are in no tree; links from them are dropped, so what hangs below a cycle starts a tree of its own. A
    node under several parents hangs under the smallest; its other links are extra.
    """
    edges = cut(edges)
    cyclic = cut(cycles(edges, kernel_links))
    free = edges.join(cyclic.select(F.col("node").alias("p")), "p", "left_anti").join(cyclic.select(F.col("node").alias("c")), "c", "left_anti").select("p", "c")
    ends = edges.select(F.col("p").alias("node")).union(edges.select("c")).distinct().join(cyclic, "node", "left_anti")
    forest = cut(ends.join(free.groupBy(F.col("c").alias("node")).agg(F.min("p").alias("parent")), "node", "left").select("node", "parent"))
    extra = free.join(forest.select(F.col("node").alias("c"), F.col("parent").alias("p")), ["c", "p"], "left_anti").select("p", "c")
    return cyclic, cut(heavy_paths(forest, kernel_links)), extra


def _runs(upto: Column) -> Column:
    """The runs of a chain down to the place ``upto``."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.floor(upto / CHAIN_RUN)))


def path_nodes(paths: DataFrame) -> DataFrame:
    """(node, path): the nodes from the root to the node, as one array; it has the length of the path.

    Paths are put together from runs of CHAIN_RUN nodes; a run is one row, however many paths lead through it.
    """
    run = F.floor(F.col("pos") / CHAIN_RUN)
    runs = paths.groupBy("chain", run.alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("nodes"))
    parts = paths.select("node", F.posexplode("segments").alias("k", "seg")).select("node", "k", F.col("seg.chain").alias("chain"), F.col("seg.upto").alias("upto"))
    parts = parts.withColumn("run", _runs(F.col("upto")))
    length = F.least(F.lit(CHAIN_RUN), F.col("upto") - F.col("run") * CHAIN_RUN + 1).cast("int")
    pieces = parts.join(runs, ["chain", "run"]).select("node", "k", "run", F.slice("nodes", F.lit(1), length).alias("piece"))
    return pieces.groupBy("node").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "run", "piece"))), lambda x: x["piece"])).alias("path"))


def hierarchy(paths: DataFrame) -> DataFrame:
    """(node, parent, root, depth, n_descendants, path) of every node of the forest."""
    depth = F.aggregate("segments", F.lit(-1).cast("long"), lambda a, s: a + s["upto"] + 1)
    base = paths.select("node", "parent", F.col("segments")[0]["chain"].alias("root"), depth.alias("depth"), (F.col("size") - 1).alias("n_descendants"))
    return base.join(path_nodes(paths), "node")


def _above(paths: DataFrame, below: DataFrame) -> DataFrame:
    """Pairs (node, descendant) of the rows ``below`` of ``paths`` and all that is above them in the tree, themselves included.

    A node meets the runs of the chains on its way, not whole chains; the pairs looked at are the pairs found but for the
    last run of a segment.
    """
    ways = below.select(F.col("node").alias("descendant"), F.explode("segments").alias("seg")).select("descendant", F.col("seg.chain").alias("chain"), F.col("seg.upto").alias("upto"))
    ways = ways.withColumn("run", _runs(F.col("upto")))
    places = paths.select("node", "chain", "pos", F.floor(F.col("pos") / CHAIN_RUN).alias("run"))
    return places.join(ways, ["chain", "run"]).filter("pos <= upto").select("node", "descendant")


def entries(paths: DataFrame, extra: DataFrame) -> DataFrame:
    """Pairs (node, entry): where the ways down from a node leave the tree over extra links (p, c), to any number of them."""
    ends = extra.select(F.col("p").alias("node")).distinct()
    above = _above(paths, paths.join(ends, "node", "left_semi"))
    up = cut(above.join(extra.withColumnRenamed("p", "descendant"), "descendant").select(F.col("node"), F.col("c").alias("entry")).distinct())
    seen = frontier = up
    while True:
        more = frontier.join(up.select(F.col("node").alias("entry"), F.col("entry").alias("next")), "entry").select("node", F.col("next").alias("entry")).distinct()
        frontier = cut(more.join(seen, ["node", "entry"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionAll(frontier))


def descendants(paths: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Pairs (node, descendant), also over extra links: as many rows as there are such pairs."""
    pairs = _above(paths, paths)
    tree = pairs.filter("node <> descendant")
    if extra is None or extra.isEmpty():
        return tree
    pairs, extra = cut(pairs), cut(extra)
    over = entries(paths, extra).join(pairs.withColumnRenamed("node", "entry"), "entry").select("node", "descendant")
    return tree.unionAll(over).distinct()


def rolled_up(own: DataFrame, key: str, paths: DataFrame, extra: DataFrame, aggregates: dict[str, str]) -> DataFrame:
    """``own`` (key, columns) with each column over the node and all below it, by ``min`` or ``max`` (aggregates: column to which).

    No pair of a node and a descendant is made: what lies below each place of a chain is folded first (a node counts once on
    each chain of its way), then the places of a run, then the runs of a chain. Extra links add the folded values of where
    they lead. Nulls count for nothing; rows that are no node of the forest keep their values.
    """
    fold = lambda df, *by: df.groupBy(*by).agg(*[getattr(F, how)(c).alias(c) for c, how in aggregates.items()])
    columns = list(aggregates)
    way = paths.select(F.col("node").alias(key), F.explode("segments").alias("seg")).select(key, F.col("seg.chain").alias("chain"), F.col("seg.upto").alias("pos"))
    places = fold(own.join(way, key), "chain", "pos").withColumn("run", F.floor(F.col("pos") / CHAIN_RUN))
    places = cut(places)
    behind = W.partitionBy("chain").orderBy(F.desc("run")).rowsBetween(W.unboundedPreceding, -1)
    runs = fold(places, "chain", "run").select("chain", "run", *[getattr(F, how)(c).over(behind).alias(f"__{c}") for c, how in aggregates.items()])
    inside = W.partitionBy("chain", "run").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    pick = {"min": F.least, "max": F.greatest}
    every = paths.select(F.col("node").alias(key), "chain", "pos").join(places.drop("run"), ["chain", "pos"], "left").withColumn("run", F.floor(F.col("pos") / CHAIN_RUN))
    local = every.select(key, "chain", "run", *[getattr(F, how)(c).over(inside).alias(c) for c, how in aggregates.items()])
    tree = local.join(runs, ["chain", "run"], "left").select(key, *[pick[how](F.col(c), F.col(f"__{c}")).alias(c) for c, how in aggregates.items()])
    if not extra.isEmpty():
        tree = cut(tree)
        over = entries(paths, extra).join(tree.withColumnRenamed(key, "entry"), "entry").select(F.col("node").alias(key), *columns)
        tree = tree.unionAll(over)
    return fold(own.select(key, *columns).unionAll(tree.join(own.select(key), key, "left_semi")), key)
