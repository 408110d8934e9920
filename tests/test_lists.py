"""Lists by pointer doubling and what stands on them, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from meshwright.operators import blocks, lists, traces
from meshwright.plans import staging

from .test_network import network, nodes


def test_ranking_of_lists_and_rings(spark):
    rows = [(k, k + 1 if k % 10 < 9 else None, 0.5) for k in range(30)] + [(100, 101, 1.0), (101, 102, 1.0), (102, 100, 1.0)]
    got = {r.node: (r.last, r.hops, r.length) for r in lists.ranked(spark.createDataFrame(rows, "node long, next long, length double")).collect()}
    assert all(got[k] == (k // 10 * 10 + 9, 9 - k % 10, (9 - k % 10) / 2) for k in range(30))
    assert {got[k] for k in (100, 101, 102)} == {(None, None, None)}


def test_running_totals(spark):
    rng = random.Random(4)
    rows = [(k, rng.randint(-5, 5)) for k in range(500)]
    rng.shuffle(rows)
    got = lists.running(spark.createDataFrame(rows, "k long, x long").repartition(5), ["k"], ("x",)).collect()
    total, want = 0, {}
    for k, x in sorted(rows):
        total += x
        want[k] = (k + 1, total)
    assert {r.k: (r.place, r.run_x) for r in got} == want


def random_graph(seed, n=14, m=16):
    rng = random.Random(seed)
    return [(k, rng.randrange(n), rng.randrange(n)) for k in range(m)]


def joined(edges):
    label = {x: x for _, a, b in edges for x in (a, b)}
    for _ in label:
        for _, a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trees(spark, seed):
    edges = random_graph(seed)
    frame = spark.createDataFrame(edges, "eid long, a long, b long")
    plain = [e for e in edges if e[1] != e[2]]
    label = joined(plain)
    taken = {r.eid for r in lists.spanning(frame).collect()}
    assert len(taken) == len(label) - len(set(label.values())) and joined([e for e in plain if e[0] in taken]) == label
    tree = {r.node: r for r in blocks.numbered(frame).collect()}
    assert set(tree) == set(label) and sorted(r.pre for r in tree.values()) == list(range(len(tree)))
    below = {x: {x} for x in tree}
    for x, r in tree.items():
        up, depth = x, 0
        while tree[up].parent is not None:
            assert {up, tree[up].parent} == set(next(e[1:] for e in plain if e[0] == tree[up].via))
            up, depth = tree[up].parent, depth + 1
            below[up].add(x)
        assert (up, depth) == (r.root, r.depth) and r.root == label[x]
    for x, r in tree.items():
        assert {tree[y].pre for y in below[x]} == set(range(r.pre, r.pre + r.size))
        others = [tree[z].pre for e, a, b in plain if e not in taken for y, z in ((a, b), (b, a)) if y in below[x]]
        own = [tree[y].pre for y in below[x]]
        assert (r.low, r.high) == (min(own + others), max(own + others))


def simple_paths(edges, start, goal):
    """Edges on any simple way, by trying all."""
    used = set()

    def walk(n, seen, path):
        if n == goal:
            used.update(path)
            return
        for e, a, b in edges:
            for x, y in ((a, b), (b, a)):
                if x == n and y not in seen:
                    walk(y, seen | {y}, [*path, e])

    walk(start, {start}, [])
    return used


@pytest.mark.parametrize("seed", [4, 5])
def test_blocks_loops_and_all_paths(spark, seed):
    edges = [e for e in random_graph(seed, 9, 12) if e[1] != e[2]]
    frame = spark.createDataFrame(edges, "eid long, a long, b long")
    got = {}
    for r in blocks.blocks(frame).collect():
        got.setdefault(r.block, set()).add(r.eid)
    # Two edges share a block if a simple loop holds both: their ends stay joined by two ways.
    same = {}
    for e, a, b in edges:
        rest = [x for x in edges if x[0] != e]
        same[e] = {e} | simple_paths(rest, a, b)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in same.values()}
    points = [(n, "source" if n == 0 else None, False) for n in range(9)]
    net = network(spark, points, [(a, b) for _, a, b in edges])
    number = {k: e for k, (e, _, _) in enumerate(edges)}
    assert {number[r.eid] for r in traces.loops(net).collect()} == {e for e in same if len(same[e]) > 1}
    start = edges[-1][1]
    if start:
        assert {number[r.eid] for r in traces.upstream_all(net, nodes(spark, start)).collect()} == simple_paths(edges, start, 0)


def test_criticality_by_closing_each_segment(spark):
    rng = random.Random(8)
    kinds = ["source", *(rng.choice(["customer", "customer", "isolating", None]) for _ in range(13))]
    edges = [(rng.randrange(k), k) for k in range(1, 14)] + [(rng.randrange(14), rng.randrange(14)) for _ in range(4)]
    edges = [e for e in edges if e[0] != e[1]]
    net = network(spark, [(n, kinds[n], False) for n in range(14)], edges)
    stops = {n for n, k in enumerate(kinds) if k == "isolating"}
    fed = lambda kept: {x for x, root in joined([(0, a, b) for a, b in kept] + [(0, 0, 0)]).items() if root == 0}
    everyone = fed(edges) & {n for n, k in enumerate(kinds) if k == "customer"}
    got = {r.fid: r.customers for r in traces.criticality(net).collect()}
    for k, (a, b) in enumerate(edges):
        inner, lines, grown = {n for n in (a, b) if n not in stops}, {k}, True
        while grown:
            more = {j for j, e in enumerate(edges) if j not in lines and inner & set(e)}
            lines |= more
            new = {n for j in more for n in edges[j] if n not in stops} - inner
            inner |= new
            grown = bool(more or new)
        if 0 in inner:
            still = set()
        else:
            still = fed([e for j, e in enumerate(edges) if j not in lines])
        assert got[k] == len((everyone - still) | (inner & everyone)), k


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 20_000, []
    asked = staging.any_rows
    monkeypatch.setattr(lists, "any_rows", lambda df: rounds.append(1) or asked(df))
    chain = spark.range(n).select(F.col("id").alias("eid"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert blocks.bridges(chain).count() == n
    assert len(rounds) < 40


def test_a_shallow_network_is_not_ranked(spark, monkeypatch):
    def refused(links):
        raise AssertionError("trees of few levels need no lists")

    monkeypatch.setattr(lists, "ranked", refused)
    star = spark.range(50).select(F.col("id").alias("eid"), F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    assert blocks.bridges(star).count() == 50
