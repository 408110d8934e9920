"""Networks from coordinates: micro-maps with results worked out by hand, and brute force over all pairs."""

import random

import pytest

from meshwright.operators import graph
from meshwright.operators import located_traces as lt
from meshwright.operators import map_network as mn
from meshwright.operators import topology as top

LINE = "line long, part int, path array<struct<x:double,y:double>>, level_a int, level_b int, endvertex boolean, class string, ag int, tier string, reverse boolean, oneway int, lifecycle int"
POINT = "point long, x double, y double, class string, ag int, closed boolean, categories array<string>, lifecycle int"
TOL = 0.1


def lines(spark, *rows):
    """Rows of number, path and what differs from a plain line."""
    plain = {"part": 0, "level_a": None, "level_b": None, "endvertex": False, "class": "L", "ag": 1, "tier": None, "reverse": False, "oneway": 0, "lifecycle": 3}
    full = [{**plain, "line": k, "path": [(float(x), float(y)) for x, y in path], **more} for k, path, more in rows]
    names = [f.split()[0] for f in LINE.replace("struct<x:double,y:double>", "struct").split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], LINE)


def points(spark, *rows):
    return spark.createDataFrame([(k, float(x), float(y), "D", more.get("ag", 1), more.get("closed", False), more.get("cats", []), 3) for k, x, y, more in rows], POINT)


def partition(net):
    groups = {}
    for r in net.placed.select("token", "node").collect():
        groups.setdefault(r.node, set()).add(r.token)
    return {frozenset(g) for g in groups.values()}


def ends(net):
    names = dict(net.node_names().collect())
    return sorted((r.line, r.v0, names[r.a], names[r.b]) for r in net.edges.filter("line is not null").collect())


def test_bridge_levels(spark):
    """Two roads meet at one place on levels 0 and 1; a point there joins them."""
    roads = lines(spark, (1, [(0, 0), (5, 0)], {"level_b": 0}), (2, [(5, 0), (9, 0)], {"level_a": 1}), (3, [(5, 0), (5, 9)], {"level_a": 1}))
    assert partition(mn.build(roads, points(spark), TOL)) == {
        frozenset({"V:1:0:0"}), frozenset({"V:1:0:1"}), frozenset({"V:2:0:0", "V:3:0:0"}), frozenset({"V:2:0:1"}), frozenset({"V:3:0:1"}),
    }
    with_point = partition(mn.build(roads, points(spark, (7, 5, 0, {})), TOL))
    assert frozenset({"V:1:0:1", "V:2:0:0", "V:3:0:0", "P:7"}) in with_point


def test_endvertex_lines_refuse_their_middle(spark):
    main = (1, [(0, 0), (5, 0), (9, 0)], {"endvertex": True})
    other = (2, [(5, 0), (5, 4)], {})
    assert ends(mn.build(lines(spark, main, other), points(spark), TOL)) == [(1, 0, "V:1:0:0", "V:1:0:2"), (2, 0, "V:2:0:0", "V:2:0:1")]
    plain = (1, [(0, 0), (5, 0), (9, 0)], {})
    assert [e[:2] for e in ends(mn.build(lines(spark, plain, other), points(spark), TOL))] == [(1, 0), (1, 1), (2, 0)]


def test_near_places_join_transitively_and_crossings_do_not(spark):
    net = mn.build(lines(spark, (1, [(0, 0), (4, 0)], {}), (2, [(4.09, 0), (8, 0)], {}), (3, [(4.18, 0), (4.18, 5)], {}), (4, [(2, -2), (2, 2)], {})), points(spark), TOL)
    assert frozenset({"V:1:0:1", "V:2:0:0", "V:3:0:0"}) in partition(net)
    assert sum("V:4:0:" in t for g in partition(net) for t in g if len(g) > 1) == 0


def test_terminals(spark):
    """A transformer with a high and a low side: lines go to the terminal of their tier, a third one to none."""
    lots = lines(spark, (1, [(0, 0), (5, 0)], {"tier": "High"}), (2, [(5, 0), (9, 0)], {"tier": "Low"}), (3, [(5, 0), (5, 5)], {"tier": "Wrong"}))
    sides = spark.createDataFrame([("D", 8, 1, "hv", "High"), ("D", 8, 2, "lv", "Low")], "class string, ag int, seq int, terminal string, tier string")
    net = mn.build(lots, points(spark, (7, 5, 0, {"ag": 8}), (9, 0, 0, {})), TOL, terminals=sides)
    assert ends(net) == [(1, 0, "P:9", "T:7:hv"), (2, 0, "T:7:lv", "V:2:0:1"), (3, 0, "P:7", "V:3:0:1")]
    issues = mn.mismatch_issues(net).collect()
    assert [(r.code, r.severity, r.x, r.y, r["class"], r.fid) for r in issues] == [("E11", "error", 5.0, 0.0, "L", 3)]
    joined = {(r.device, r.terminal, r.length) for r in net.edges.filter("terminal is not null").collect()}
    assert joined == {(7, "hv", 0.0), (7, "lv", 0.0)}
    found = lt.trace(net.network(), "connected", lt.locate(net.network(), spark.createDataFrame([("L", 1)], "class string, fid long")))
    assert {(r.kind, r.fid) for r in found.features.collect()} == {("line", 1), ("line", 2), ("line", 3), ("point", 7), ("point", 9)}


def test_devices_of_one_node_ask_in_turn(spark):
    lots = lines(spark, (1, [(0, 0), (5, 0)], {"tier": "Low"}), (2, [(5, 0), (9, 0)], {}))
    sides = spark.createDataFrame([("D", 8, 1, "hv", "High"), ("D", 9, 1, "lv", "Low"), ("D", 9, 2, "lv2", "Low")], "class string, ag int, seq int, terminal string, tier string")
    net = mn.build(lots, points(spark, (7, 5, 0, {"ag": 8}), (8, 5, 0, {"ag": 9})), TOL, terminals=sides)
    assert [e[3] for e in ends(net) if e[0] == 1] == ["T:8:lv2"]
    assert {tuple(r) for r in net.mismatches.collect()} == {(7, 1), (7, 2), (8, 2)}


def test_associations(spark):
    tied = spark.createDataFrame([("connectivity", 1, 2), ("containment", 1, 3), ("connectivity", 1, 99), ("connectivity", 4, 4)], "kind string, from_point long, to_point long")
    spots = points(spark, (1, 0, 0, {"cats": ["source"]}), (2, 50, 0, {}), (3, 60, 0, {}), (4, 70, 0, {}))
    net = mn.build(lines(spark, (5, [(50, 0), (55, 0)], {})), spots, TOL, tied)
    assert net.edges.filter("kind = 'association'").count() == 1
    graph_net = net.network()
    down = lt.trace(graph_net, "downstream", lt.at_nodes(graph_net, graph_net.having("source"))).features
    assert {(r.kind, r.fid) for r in down.collect()} == {("point", 1), ("point", 2), ("line", 5)}


def random_map(spark, seed):
    rng = random.Random(seed)
    at = lambda: (rng.randint(0, 7) + rng.choice([0, 0, 0, 0.05, 0.2]), rng.randint(0, 5))
    rows = [(k, [at() for _ in range(rng.choice([1, 2, 2, 3, 4]))], {"level_b": rng.choice([None, 0, 1]), "endvertex": rng.random() < 0.2, "reverse": rng.random() < 0.3, "oneway": rng.choice([0, 1, 2])}) for k in range(24)]
    spots = [(k, *at(), {"closed": rng.random() < 0.2, "cats": [rng.choice(["source", "isolating", "customer", "main"])]}) for k in range(14)]
    return lines(spark, *rows), points(spark, *spots)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hubs_give_the_nodes_of_all_pairs(spark, seed):
    drawn, spots = random_map(spark, seed)
    by_pairs = {}
    for r in top.coincident(drawn, spots, TOL).collect():
        by_pairs.setdefault(r.node, set()).add(r.token)
    assert partition(mn.build(drawn, spots, TOL)) == {frozenset(g) for g in by_pairs.values()}


def brute_spread(edges, nodes, eids, walls):
    """Nodes and edges, as the definition has it: picked nodes spread, ends of picked edges hold at walls."""
    queue = list(nodes) + [n for e, a, b in edges if e in eids for n in (a, b)]
    seen, crossed = set(), set(eids)
    while queue:
        n = queue.pop()
        if n in seen:
            continue
        seen.add(n)
        if n in walls and n not in nodes:
            continue
        for e, a, b in edges:
            if n in (a, b):
                crossed.add(e)
                queue.append(b if a == n else a)
    return seen, crossed


@pytest.mark.parametrize("seed", [1, 2])
def test_traces_from_lines_and_points(spark, seed):
    drawn, spots = random_map(spark, seed)
    net = mn.build(drawn, spots, TOL).network()
    edges = [(r.eid, r.a, r.b) for r in net.edges.collect()]
    walls = {r.node for r in net.closed().collect()}
    keys = spark.createDataFrame([("L", 3), ("D", 5), ("L", 4)], "class string, fid long")
    picks = lt.locate(net, keys)
    nodes, eids = {r.node for r in picks.nodes.collect()}, {r.eid for r in picks.edges.collect()}
    found = lt.trace(net, "connected", picks)
    want = brute_spread(edges, nodes, eids, walls)
    assert ({r.node for r in found.nodes.collect()}, {r.eid for r in found.edges.collect()}) == want
    by_hops = graph.reach(graph.both_ways(net.edges), picks.nodes, net.closed(), ends=lt.ends_of(net, picks.edges))
    assert {r.node for r in by_hops.collect()} == want[0]
    groups = lt.trace(net, "connected", picks, groups=[("L", 1)]).features.collect()
    assert {r.kind for r in groups} <= {"line"}


def chain(spark):
    """Source 1 - valve 2 - customer 3, and back over a longer way; the second line runs against its drawing."""
    drawn = lines(
        spark, (1, [(0, 0), (10, 0)], {"oneway": 1}), (2, [(20, 0), (10, 0)], {"reverse": True, "oneway": 2}),
        (3, [(20, 0), (20, 9), (0, 9), (0, 0)], {"oneway": 1}),
    )
    spots = points(spark, (1, 0, 0, {"cats": ["source"]}), (2, 10, 0, {"cats": ["isolating"]}), (3, 20, 0, {"cats": ["customer"]}))
    return mn.build(drawn, spots, TOL).network()


def features(found):
    return {(r.kind[0], r.fid) for r in found.features.collect()}


def test_flows_from_a_picked_line(spark):
    net = chain(spark)
    pick = lambda *fids: lt.locate(net, spark.createDataFrame([("L", f) for f in fids], "class string, fid long"))
    # The far end of line 2 from the source is point 3; the near end point 2.
    assert features(lt.trace(net, "downstream", pick(2))) == {("l", 2), ("p", 3)}
    assert features(lt.trace(net, "upstream", pick(2))) == {("l", 2), ("l", 1), ("p", 2), ("p", 1)}
    # By gravity line 2 runs from 10 to 20, line 3 back to the source.
    assert features(lt.trace(net, "downstream", pick(1), flow="gravity")) == {("l", 1), ("l", 2), ("l", 3), ("p", 1), ("p", 2), ("p", 3)}
    cut = lt.trace(net, "isolation", pick(1))
    assert [tuple(r) for r in cut.extra["to_close"].collect()] == [("D", 2)]
    everything = lt.trace(net, "upstream_all", pick(2))
    assert features(everything) == {("l", 1), ("l", 2), ("l", 3), ("p", 1), ("p", 2), ("p", 3)}
    assert features(lt.trace(net, "loops", None)) == {("l", 1), ("l", 2), ("l", 3)}


def test_one_way_paths(spark):
    net = chain(spark)
    at = lambda fid: lt.locate(net, spark.createDataFrame([("D", fid)], "class string, fid long"))
    there = lt.trace(net, "shortest_path", at(1), flow="undirected", targets=at(3))
    back = lt.trace(net, "shortest_path", at(3), flow="undirected", targets=at(1))
    assert ([r.dist for r in there.extra["length"].collect()], [r.dist for r in back.extra["length"].collect()]) == ([20.0], [38.0])
    assert features(there) == {("l", 1), ("l", 2), ("p", 1), ("p", 2), ("p", 3)}
    none = lt.trace(net, "shortest_path", at(1), flow="undirected", targets=at(3), barriers=at(2))
    assert none.extra["length"].count() == 0 and none.features.count() == 0


def test_what_a_trace_refuses(spark):
    net = chain(spark)
    pick = lt.at_nodes(net, net.having("source"))
    for kind, how in (("downstream", {"flow": "undirected"}), ("shortest_path", {}), ("sideways", {}), ("connected", {"flow": "none"})):
        with pytest.raises(ValueError):
            lt.trace(net, kind, pick, **how)
    with pytest.raises(ValueError):
        lt.trace(net, "connected", None)


def test_empty_map(spark):
    net = mn.build(lines(spark), points(spark), TOL)
    assert net.edges.count() == 0 and net.placed.count() == 0
    found = lt.trace(net.network(), "connected", lt.locate(net.network(), spark.createDataFrame([("L", 1)], "class string, fid long")))
    assert found.features.count() == 0


def test_clicks(spark):
    net = mn.build(lines(spark, (1, [(0, 0), (5, 0), (9, 0)], {})), points(spark, (1, 5, 0, {})), TOL)
    clicks = spark.createDataFrame([(1, 1, 1.0, 1.0), (2, 1, 8.0, -1.0), (3, 1, 5.0, 0.0)], "click long, line long, x double, y double")
    near = net.edges_near(clicks).join(net.edges.select("eid", "v0"), "eid")
    assert {(r.click, r.v0) for r in near.collect()} == {(1, 0), (2, 1), (3, 0)}
