import random

import pytest

from quillgraph.operators import coupling as C
from quillgraph.operators import graph as G
from quillgraph.plans import graph as P
from quillgraph.sources import adapters as A


def edges(spark, pairs, kind="call"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src_key string, dst_key string, type string")


def seeds(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def network(n=60, m=110, seed=8):
    rng = random.Random(seed)
    nodes = [f"m{k % 11}.py::s{k:02}" for k in range(n)]
    return nodes, {(a, b) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(m)) if a != b}


def hops(links, start, depth):
    found, front = {start: 0}, {start}
    for h in range(1, depth + 1):
        front = {b for a, b in links if a in front} - found.keys()
        found.update(dict.fromkeys(front, h))
    return {(h, k) for k, h in found.items() if h}


def test_impact_equals_a_walk(spark):
    nodes, links = network()
    e, back = edges(spark, links), {(b, a) for a, b in links}
    for depth, start in ((1, nodes[3]), (4, nodes[5])):
        assert {(r["hop"], r["key"]) for r in G.impact(e, seeds(spark, start), depth).collect()} == hops(back, start, depth)
        assert {(r["hop"], r["key"]) for r in G.impact(e, seeds(spark, start), depth, "callees").collect()} == hops(links, start, depth)
    assert G.impact(e, seeds(spark, nodes[3]), 0).count() == len(hops(back, nodes[3], 1)) and G.impact(e, seeds(spark, nodes[3]), 99).count() == len(hops(back, nodes[3], 8))
    with pytest.raises(ValueError):
        G.impact(e, seeds(spark, nodes[3]), 4, "both")


def test_walk_of_nothing(spark):
    e = edges(spark, network()[1])
    assert G.walk(e, seeds(spark), None).count() == 0
    assert G.walk(e.limit(0), seeds(spark, "a"), None).count() == 1


def test_map_keeps_its_budget(spark):
    nodes, links = network()
    e = edges(spark, links)
    symbols = spark.createDataFrame([(k.split("::")[0], k.split("::")[1], k) for k in nodes], "path string, name string, key string")
    ranks = G.pagerank(G.file_wires(e), symbols.select("path").distinct())
    rows = G.repo_map(ranks, symbols, G.symbol_degrees(e, symbols), 90).orderBy("used").collect()
    best = max(ranks.collect(), key=lambda r: r["rank"])["path"]
    assert rows[0]["path"] == best and rows[-1]["used"] <= 90 and all(r["line"].startswith(r["path"] + ": s") for r in rows)
    assert G.repo_map(ranks, symbols, G.symbol_degrees(e, symbols), 100_000).count() == 11


def test_edge_classes(spark):
    where = {"one/a": "P", "one/b": "P", "two/c": "Q", "check/d": "tests"}
    member = spark.createDataFrame(list(where.items()), "path string, cluster string")
    e = edges(spark, [("one/a::f", "one/b::f"), ("one/a::f", "two/c::g"), ("one/b::k", "two/c::g"), ("two/c::g", "one/a::f"), ("check/d::t", "one/a::f"), ("one/a::f", "gone/z::q"), ("one/a::f", "one/a::g")])
    e = e.unionByName(edges(spark, [("one/a::tscn", "two/c::tscn")], "inst")).unionByName(edges(spark, [("one/a::f", "two/c::g")], "signal"))
    classed = C.classed_edges(e, member)
    assert {r["class"]: r["count"] for r in classed.groupBy("class").count().collect()} == {"internal": 1, "cross": 3, "tests": 1, "unclustered": 1, "scene": 1}
    assert [(r.x, r.y, r.wires, r.files) for r in C.worst_pairs(classed).collect()] == [("P", "Q", 3, ["one/a two/c 2", "one/b two/c 1"])]
    assert {(r.x, r.y, r.type, r.n) for r in C.pair_types(classed).collect()} == {("P", "Q", "call", 3), ("P", "Q", "signal", 1)}
    assert {r.cluster: (r.internal, r.outgoing, r.incoming, r.share) for r in C.cluster_coupling(classed).collect()} == {"P": (1, 2, 1, 0.75), "Q": (0, 1, 2, 1.0)}
    inside = C.classed_edges(e, member, lambda f: f.startswith("two/")).where("class = 'tests'").count()
    assert inside == 4


def test_rules(spark):
    member = spark.createDataFrame([("a/1", "A"), ("a/2", "A"), ("b/1", "B"), ("c/1", "C")], "path string, cluster string")
    e = edges(spark, [("a/1::x", "b/1::y"), ("a/2::x", "b/1::y"), ("b/1::y", "a/1::x"), ("a/1::x", "c/1::z")]).unionByName(edges(spark, [("a/2::w", "c/1::z")], "var"))
    texts = ['{"id": "ww", "kind": "forbid", "from": "A", "to": "B", "severity": "warn"}', '{"kind": "forbid", "from": "A", "to": "B"}', '{"id": "two", "kind": "budget", "from": "A", "to": "B", "max": 2}', '{"id": "one", "kind": "budget", "from": "A", "to": "B", "max": 1}',
             '{"id": "vars", "kind": "forbid", "from": "A", "to": "C", "types": ["var"]}', '{"id": "broken", "kind": "deny", "from": "A", "to": "C"}']
    rules = C.parse_rules(spark.createDataFrame(list(enumerate(texts)), "n int, text string"))
    got = [(r["id"], r["wires"], r["violated"]) for r in C.check_rules(rules, C.classed_edges(e, member)).collect()]
    assert got == [("forbid A->B", 2, True), ("one", 2, True), ("two", 2, False), ("vars", 1, True), ("ww", 2, True)]


def test_communities(spark):
    groups = [range(0, 6), range(10, 16), range(20, 26)]
    rows = [(a, b, 1.0) for g in groups for a in g for b in g if a < b] + [(0, 10, 0.2), (10, 20, 0.2)]
    g = spark.createDataFrame(rows, "x long, y long, w double")
    parts = C.communities(g)
    again = {r["node"]: r["community"] for r in C.communities(g).collect()}
    got = {r["node"]: r["community"] for r in parts.collect()}
    assert got == again and len(got) == 18
    assert [len({got[n] for n in grp}) for grp in groups] == [1, 1, 1] and len(set(got.values())) == 3
    assert C.modularity(g, parts) > 0.5


def test_components_of_the_whole_follow_graph(spark, data):
    links = {(r["src_key"], r["dst_key"]) for r in A.follow_edges(spark, data).collect()}
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    reach = {}
    for a in out:
        seen, todo = {a}, [a]
        while todo:
            new = out[todo.pop()] - seen
            seen |= new
            todo += new
        reach[a] = seen
    scc = {a: min(b for b in reach[a] if a in reach[b]) for a in out}
    over = {(scc[a], scc[b]) for a, b in links if scc[a] != scc[b]}
    depth = dict.fromkeys(scc.values(), 0)
    for _ in depth:
        for a, b in over:
            depth[b] = max(depth[b], depth[a] + 1)
    assert {r["key"]: r["scc"] for r in P.QUERIES["scc"](spark, data).collect()} == scc
    assert {(r["key"], r["depth"]) for r in P.QUERIES["strata_depth"](spark, data).collect()} == {(a, depth[c]) for a, c in scc.items()}
    sizes = {c: sum(x == c for x in scc.values()) for c in set(scc.values())}
    assert {(r["scc"], r["size"]) for r in P.QUERIES["cycle_ids"](spark, data).collect()} == {(c, n) for c, n in sizes.items() if n > 1}


def test_communities_are_settled(spark):
    rng = random.Random(3)
    w = {(a, b): round(rng.random(), 3) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.12}
    own = {r["node"]: r["community"] for r in C.communities(spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "x long, y long, w double")).collect()}
    near = {n: [(b if a == n else a, x) for (a, b), x in w.items() if n in (a, b)] for n in own}
    k = {n: sum(x for _, x in near[n]) for n in own}
    for n in own:
        gain = {c: sum(x for m, x in near[n] if own[m] == c) - k[n] * sum(k[m] for m in own if m != n and own[m] == c) / sum(k.values()) for c in {own[n], *(own[m] for m, _ in near[n])}}
        assert gain[own[n]] >= max(gain.values()) - 1e-8
