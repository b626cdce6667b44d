"""Graph queries over the part-follow graph with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.sources import adapters as A

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


E = A.EDGES
WIRES = f"""{E}, pr AS (SELECT DISTINCT src_key, dst_key FROM edges), pf AS (SELECT split_part(src_key, '::', 1) AS src_file, split_part(dst_key, '::', 1) AS dst_file FROM pr),
wires AS (SELECT src_file, dst_file, count(*) AS w FROM pf WHERE src_file <> dst_file GROUP BY ALL)"""
TYPED = """ty AS (SELECT DISTINCT split_part(src_key, '::', 1) AS a, split_part(dst_key, '::', 1) AS b, src_key, dst_key, type FROM edges WHERE split_part(src_key, '::', 1) <> split_part(dst_key, '::', 1))"""


def _files(s, d):
    return A.part_symbols(s, d).select("path").distinct()


@query(f"WITH {E} SELECT src_key, dst_key, type FROM edges")
def part_edges(s, d):
    return A.follow_edges(s, d)


@query(f"WITH {WIRES} SELECT src_file, dst_file, w FROM wires")
def file_wires(s, d):
    return G.file_wires(A.follow_edges(s, d))


@query(f"""WITH {E}, pr AS (SELECT DISTINCT src_key, dst_key FROM edges), en AS (SELECT src_key AS key FROM pr UNION ALL SELECT dst_key FROM pr)
SELECT key, coalesce(n, 0) AS degree FROM parts LEFT JOIN (SELECT key, count(*) AS n FROM en GROUP BY ALL) USING (key)""")
def symbol_degrees(s, d):
    return G.symbol_degrees(A.follow_edges(s, d), A.part_symbols(s, d))


@query(f"WITH {E}, {TYPED}, n AS (SELECT a, b, type, count(*) AS n FROM ty GROUP BY ALL) SELECT a AS file, b AS nb, 'out' AS direction, type, n FROM n UNION ALL SELECT b, a, 'in', type, n FROM n")
def typed_adjacency(s, d):
    return G.typed_adjacency(A.follow_edges(s, d))


@query(f"""WITH {E}, {TYPED}, dg AS (SELECT file AS path, count(src_key) AS indeg FROM (SELECT DISTINCT file FROM parts) LEFT JOIN ty ON ty.b = file GROUP BY ALL)
SELECT path, indeg, row_number() OVER (ORDER BY indeg DESC, path) AS rank, count(*) OVER () AS total, round(100.0 * row_number() OVER (ORDER BY indeg DESC, path) / count(*) OVER (), 4) AS pct FROM dg""")
def hub_rank(s, d):
    ranked = G.rank_by_sorting(G.in_degrees(A.follow_edges(s, d), _files(s, d)), [F.desc("indeg"), F.asc("path")])
    return ranked.select("path", "indeg", "rank", F.col("total").cast("long").alias("total"), F.round(100.0 * F.col("rank") / F.col("total"), 4).alias("pct"))


@query(f"WITH {E}, {TYPED} SELECT a AS src_file, b AS dst_file, type, count(*) AS n FROM ty WHERE type <> 'signal' GROUP BY ALL")
def file_links(s, d):
    return G.typed_adjacency(A.follow_edges(s, d)).where("direction = 'out' and type <> 'signal'").select(F.col("file").alias("src_file"), F.col("nb").alias("dst_file"), "type", "n")


def _least(s, d):
    return A.part_symbols(s, d).orderBy(F.length("name"), "name").select("key").limit(1)


_SEED = "seed AS (SELECT key FROM parts ORDER BY length('p' || p_partkey), 'p' || p_partkey LIMIT 1)"


def _walk_sql(depth: int, src: str, dst: str, seeds: str = "SELECT key FROM seed") -> str:
    return f"""w(key, hop) AS ({seeds.replace('SELECT key', 'SELECT key, 0', 1)} UNION SELECT {dst}, hop + 1 FROM w JOIN edges ON {src} = w.key WHERE hop < {depth}), mn AS (SELECT key, min(hop) AS hop FROM w GROUP BY ALL)"""


@query(f"WITH RECURSIVE {E}, {_SEED}, {_walk_sql(1, 'src_key', 'dst_key')} SELECT hop, key FROM mn WHERE hop > 0")
def symbol_graph_d1(s, d):
    return G.impact(A.follow_edges(s, d), _least(s, d), 1, "callees").select("hop", "key")


@query(f"WITH RECURSIVE {E}, {_SEED}, {_walk_sql(2, 'src_key', 'dst_key')} SELECT hop, key FROM mn WHERE hop > 0")
def symbol_graph_d2(s, d):
    return G.impact(A.follow_edges(s, d), _least(s, d), 2, "callees").select("hop", "key")


@query(f"WITH RECURSIVE {E}, {_SEED}, {_walk_sql(4, 'dst_key', 'src_key')} SELECT hop, key FROM mn WHERE hop > 0")
def impact_callers(s, d):
    return G.impact(A.follow_edges(s, d), _least(s, d), 4, "callers").select("hop", "key")


@query(f"WITH RECURSIVE {E}, {_SEED}, {_walk_sql(4, 'src_key', 'dst_key')} SELECT hop, key FROM mn WHERE hop > 0")
def impact_callees(s, d):
    return G.impact(A.follow_edges(s, d), _least(s, d), 4, "callees").select("hop", "key")


@query(f"""WITH RECURSIVE {E}, {_SEED}, {_walk_sql(3, 'dst_key', 'src_key')} SELECT (SELECT count(*) FROM mn WHERE hop BETWEEN 1 AND 2) AS total, (SELECT count(*) FROM mn WHERE hop = 3) AS beyond,
  (SELECT count(*) FROM mn JOIN parts USING (key) WHERE hop BETWEEN 1 AND 2 AND p_size = 1) AS entries""")
def impact_summary(s, d):
    """Size of the closure to depth 2, what lies one hop beyond, and how many entry points it holds."""
    got = G.impact(A.follow_edges(s, d), _least(s, d), 3, "callers")
    roots = A.part_symbols(s, d).where("size = 1").select("key", F.lit(True).alias("root"))
    both = got.join(roots, "key", "left")
    return both.agg(F.count_if(F.col("hop") <= 2).alias("total"), F.count_if(F.col("hop") == 3).alias("beyond"), F.count_if(F.col("root") & (F.col("hop") <= 2)).alias("entries"))


_ROOTS = "SELECT key FROM parts WHERE p_size = 1"


def _roots(s, d):
    return A.part_symbols(s, d).where("size = 1").select("key")


@query(f"WITH RECURSIVE {E}, r(key) AS ({_ROOTS} UNION SELECT dst_key FROM r JOIN edges ON src_key = r.key) SELECT key FROM r")
def reachable(s, d):
    return G.walk(A.follow_edges(s, d), _roots(s, d), None).select("key")


@query(f"""WITH {WIRES}, one AS (SELECT min(file) AS f FROM parts), nb AS (SELECT DISTINCT src_file AS a, dst_file AS b FROM wires UNION SELECT dst_file, src_file FROM wires),
n1 AS (SELECT b FROM nb, one WHERE a = f), n2 AS (SELECT nb.b, min(nb.a) AS via FROM nb JOIN n1 ON nb.a = n1.b, one WHERE nb.b <> f AND nb.b NOT IN (SELECT b FROM n1) GROUP BY ALL) SELECT b AS file, via FROM n2""")
def two_hop_ring(s, d):
    """Files two wires away from the first file, and the least direct neighbour through which."""
    w = G.file_wires(A.follow_edges(s, d))
    nb = w.select(F.col("src_file").alias("a"), F.col("dst_file").alias("b")).union(w.select("dst_file", "src_file")).distinct()
    first = _files(s, d).agg(F.min("path").alias("f")).first()["f"]
    direct = nb.where(F.col("a") == first).select(F.col("b").alias("a"))
    ring = nb.join(direct, "a").where(F.col("b") != first).join(direct.select(F.col("a").alias("b")), "b", "left_anti")
    return ring.groupBy(F.col("b").alias("file")).agg(F.min("a").alias("via"))


_PR = f"""{WIRES}, nodes AS MATERIALIZED (SELECT DISTINCT file AS path FROM parts), nn AS (SELECT count(*) AS n FROM nodes), ow AS MATERIALIZED (SELECT src_file AS path, sum(w) AS outw FROM wires GROUP BY ALL),
sh AS MATERIALIZED (SELECT src_file, dst_file, w / outw AS share FROM wires JOIN ow ON ow.path = src_file), r0 AS MATERIALIZED (SELECT path, 1.0::DOUBLE / n AS rank FROM nodes, nn)""" + "".join(
    f""", r{i} AS MATERIALIZED (SELECT nodes.path, 0.15 / n + 0.85 * coalesce((SELECT sum(rank) FROM r{i - 1} WHERE path NOT IN (SELECT path FROM ow)), 0) / n + 0.85 * coalesce(g.got, 0) AS rank
 FROM nodes LEFT JOIN (SELECT dst_file AS path, sum(share * rank) AS got FROM sh JOIN r{i - 1} ON r{i - 1}.path = src_file GROUP BY ALL) g USING (path), nn)"""
    for i in range(1, 31)
)


def _ranks(s, d):
    return G.pagerank(G.file_wires(A.follow_edges(s, d)), _files(s, d))


@query(f"WITH {_PR} SELECT path, round(rank, 9) AS rank FROM r30")
def pagerank30(s, d):
    return _ranks(s, d).select("path", F.round("rank", 9).alias("rank"))


@query(f"""WITH {_PR}, pd AS (SELECT file AS path, 'p' || p_partkey AS name, coalesce(n, 0) AS degree FROM parts LEFT JOIN (SELECT key, count(*) AS n FROM (SELECT src_key AS key FROM pr UNION ALL SELECT dst_key FROM pr) GROUP BY ALL) USING (key)),
sg AS (SELECT path, string_agg(name, ', ' ORDER BY r) AS sig FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY degree DESC, name) AS r FROM pd) WHERE r <= 8 GROUP BY ALL),
ln AS (SELECT path, round(rank, 12) AS rank, path || ': ' || coalesce(sig, '') AS line FROM r30 LEFT JOIN sg USING (path)),
ru AS (SELECT *, sum((length(line) + 4) // 4) OVER (ORDER BY rank DESC, path)::BIGINT AS used FROM ln) SELECT path, line, used FROM ru WHERE used <= 2048""")
def repo_map(s, d):
    edges, symbols = A.follow_edges(s, d), A.part_symbols(s, d)
    return G.repo_map(_ranks(s, d), symbols, G.symbol_degrees(edges, symbols), 2048)


# The closure of the follow graph is too large for SQL; the tests compare with brute force.
@query()
def scc(s, d):
    return G.components(A.follow_edges(s, d))


@query()
def cycle_ids(s, d):
    return G.components(A.follow_edges(s, d)).groupBy("scc").agg(F.count("*").alias("size")).where("size > 1")


@query()
def strata_depth(s, d):
    return G.strata(A.follow_edges(s, d))


@query(f"""WITH {WIRES}, c AS (SELECT src_file AS path, dst_file AS nb, w, row_number() OVER (PARTITION BY src_file ORDER BY w DESC, dst_file) AS r, count(*) OVER (PARTITION BY src_file) AS n FROM wires)
SELECT path, list(nb ORDER BY r) AS shown, greatest(max(n) - 8, 0) AS more FROM c WHERE r <= 8 GROUP BY ALL""")
def capped_names(s, d):
    """First eight neighbours of each file and how many more there are."""
    w = G.file_wires(A.follow_edges(s, d))
    n = w.groupBy("src_file").agg(F.count("*").alias("n"))
    top = w.withColumn("r", F.row_number().over(Window.partitionBy("src_file").orderBy(F.desc("w"), "dst_file"))).where("r <= 8")
    shown = top.groupBy("src_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "dst_file"))), lambda x: x.dst_file).alias("shown"))
    return shown.join(n, "src_file").select(F.col("src_file").alias("path"), "shown", F.greatest(F.col("n") - 8, F.lit(0)).alias("more"))
