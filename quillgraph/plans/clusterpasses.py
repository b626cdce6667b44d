"""Queries of the cluster passes, with SQL for single passes; the whole pipeline is tested by what must hold of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import GENERIC_DIRS, sql_list
from quillgraph.operators import clusterpasses as P
from quillgraph.operators import coupling as C
from quillgraph.operators import graph as G
from quillgraph.operators import grouping as U
from quillgraph.operators.vectors import centroids
from quillgraph.plans.codegraph import EDGES, Code
from quillgraph.session import stage
from quillgraph.sources import adapters as A

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_MEMBERS = """m0 AS (SELECT DISTINCT ON (cluster_id, repo, path) cluster_id, repo, path FROM cluster_members), z0 AS (SELECT cluster_id, count(*) AS size FROM m0 GROUP BY ALL),
mb AS MATERIALIZED (SELECT repo, path AS p, repo || '|' || path AS path, cluster_id AS comm FROM (SELECT m0.*, row_number() OVER (PARTITION BY repo, path ORDER BY size DESC, cluster_id) AS r FROM m0 JOIN z0 USING (cluster_id)) WHERE r = 1),
sz AS (SELECT comm, count(*) AS size FROM mb GROUP BY ALL)"""
_CHAIN = f"list_filter(string_split(p, '/')[:-2], lambda x: lower(x) NOT IN ({sql_list(GENERIC_DIRS)}))"
_STEM = r"regexp_replace(split_part(p, '/', -1), '\.[^.]*$', '')"
_SEG = f"lower(coalesce(nullif(regexp_extract(split_part({_STEM}, '_', 2), '([A-Z][a-z]*)', 1), ''), split_part({_STEM}, '_', 2)))"
_LINKS = """lk AS (SELECT DISTINCT split_part(src_key, '::', 1) AS a, split_part(dst_key, '::', 1) AS b FROM edges WHERE split_part(src_key, '::', 1) <> split_part(dst_key, '::', 1)),
nb AS (SELECT a AS path, b AS nb FROM lk UNION ALL SELECT b, a FROM lk)"""
_PACKS = f"""pk AS (SELECT path, comm, lower(split_part({_STEM}, '_', 1)) || '_' || {_SEG} AS pack FROM mb WHERE ends_with(p, '.tscn') AND length({_SEG}) >= 3), pc AS (SELECT pack, comm, count(*) AS n FROM pk GROUP BY ALL),
ph AS (SELECT pack, comm AS home FROM (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY n DESC, comm) AS r FROM pc) WHERE r = 1 AND n >= 3)"""


def members(s, d, units: bool = False) -> DataFrame:
    """(path, unit, comm): every file in one cluster; units are files, or scenes welded with their scripts."""
    one = C.one_cluster_each(A.table(s, d, "cluster_members"), "cluster_id").select(F.concat_ws("|", "repo", "path").alias("path"), F.col("cluster_id").alias("comm"))
    if not units:
        return stage(one.select("path", F.col("path").alias("unit"), "comm"), "members")
    links = U.script_links(A.live_files(s, d)).select(F.concat_ws("|", "repo", "scene").alias("a"), F.concat_ws("|", "repo", "script").alias("b")).where("a <> b")
    welded = U.weld(links).withColumnRenamed("node", "path")
    m = one.join(welded, "path", "left").withColumn("unit", F.coalesce("unit", "path"))
    # A unit whose files lie in several clusters goes where most of them are.
    home = P.majority(m.select("unit", "comm", F.lit(1).alias("n")), "unit").select("unit", F.col("comm").alias("home"))
    return stage(m.join(home, "unit").select("path", "unit", F.col("home").alias("comm")), "members")


def _inner(path):
    return F.substring_index(path, "|", -1)


def _links(s, d) -> DataFrame:
    return stage(G.file_wires(Code(s, d).edges()).select("src_file", "dst_file"), "cluster-links")


@query(f"""WITH {_MEMBERS}, sd AS (SELECT path, comm, array_to_string({_CHAIN}, '/') AS seed FROM mb), s1 AS (SELECT * FROM sd WHERE seed <> ''), hm AS (SELECT seed, comm AS "to" FROM (SELECT seed, comm, row_number() OVER (PARTITION BY seed ORDER BY count(*) DESC, comm) AS r FROM s1 GROUP BY seed, comm) WHERE r = 1)
SELECT path AS unit, "to" FROM s1 JOIN hm USING (seed) WHERE "to" <> comm""")
def loose_moves(s, d):
    """Files without any link, by the home of their folder."""
    m = members(s, d)
    none = m.limit(0)
    return P.loose_moves(m, none.select("unit", F.lit(0).alias("degree")), none.select("unit", F.lit(0.0).alias("sim")), _inner)


@query(f"""WITH {_MEMBERS}, ch AS (SELECT path, comm, {_CHAIN} AS chain FROM mb WHERE NOT ends_with(p, '.tscn')), c1 AS (SELECT * FROM ch WHERE len(chain) > 0), dm AS (SELECT chain, comm, count(*) AS n FROM c1 GROUP BY ALL),
hm AS (SELECT chain, comm AS "to", n AS there FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY n DESC, comm) AS r FROM dm) WHERE r = 1), ky AS (SELECT path, comm, 0 AS o, chain FROM c1 UNION ALL SELECT path, comm, 1, chain[:-2] FROM c1 WHERE len(chain) > 1),
ok AS (SELECT ky.path, o, "to" FROM ky JOIN hm ON hm.chain = ky.chain LEFT JOIN dm ON dm.chain = ky.chain AND dm.comm = ky.comm WHERE "to" <> ky.comm AND there >= 3 AND (coalesce(dm.n, 0) < 3 OR there >= coalesce(dm.n, 0) + 3))
SELECT path AS unit, arg_min("to", o) AS "to" FROM ok GROUP BY path""")
def folder_moves(s, d):
    return P.folder_moves(members(s, d), _inner)


@query(f"""WITH {_MEMBERS}, {_PACKS} SELECT pk.path AS unit, home AS "to" FROM pk JOIN ph USING (pack) JOIN pc here ON here.pack = pk.pack AND here.comm = pk.comm JOIN pc there ON there.pack = pk.pack AND there.comm = home WHERE home <> pk.comm AND there.n > here.n""")
def pack_moves(s, d):
    return P.pack_moves(members(s, d))


@query(f"""WITH RECURSIVE {EDGES}, {_MEMBERS}, {_PACKS}, {_LINKS}, vt AS (SELECT mb.path, mb.comm AS own, home AS comm, count(*) AS n FROM mb JOIN nb ON nb.path = mb.path JOIN pk ON pk.path = nb.nb JOIN ph ON ph.pack = pk.pack WHERE NOT ends_with(mb.p, '.tscn') GROUP BY ALL),
rk AS (SELECT vt.*, size, sum(n) OVER (PARTITION BY path) AS total, row_number() OVER (PARTITION BY path ORDER BY n DESC, comm) AS r, lead(n) OVER (PARTITION BY path ORDER BY n DESC, comm) AS n2, lead(comm) OVER (PARTITION BY path ORDER BY n DESC, comm) AS c2, lead(size) OVER (PARTITION BY path ORDER BY n DESC, comm) AS s2 FROM vt JOIN sz USING (comm))
SELECT path AS unit, "to" FROM (SELECT path, own, CASE WHEN n = n2 AND s2 > size THEN c2 ELSE comm END AS "to" FROM rk WHERE r = 1 AND total >= 2 AND n * 2 >= total) WHERE "to" <> own""")
def infra_moves(s, d):
    return P.infra_moves(members(s, d), _links(s, d))


@query(f"""WITH RECURSIVE {EDGES}, {_MEMBERS}, {_LINKS}, vt AS (SELECT mb.path, o.comm, count(*) AS n FROM mb JOIN nb ON nb.path = mb.path JOIN mb o ON o.path = nb.nb WHERE NOT ends_with(mb.p, '.tscn') AND NOT contains(mb.p, '/') AND o.comm <> mb.comm GROUP BY ALL)
SELECT path AS unit, min(comm) AS "to" FROM vt JOIN sz USING (comm) GROUP BY path HAVING count(*) = 1 AND sum(n) >= 2 AND max(size) <= 66""")
def usage_moves(s, d):
    return P.usage_moves(members(s, d), _links(s, d), _inner)


@query(f"""WITH {_MEMBERS}, tp AS (SELECT comm, split_part(p, '/', 1) AS top, count(*) AS n FROM mb WHERE contains(p, '/') GROUP BY ALL), tz AS (SELECT tp.*, size FROM tp JOIN sz USING (comm)),
sh AS (SELECT a.comm AS a, b.comm AS b, sum(b.n) AS n FROM tz a JOIN tz b USING (top) WHERE a.size <= 4 AND b.size > 4 AND b.size <= 66 GROUP BY ALL), mv AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM sh) WHERE r = 1)
SELECT path, coalesce(b, comm) AS comm FROM mb LEFT JOIN mv ON a = comm""")
def tiny_folded(s, d):
    return P.fold_tiny(members(s, d), _inner).select("path", "comm")


@query(f"""WITH {_MEMBERS}, pl AS (SELECT path, comm, size, row_number() OVER (PARTITION BY comm ORDER BY path) AS r FROM mb JOIN sz USING (comm)) SELECT path, CASE WHEN size > 9 THEN comm || '.' || (r - 1) // 5 ELSE comm::VARCHAR END AS comm FROM pl""")
def capped_parts(s, d):
    """Clusters over nine files cut into runs of five; the pipeline's own limits are 70 and 55."""
    return P.enforce_cap(members(s, d), 9, 5).select("path", "comm")


def _file_vectors(s, d) -> DataFrame:
    """One vector of a file layer row for each path."""
    v = A.table(s, d, "vectors").where("layer = 'file' and size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x))")
    return v.groupBy(F.concat_ws("|", "repo", "path").alias("path")).agg(F.min_by("embedding", "vec_id").alias("embedding"))


@query()
def clusters(s, d):
    """The whole pipeline from the stored clusters: routing passes over welded units, merging, caps, and the largest clusters with their hubs."""
    c = Code(s, d)
    edges = c.edges()
    links = stage(G.file_wires(edges).select("src_file", "dst_file"), "cluster-links")
    m = members(s, d, units=True)
    ends = links.select(F.col("src_file").alias("path")).unionAll(links.select("dst_file")).join(m.select("path", "unit"), "path").groupBy("unit").agg(F.count("*").alias("degree"))
    m = stage(P.apply_moves(m, P.loose_moves(m, ends, m.limit(0).select("unit", F.lit(0.0).alias("sim")), _inner)), "pass")
    for _ in range(2):
        m = stage(P.apply_moves(m, P.folder_moves(m, _inner)), "pass")
    m = stage(P.apply_moves(m, P.pack_moves(m)), "pass")
    m = stage(P.apply_moves(m, P.infra_moves(m, links)), "pass")
    m = stage(P.apply_moves(m, P.usage_moves(m, links, _inner)), "pass")
    m = stage(P.merge_down(m, links), "pass")
    m = stage(P.merge_small(m, _file_vectors(s, d)), "pass")
    m = stage(P.fold_tiny(m, _inner), "pass")
    m = stage(P.enforce_cap(m), "pass")
    return P.ranked_members(m, G.in_degrees(edges, m.select("path"))).select("comm", "size", "place", "path", "indeg", "rank")


@query()
def coarse_groups(s, d):
    """Clusters in three to eight groups by their mean file vectors."""
    v = _file_vectors(s, d).join(members(s, d).select("path", "comm"), "path")
    cells = centroids(v, "comm", "embedding")
    means = cells.groupBy("comm").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x.v).alias("embedding"))
    return P.coarse_groups(means)


@query(f"""WITH RECURSIVE {EDGES}, {_MEMBERS}, ty AS (SELECT DISTINCT split_part(src_key, '::', 1) AS a, split_part(dst_key, '::', 1) AS path, src_key, dst_key, type FROM edges), dg AS (SELECT path, count(*) AS indeg FROM ty WHERE a <> path GROUP BY ALL),
tp AS (SELECT comm, size, row_number() OVER (ORDER BY size DESC, comm) AS place FROM sz ORDER BY size DESC, comm LIMIT 30)
SELECT * FROM (SELECT comm, size, place, mb.path, coalesce(indeg, 0) AS indeg, row_number() OVER (PARTITION BY comm ORDER BY coalesce(indeg, 0) DESC, mb.path DESC) AS rank FROM mb JOIN tp USING (comm) LEFT JOIN dg ON dg.path = mb.path) WHERE rank <= 12""")
def cluster_listing(s, d):
    """The thirty largest stored clusters with their twelve files of most incoming edges."""
    m = members(s, d)
    return P.ranked_members(m, G.in_degrees(Code(s, d).edges(), m.select("path")))
