"""Queries over edges from code: the functions and files of the index, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import sql_list
from quillgraph.operators import codegraph as K
from quillgraph.operators import coupling as C
from quillgraph.operators import graph as G
from quillgraph.operators import liveness as L
from quillgraph.operators.textsearch import mention_counts
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


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def target_sql(raw: str) -> str:
    """What a written reference points at; empty for nothing."""
    b = rf"""regexp_replace(regexp_replace({raw}, '^[\s"]+|[\s"]+$', '', 'g'), '^res://', '')"""
    return rf"""CASE WHEN contains({b}, '/') THEN {b} ELSE trim(regexp_replace(regexp_replace({b}, '[<\[].*$', '', 's'), '^.*\.', '', 's'), ' ') END"""


_EXT = r"lower(regexp_extract(path, '(\.[^./]+)$', 1))"
_DQ, _SQ = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
_BARE = f"CASE WHEN ext = '.rs' THEN regexp_replace(b, {_lit(_DQ)}, '\"\"', 'g') ELSE regexp_replace(b, {_lit(_DQ + '|' + _SQ)}, '\"\"', 'g') END"
_CODE = rf"CASE WHEN ext IN ('.py', '.pyi', '.gd') THEN regexp_replace(bare, '#[^\n]*', '', 'g') WHEN ext = '.lua' THEN regexp_replace(bare, '--[^\n]*', '', 'g') ELSE regexp_replace(bare, '//[^\n]*', '', 'g') END"
_SITE = "s.repo, s.path, s.key, s.head, s.recv, s.callee"
_OWN = f"({sql_list(K.OWN)})"
#: Declarations, classes, ancestors, call sites and where they land.
CALLS = rf"""{A.FUNCS}, {A.FILES},
sy0 AS (SELECT repo, path, name, min(line) AS line, any_value(body) AS body, any_value(params) AS params, {_EXT} AS ext FROM fn WHERE name IS NOT NULL AND path IS NOT NULL AND repo IS NOT NULL AND EXISTS (SELECT 1 FROM lf WHERE lf.repo = fn.repo AND lf.path = fn.path) GROUP BY repo, path, name),
sy AS MATERIALIZED (SELECT * EXCLUDE (b, bare), {_CODE} AS code FROM (SELECT *, {_BARE} AS bare FROM (SELECT repo, path, ext, name, line, repo || '|' || path || '::' || name AS key, coalesce(body, '') AS b, params FROM sy0))),
cm AS MATERIALIZED (SELECT repo, class_name, min(path) AS loc FROM lf WHERE class_name <> '' GROUP BY ALL),
bs AS (SELECT DISTINCT repo, path, t FROM (SELECT repo, path, {target_sql('extends')} AS t FROM lf) WHERE t <> ''),
st AS MATERIALIZED (SELECT DISTINCT repo, path, up FROM (SELECT bs.repo, bs.path, loc AS up FROM bs JOIN cm ON cm.repo = bs.repo AND cm.class_name = t UNION ALL SELECT bs.repo, bs.path, t FROM bs JOIN (SELECT DISTINCT repo, path FROM lf) k ON k.repo = bs.repo AND k.path = t) WHERE path <> up),
an(repo, path, up, depth) AS (SELECT repo, path, up, 1 FROM st UNION SELECT an.repo, an.path, st.up, depth + 1 FROM an JOIN st ON st.repo = an.repo AND st.path = an.up WHERE depth < 60),
up AS MATERIALIZED (SELECT repo, path, up, min(depth) AS depth FROM an GROUP BY ALL),
cs AS MATERIALIZED (SELECT DISTINCT repo, path, name, key, CASE WHEN g2 <> '' THEN g1 ELSE '' END AS head, CASE WHEN g2 <> '' THEN g2 ELSE g1 END AS recv, callee FROM
  (SELECT repo, path, name, key, regexp_extract(m, {_lit(K.CALL)}, 1) AS g1, regexp_extract(m, {_lit(K.CALL)}, 2) AS g2, regexp_extract(m, {_lit(K.CALL)}, 3) AS callee FROM (SELECT repo, path, name, key, unnest(list_distinct(regexp_extract_all(code, {_lit(K.CALL)}))) AS m FROM sy)) WHERE callee NOT IN ({sql_list(K.NO_CALLS)})),
hs AS MATERIALIZED (SELECT DISTINCT repo, path AS loc, name AS callee FROM sy),
pa AS (SELECT p0.repo, p0.path, p0.name, p.name AS var, cm.loc FROM (SELECT repo, path, name, unnest(params) AS p FROM sy) p0 JOIN cm ON cm.repo = p0.repo AND cm.class_name = p.type WHERE p.name <> ''),
me AS (SELECT DISTINCT m0.repo, m0.path, m.key AS var, cm.loc FROM (SELECT repo, path, unnest(map_entries(members)) AS m FROM lf) m0 JOIN cm ON cm.repo = m0.repo AND cm.class_name = m.value),
hd AS (SELECT {_SITE}, cm.loc AS mid FROM cs s JOIN cm ON cm.repo = s.repo AND cm.class_name = s.head WHERE s.head <> '' UNION ALL SELECT {_SITE}, pa.loc FROM cs s JOIN pa ON pa.repo = s.repo AND pa.path = s.path AND pa.name = s.name AND pa.var = s.head WHERE s.head <> ''),
rc AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT {_SITE}, cm.loc AS "to", 3 AS rule FROM cs s JOIN cm ON cm.repo = s.repo AND cm.class_name = s.recv WHERE s.head = '' AND s.recv <> ''
  UNION ALL SELECT {_SITE}, pa.loc, 5 FROM cs s JOIN pa ON pa.repo = s.repo AND pa.path = s.path AND pa.name = s.name AND pa.var = s.recv WHERE s.head = '' AND s.recv <> ''
  UNION ALL SELECT {_SITE}, me.loc, 6 FROM cs s JOIN me ON me.repo = s.repo AND me.path = s.path AND me.var = s.recv WHERE s.head = '' OR s.head IN {_OWN}
  UNION ALL SELECT {_SITE}, me.loc, 7 FROM hd s JOIN me ON me.repo = s.repo AND me.path = s.mid AND me.var = s.recv)),
mo AS (SELECT DISTINCT i.repo, i.path, i.module, k.path AS "to" FROM (SELECT repo, path, unnest(imported_modules) AS module FROM lf) i JOIN (SELECT DISTINCT repo, path, regexp_replace(split_part(path, '/', -1), '\.[^.]*$', '') AS stem FROM lf) k ON k.repo = i.repo AND k.stem = i.module WHERE i.module <> ''),
ev AS (SELECT {_SITE}, s.path AS "to", 1 AS rule, 0 AS dist FROM cs s WHERE s.recv = '' OR (s.recv IN {_OWN} AND s.head = '' AND s.recv <> 'super')
  UNION ALL SELECT {_SITE}, up.up, 2, up.depth FROM cs s JOIN up ON up.repo = s.repo AND up.path = s.path WHERE s.recv = '' OR (s.recv IN {_OWN} AND s.head = '')
  UNION ALL SELECT {_SITE}, "to", rule, 0 FROM rc s UNION ALL SELECT {_SITE}, up.up, s.rule, up.depth FROM rc s JOIN up ON up.repo = s.repo AND up.path = s."to"
  UNION ALL SELECT {_SITE}, mo."to", 10, 0 FROM cs s JOIN mo ON mo.repo = s.repo AND mo.path = s.path WHERE s.head = '' AND (s.recv = '' OR s.recv = mo.module)
  UNION ALL SELECT {_SITE}, o."to", 11, 0 FROM cs s JOIN (SELECT repo, callee, min(loc) AS "to" FROM hs GROUP BY ALL HAVING count(*) = 1) o ON o.repo = s.repo AND o.callee = s.callee WHERE s.recv = ''),
bt AS (SELECT * FROM (SELECT ev.*, row_number() OVER (PARTITION BY ev.repo, ev.path, ev.key, ev.head, ev.recv, ev.callee ORDER BY rule, dist, "to") AS r FROM ev JOIN hs ON hs.repo = ev.repo AND hs.loc = ev."to" AND hs.callee = ev.callee) WHERE r = 1),
cl0 AS MATERIALIZED (SELECT s.repo, s.path, s.key, s.head, s.recv, s.callee, bt."to" AS loc, bt.rule, bt.dist AS depth FROM cs s LEFT JOIN bt ON bt.key = s.key AND bt.head = s.head AND bt.recv = s.recv AND bt.callee = s.callee)"""
#: Typed edges of calls with their overrides, and of scenes.
EDGES = rf"""{CALLS},
ht AS (SELECT DISTINCT repo, key AS src_key, loc, callee FROM cl0 WHERE loc IS NOT NULL),
cd AS (SELECT * FROM ht UNION ALL SELECT ht.repo, ht.src_key, up.path, ht.callee FROM ht JOIN up ON up.repo = ht.repo AND up.up = ht.loc JOIN hs ON hs.repo = ht.repo AND hs.loc = up.path AND hs.callee = ht.callee),
l0 AS (SELECT repo, path AS scene, unnest(scripts) AS raw, generate_subscripts(scripts, 1) AS ord FROM lf),
l1 AS (SELECT l.repo, scene, script, min(ord) - 1 AS ord FROM (SELECT repo, scene, ord, regexp_replace(trim(raw, ' '), '^res://', '') AS script FROM l0) l JOIN (SELECT DISTINCT repo, path FROM lf) k ON k.repo = l.repo AND k.path = script WHERE script <> '' GROUP BY l.repo, scene, script),
l2 AS (SELECT DISTINCT l.repo, scene, script, 0 AS ord FROM (SELECT repo, path AS scene, regexp_replace(trim(attached_script, ' '), '^res://', '') AS script FROM lf) l JOIN (SELECT DISTINCT repo, path FROM lf) k ON k.repo = l.repo AND k.path = script WHERE script <> ''),
sc AS MATERIALIZED (SELECT repo, scene, ord, script FROM l1 UNION ALL SELECT repo, scene, ord, script FROM l2 WHERE (repo, scene) NOT IN (SELECT (repo, scene) FROM l1)),
cn AS (SELECT DISTINCT repo, scene, c.signal AS signal, c.method AS method FROM (SELECT repo, path AS scene, unnest(connections) AS c FROM lf) WHERE c.method <> ''),
sh AS (SELECT cn.repo, cn.scene, cn.signal, cn.method, x.script FROM cn LEFT JOIN (SELECT sc.repo, sc.scene, sc.script, hs.callee FROM sc JOIN hs ON hs.repo = sc.repo AND hs.loc = sc.script) x ON x.repo = cn.repo AND x.scene = cn.scene AND x.callee = cn.method),
ins AS (SELECT DISTINCT i.repo, i.path, "to" FROM (SELECT repo, path, regexp_replace(trim(raw, ' '), '^res://', '') AS "to" FROM (SELECT repo, path, unnest(instances) AS raw FROM lf)) i JOIN (SELECT DISTINCT repo, path FROM lf) k ON k.repo = i.repo AND k.path = "to" WHERE "to" <> '' AND "to" <> i.path),
edges AS MATERIALIZED (SELECT DISTINCT src_key, repo || '|' || loc || '::' || callee AS dst_key, 'call' AS type FROM cd WHERE src_key <> repo || '|' || loc || '::' || callee
  UNION ALL SELECT repo || '|' || scene || '::tscn', repo || '|' || script, 'attach' FROM sc UNION ALL SELECT repo || '|' || path || '::tscn', repo || '|' || "to" || '::tscn', 'inst' FROM ins
  UNION ALL SELECT DISTINCT repo || '|' || scene || '::tscn', repo || '|' || script || '::' || method, 'signal' FROM sh WHERE script IS NOT NULL)"""


class Code:
    """The relations of one folder, each made once and kept as a table."""

    def __init__(self, s, d):
        self.files = stage(A.live_files(s, d).drop("signals", "sha", "mtime_ns", "size"), "code-files")
        self.decl = stage(K.declarations(A.functions(s, d), self.files), "code-decl")
        self.up = stage(K.lineage(self.files), "code-lineage")
        self.calls = stage(K.resolve_calls(self.decl, self.files, self.up, stage(K.call_sites(self.decl), "code-sites")), "code-calls")
        self.scripts = stage(K.scene_scripts(self.files), "code-scripts")

    def edges(self) -> DataFrame:
        return stage(K.call_edges(self.calls, self.decl, self.up).unionByName(K.scene_edges(self.files, self.decl, self.scripts)), "code-edges")

    def handlers(self) -> DataFrame:
        return K.signal_handlers(self.files, self.decl, self.scripts)

    def roots(self) -> DataFrame:
        return K.entry_keys(self.decl, self.files, self.calls, self.handlers())


@query(f"WITH RECURSIVE {CALLS} SELECT key, head, recv, callee, loc, rule, depth FROM cl0")
def code_calls(s, d):
    """Every call site and the file it lands in, by the first rule that finds a declaration."""
    return Code(s, d).calls.select("key", "head", "recv", "callee", "loc", "rule", "depth")


@query(f"WITH RECURSIVE {CALLS} SELECT repo, path, up, depth FROM up")
def code_lineage(s, d):
    return K.lineage(A.live_files(s, d))


@query(f"WITH RECURSIVE {EDGES} SELECT src_key, dst_key, type FROM edges")
def code_edges(s, d):
    return Code(s, d).edges()


@query(f"""WITH RECURSIVE {EDGES}, pr AS (SELECT DISTINCT src_key, dst_key FROM edges), pf AS (SELECT split_part(src_key, '::', 1) AS src_file, split_part(dst_key, '::', 1) AS dst_file FROM pr)
SELECT src_file, dst_file, count(*) AS w FROM pf WHERE src_file <> dst_file GROUP BY ALL""")
def code_wires(s, d):
    return G.file_wires(Code(s, d).edges())


@query(f"WITH RECURSIVE {EDGES} SELECT repo, scene, signal, method, script, count(*) FILTER (WHERE script IS NULL) OVER () AS unresolved FROM sh")
def signal_wires(s, d):
    """Connections of scenes with the scripts that declare their handler, and how many find none."""
    h = stage(Code(s, d).handlers(), "handlers")
    return h.withColumn("unresolved", F.lit(h.where("script is null").count()))


_ROOTS = rf"""rt AS MATERIALIZED (SELECT key FROM sy WHERE {" OR ".join(f"(ext = '{e}' AND regexp_matches(name, {_lit(p)}))" for e, p in K.ENTRIES.items())} OR (starts_with(path, 'tests/') AND starts_with(name, 'test_'))
  UNION SELECT key FROM sy WHERE EXISTS (SELECT 1 FROM lf WHERE lf.repo = sy.repo AND lf.path = sy.path AND is_tool) UNION SELECT repo || '|' || script || '::' || method FROM sh WHERE script IS NOT NULL
  UNION SELECT key FROM sy WHERE (repo, name) IN (SELECT (repo, callee) FROM cl0 WHERE loc IS NULL AND recv <> ''))"""
_ALIVE = f"""{_ROOTS}, al(key) AS (SELECT key FROM rt UNION SELECT dst_key FROM al JOIN edges ON src_key = al.key WHERE NOT ends_with(dst_key, '::tscn'))"""


@query(f"WITH RECURSIVE {EDGES}, {_ROOTS} SELECT key FROM rt")
def code_roots(s, d):
    return Code(s, d).roots()


def _alive(c: Code) -> DataFrame:
    """What the roots and the scripts that scenes attach reach; scenes are not entered."""
    return G.walk(c.edges().where("not endswith(dst_key, '::tscn')"), c.roots(), None)


@query(f"WITH RECURSIVE {EDGES}, {_ALIVE} SELECT key FROM al")
def code_reach(s, d):
    return _alive(Code(s, d)).select("key")


_DEAD = rf"""{_ALIVE}, mn AS MATERIALIZED (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM sy0) GROUP BY ALL),
dy AS (SELECT repo, path, bool_or({" OR ".join(f"(ext = '{e}' AND regexp_matches(code, {_lit(p)}))" for e, p in K.DYNAMIC.items())}) AS dynamic FROM sy GROUP BY ALL),
hd2 AS (SELECT repo, path, min(class_name) AS class_name, min(nullif({target_sql('extends')}, '')) AS base FROM lf GROUP BY repo, path),
gv AS (SELECT DISTINCT repo, class_name FROM (SELECT repo, unnest(regexp_extract_all(code, '[(,]\s*([A-Z]\w*)\s*[,)]', 1)) AS class_name FROM sy)),
dd AS (SELECT sy.repo, sy.path, sy.name, sy.line, CASE WHEN coalesce(dynamic, false) OR coalesce(hd2.base <> '' AND kn.class_name IS NULL AND ext IN ({sql_list(K.BASE_REVIEW)}) AND starts_with(sy.name, '_'), false)
  OR coalesce(ext = '.py' AND gv.class_name IS NOT NULL, false) OR coalesce(ext IN ({sql_list(K.FLOORED)}) AND mn.n >= {K.FLOOR}, false) THEN 'review' ELSE 'likely' END AS tier
  FROM sy LEFT JOIN dy ON dy.repo = sy.repo AND dy.path = sy.path LEFT JOIN hd2 ON hd2.repo = sy.repo AND hd2.path = sy.path LEFT JOIN cm kn ON kn.repo = sy.repo AND kn.class_name = hd2.base LEFT JOIN gv ON gv.repo = sy.repo AND gv.class_name = hd2.class_name LEFT JOIN mn ON mn.token = sy.name
  WHERE sy.key NOT IN (SELECT key FROM al) AND NOT ({" OR ".join(f"(ext = '{e}' AND regexp_matches(sy.name, {_lit(p)}))" for e, p in K.EXEMPT.items())}))"""


def _dead(s, d, c: Code | None = None) -> DataFrame:
    c = c or Code(s, d)
    bodies = A.functions(s, d).where("repo is not null and path is not null and name is not null").join(c.files.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    return K.dead_functions(c.decl, c.files, _alive(c), mention_counts(bodies.select("body")))


@query(f"WITH RECURSIVE {EDGES}, {_DEAD} SELECT repo, path, name, line, tier FROM dd")
def code_dead(s, d):
    return _dead(s, d)


@query(f"""WITH RECURSIVE {EDGES}, {_DEAD}, fi AS (SELECT *, row_number() OVER (ORDER BY tier, repo, path, line NULLS FIRST, name) AS r, count(*) OVER (PARTITION BY tier) AS total FROM dd)
SELECT tier, repo, path, name, line, count(*) OVER (PARTITION BY tier) AS shown, total FROM fi WHERE r <= 100""")
def code_dead_view(s, d):
    """The first hundred rows, likely ones first, with how many of each tier are shown and there are."""
    return K.dead_view(_dead(s, d))


@query(f"WITH RECURSIVE {EDGES}, {_DEAD} SELECT coalesce(tier, 'all') AS tier, count(*) AS n FROM dd GROUP BY ROLLUP (tier)")
def dead_summary(s, d):
    return _dead(s, d).rollup("tier").agg(F.count("*").alias("n")).select(F.coalesce("tier", F.lit("all")).alias("tier"), "n")


#: Suffixes of the languages whose files have a share of dead functions.
SHARED = (".gd", ".ts", ".tsx", ".js", ".jsx", ".rs", ".go", ".java", ".cs", ".php", ".lua")


@query(f"""WITH RECURSIVE {EDGES}, {_DEAD}, fc AS (SELECT repo || '|' || path AS path, count(*) AS n FROM sy WHERE ext IN ({sql_list(SHARED)}) GROUP BY ALL),
se AS (SELECT path, round(sum(CASE tier WHEN 'likely' THEN 1.0 ELSE 0.5 END)::DOUBLE / max(n), 4) AS share FROM (SELECT repo || '|' || path AS path, tier FROM dd) JOIN fc USING (path) GROUP BY ALL) SELECT path, share, share >= 0.4 AS dead FROM se""")
def dead_share(s, d):
    """The weighted share of dead functions of each file, of the languages that count it."""
    c = Code(s, d)
    file = F.concat_ws("|", "repo", "path").alias("path")
    return L.dead_shares(_dead(s, d, c).select(file, "tier"), c.decl.where(F.col("ext").isin(*SHARED)).select(file))


#: What the symbol query asks for: a part of names.
PART = "rank_"


def _seed_sql(symbol: str) -> str:
    return f"""h0 AS (SELECT sy.key, sy.repo, sy.path, sy.line, sy.name, CASE WHEN sy.name = '{symbol}' OR cm.class_name IS NOT NULL THEN 0 WHEN contains(lower(sy.name), '{symbol.lower()}') THEN 1 END AS rank FROM sy LEFT JOIN cm ON cm.repo = sy.repo AND cm.loc = sy.path AND cm.class_name = '{symbol}'),
seed AS (SELECT key FROM h0 WHERE rank = (SELECT min(rank) FROM h0) ORDER BY repo, path, line NULLS FIRST, name LIMIT 10)"""


@query(f"WITH RECURSIVE {CALLS}, {_seed_sql(PART)} SELECT key FROM seed")
def code_symbol(s, d):
    """What a part of a name resolves to."""
    c = Code(s, d)
    return K.resolve_symbol(c.decl, K.class_map(c.files), PART)


_VIEW = f"""{_seed_sql('init')}, bo AS (SELECT src_key AS a, dst_key AS b FROM edges UNION ALL SELECT dst_key, src_key FROM edges),
n1 AS (SELECT DISTINCT b AS key FROM bo WHERE a IN (SELECT key FROM seed) AND NOT ends_with(b, '::tscn') AND b NOT IN (SELECT key FROM seed)),
nd AS (SELECT 0 AS hop, key FROM seed UNION ALL SELECT 1, key FROM n1), tp AS (SELECT *, (SELECT count(*) FROM nd) AS n_nodes FROM nd ORDER BY hop, key LIMIT 13),
pr AS (SELECT DISTINCT src_key, dst_key FROM edges)"""


@query(f"""WITH RECURSIVE {EDGES}, {_VIEW} SELECT hop, key, coalesce((SELECT list(src_key ORDER BY src_key)[:8] FROM pr WHERE dst_key = key), []) AS callers, (SELECT count(*) FROM pr WHERE dst_key = key) AS n_callers,
  coalesce((SELECT list(dst_key ORDER BY dst_key)[:8] FROM pr WHERE src_key = key), []) AS callees, (SELECT count(*) FROM pr WHERE src_key = key) AS n_callees, n_nodes FROM tp""")
def code_symbol_view(s, d):
    """Callers and callees around a symbol, two levels deep, both ways."""
    c = Code(s, d)
    return K.symbol_view(c.edges(), K.resolve_symbol(c.decl, K.class_map(c.files), "init"), 2)


@query(f"""WITH RECURSIVE {EDGES}, {_seed_sql('init')}, {_ROOTS}, w(key, hop) AS (SELECT key, 0 FROM seed UNION SELECT src_key, hop + 1 FROM w JOIN edges ON dst_key = w.key WHERE hop < 5 AND NOT ends_with(src_key, '::tscn')), mi AS (SELECT key, min(hop) AS hop FROM w GROUP BY ALL)
SELECT hop, key, key IN (SELECT key FROM rt) AS entry, (SELECT count(*) FROM mi WHERE hop = 5) AS beyond FROM mi WHERE hop BETWEEN 1 AND 4""")
def code_impact(s, d):
    """What calls a symbol within four hops, which of it are entry points, and how much lies one hop beyond."""
    c = Code(s, d)
    edges = c.edges().where("not endswith(src_key, '::tscn')")
    got = stage(G.walk(edges, K.resolve_symbol(c.decl, K.class_map(c.files), "init"), 5, reverse=True), "impact")
    beyond = got.where("hop = 5").count()
    roots = c.roots().withColumn("entry", F.lit(True))
    return got.where("hop between 1 and 4").join(roots, "key", "left").select("hop", "key", F.coalesce("entry", F.lit(False)).alias("entry"), F.lit(beyond).alias("beyond"))


_CLASSED = rf"""{EDGES}, mm AS (SELECT DISTINCT ON (cluster_id, repo, path) cluster_id, repo, path FROM cluster_members), zz AS (SELECT cluster_id, count(*) AS size FROM mm GROUP BY ALL),
membership AS (SELECT repo || '|' || path AS path, cluster_id AS cluster FROM (SELECT mm.*, row_number() OVER (PARTITION BY repo, path ORDER BY size DESC, cluster_id) AS r FROM mm JOIN zz USING (cluster_id)) WHERE r = 1),
ed AS (SELECT src_key, dst_key, list_sort(list_distinct(list(type))) AS types, split_part(src_key, '::', 1) AS src, split_part(dst_key, '::', 1) AS dst FROM edges GROUP BY src_key, dst_key),
cl AS (SELECT ed.*, m.cluster AS a, n.cluster AS b, CASE WHEN contains(src, '|tests/') OR contains(dst, '|tests/') THEN 'tests' WHEN ends_with(src_key, '::tscn') AND ends_with(dst_key, '::tscn') THEN 'scene' WHEN m.cluster IS NULL OR n.cluster IS NULL THEN 'unclustered'
  WHEN m.cluster = n.cluster THEN 'internal' ELSE 'cross' END AS class FROM ed LEFT JOIN membership m ON m.path = src LEFT JOIN membership n ON n.path = dst WHERE src <> dst)"""


def _classed(s, d) -> DataFrame:
    m = C.one_cluster_each(A.table(s, d, "cluster_members"), "cluster_id").select(F.concat_ws("|", "repo", "path").alias("path"), F.col("cluster_id").alias("cluster"))
    return C.classed_edges(Code(s, d).edges(), m, lambda f: f.contains("|tests/"))


@query(f"WITH RECURSIVE {_CLASSED} SELECT class, count(*) AS n FROM cl GROUP BY ALL")
def code_tallies(s, d):
    return _classed(s, d).groupBy("class").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_CLASSED} SELECT x, y, type, count(*) AS n FROM (SELECT least(a, b) AS x, greatest(a, b) AS y, unnest(types) AS type FROM cl WHERE class = 'cross') GROUP BY ALL")
def code_crosstalk(s, d):
    return C.pair_types(_classed(s, d))


@query(f"""WITH RECURSIVE {EDGES}, ty AS (SELECT DISTINCT split_part(src_key, '::', 1) AS src_file, split_part(dst_key, '::', 1) AS dst_file, src_key, dst_key, type FROM edges)
SELECT src_file, dst_file, type, count(*) AS n FROM ty WHERE src_file <> dst_file AND type <> 'signal' GROUP BY ALL""")
def code_links(s, d):
    """Links between files by type: calls, scripts attached to scenes and scenes in scenes."""
    e = G.typed_adjacency(Code(s, d).edges()).where("direction = 'out' and type <> 'signal'")
    return e.select(F.col("file").alias("src_file"), F.col("nb").alias("dst_file"), "type", "n")


@query(f"""WITH RECURSIVE {EDGES}, no AS (SELECT repo || '|' || path AS path FROM cluster_members WHERE NOT starts_with(path, 'assets/') UNION SELECT split_part(src_key, '::', 1) FROM edges UNION SELECT split_part(dst_key, '::', 1) FROM edges)
SELECT path, row_number() OVER (ORDER BY path) - 1 AS id FROM no WHERE NOT contains(path, '|assets/')""")
def node_roster(s, d):
    """Files of clusters and of the graph without assets, numbered in order of their path."""
    e = Code(s, d).edges()
    every = A.table(s, d, "cluster_members").select(F.concat_ws("|", "repo", "path").alias("path")).unionAll(e.select(F.substring_index("src_key", "::", 1))).unionAll(e.select(F.substring_index("dst_key", "::", 1)))
    placed = G.rank_by_sorting(every.where("not contains(path, '|assets/')").distinct(), [F.asc("path")])
    return placed.select("path", (F.col("rank") - 1).cast("long").alias("id"))
