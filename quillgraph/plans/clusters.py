"""Vector, coupling and cluster queries with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.operators import coupling as C
from quillgraph.operators import graph as G
from quillgraph.functions import text as T
from quillgraph.operators import vectors as V
from quillgraph.plans.text import SEED_SQL
from quillgraph.sources import adapters as A

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _emb(s, d):
    return A.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


EMB = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)"
# Vectors of one length once, so that a similarity is a product, made once for each pair.
_NEAR = f"""{EMB}, u AS MATERIALIZED (SELECT id, list_transform(v, lambda x: x / n)::DOUBLE[64] AS w FROM (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM e) WHERE n > 0),
pw AS MATERIALIZED (SELECT q.id AS q, e.id AS id, round(array_inner_product(q.w, e.w), 6) AS sim FROM u q JOIN u e ON q.id <> e.id),
nn AS MATERIALIZED (SELECT * FROM (SELECT q, id, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank FROM pw WHERE sim >= 0.3) WHERE rank <= 6), mu AS (SELECT x.q AS a, x.id AS b, x.sim FROM nn x JOIN nn y ON x.q = y.id AND x.id = y.q WHERE x.q < x.id)"""


def _near(s, d):
    return V.knn(_emb(s, d), _emb(s, d), 6, 0.3)


@query(f"""WITH {EMB} SELECT * FROM (SELECT q.id AS q, e.id, round(list_cosine_similarity(q.v, e.v), 6) AS sim, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, e.v), 6) DESC, e.id) AS rank
  FROM e q JOIN e ON q.id <> e.id WHERE q.id % 100 = 0) WHERE rank <= 10""")
def knn_exact(s, d):
    return V.knn(_emb(s, d).where("id % 100 = 0"), _emb(s, d), 10)


@query(f"""WITH {EMB} SELECT * FROM (SELECT e.id, round(list_cosine_similarity(q.v, e.v), 6) AS sim, row_number() OVER (ORDER BY round(list_cosine_similarity(q.v, e.v), 6) DESC, e.id) AS rank
  FROM e q JOIN e ON q.id <> e.id WHERE q.id = (SELECT min(vec_id) FROM embeddings)) WHERE rank <= 8""")
def semantic_neighbors(s, d):
    e = _emb(s, d)
    first = e.agg(F.min("id")).first()[0]
    return V.knn(e.where(F.col("id") == first), e, 8).select("id", "sim", "rank")


@query(f"WITH {_NEAR} SELECT a, b, sim FROM mu")
def knn_mutual(s, d):
    return V.mutual(_near(s, d))


_CELLS = """ce AS (SELECT label, pos, avg(v[pos]) AS m FROM (SELECT label, v, unnest(range(1, 65)) AS pos FROM e) GROUP BY ALL), nr AS (SELECT label, greatest(sqrt(sum(m * m)), 1e-9) AS n FROM ce GROUP BY ALL),
cv AS (SELECT label, pos, m / n AS x FROM ce JOIN nr USING (label))"""


@query(f"WITH {EMB}, {_CELLS} SELECT p.label AS a, q.label AS b, round(sum(p.x * q.x), 6) AS cos FROM cv p JOIN cv q ON p.pos = q.pos AND p.label < q.label GROUP BY ALL")
def centroid_cosine(s, d):
    return V.centroid_cosines(V.centroids(_emb(s, d), "label", "embedding"), "label").select("a", "b", F.round("cos", 6).alias("cos"))


@query(f"""WITH {EMB}, {_CELLS}, c AS (SELECT label, list(x ORDER BY pos) AS c FROM cv GROUP BY ALL), sc AS (SELECT e.label, id, round(list_cosine_similarity(v, c), 6) AS cos FROM e JOIN c USING (label))
SELECT label, id AS medoid, cos FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cos DESC, id) AS r FROM sc) WHERE r = 1""")
def medoid(s, d):
    return V.medoids(_emb(s, d), "label", "id", "embedding")


@query(f"""WITH {_NEAR}, x AS (SELECT a, b, sim, row_number() OVER (ORDER BY sim DESC, a, b) AS r, count(*) OVER () AS n FROM mu JOIN e p ON p.id = a JOIN e q ON q.id = b WHERE p.label <> q.label)
SELECT a, b, sim, greatest(n - 220, 0) AS dropped FROM x WHERE r <= 220""")
def sem_affinity(s, d):
    """The 220 most similar mutual pairs across labels, and how many more there are."""
    lab = _emb(s, d).select("id", "label")
    x = V.mutual(_near(s, d)).join(lab.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(lab.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb").select("a", "b", "sim")
    n = x.count()
    return x.orderBy(F.desc("sim"), "a", "b").limit(220).withColumn("dropped", F.lit(max(n - 220, 0)).cast("long"))


CLASSED = f"""{A.EDGES}, {A.MEMBERSHIP}, ed AS (SELECT src_key, dst_key, list_sort(list_distinct(list(type))) AS types, split_part(src_key, '::', 1) AS src, split_part(dst_key, '::', 1) AS dst FROM edges GROUP BY src_key, dst_key),
cl AS (SELECT ed.*, m.cluster AS a, n.cluster AS b, CASE WHEN coalesce(m.cluster = 'tests', false) OR coalesce(n.cluster = 'tests', false) THEN 'tests' WHEN m.cluster IS NULL OR n.cluster IS NULL THEN 'unclustered'
  WHEN m.cluster = n.cluster THEN 'internal' ELSE 'cross' END AS class FROM ed LEFT JOIN membership m ON m.path = src LEFT JOIN membership n ON n.path = dst WHERE src <> dst)"""


def _classed(s, d):
    return C.classed_edges(A.follow_edges(s, d), A.part_membership(s, d))


@query(f"WITH {CLASSED} SELECT class, count(*) AS n FROM cl GROUP BY ALL")
def cross_tallies(s, d):
    return _classed(s, d).groupBy("class").agg(F.count("*").alias("n"))


@query(f"""WITH {CLASSED}, u AS (SELECT a AS cluster, 1 AS i, 0 AS o, 0 AS n FROM cl WHERE class = 'internal' UNION ALL SELECT a, 0, 1, 0 FROM cl WHERE class = 'cross' UNION ALL SELECT b, 0, 0, 1 FROM cl WHERE class = 'cross')
SELECT cluster, sum(i)::BIGINT AS internal, sum(o)::BIGINT AS outgoing, sum(n)::BIGINT AS incoming, round((sum(o) + sum(n)) / (sum(i) + sum(o) + sum(n)), 3) AS share FROM u GROUP BY ALL""")
def crosstalk_clusters(s, d):
    return C.cluster_coupling(_classed(s, d))


@query(f"""WITH {CLASSED}, x AS (SELECT least(a, b) AS x, greatest(a, b) AS y, least(src, dst) AS f, greatest(src, dst) AS g FROM cl WHERE class = 'cross'),
b AS (SELECT x, y, count(*) AS wires FROM x GROUP BY ALL ORDER BY wires DESC, x, y LIMIT 10),
p AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY n DESC, f, g) AS r FROM (SELECT x.x, x.y, f, g, count(*) AS n FROM x JOIN b USING (x, y) GROUP BY ALL))
SELECT x, y, wires, files FROM b JOIN (SELECT x, y, list(f || ' ' || g || ' ' || n ORDER BY r) AS files FROM p WHERE r <= 3 GROUP BY ALL) USING (x, y)""")
def crosstalk_pairs(s, d):
    return C.worst_pairs(_classed(s, d))


@query(f"WITH {CLASSED} SELECT least(a, b) AS x, greatest(a, b) AS y, count(*) AS n FROM cl WHERE class IN ('cross', 'tests') AND a <> b GROUP BY ALL ORDER BY n DESC, x, y LIMIT 5")
def corridors_top5(s, d):
    e = _classed(s, d).where("class in ('cross', 'tests') and a <> b")
    return e.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "x", "y").limit(5)


RULES = [
    {"kind": "forbid", "from": "Brand12", "to": "Brand13"},
    {"id": "cap", "kind": "budget", "from": "Brand21", "to": "Brand22", "max": 5},
    {"id": "wide", "kind": "budget", "from": "Brand21", "to": "Brand23", "max": 100000, "severity": "warn"},
    {"id": "signals", "kind": "forbid", "from": "Brand31", "to": "Brand32", "types": ["signal"]},
    {"id": "none", "kind": "forbid", "from": "Brand31", "to": "Nowhere"},
]
BAD_RULES = ['{"kind": "ban", "from": "a", "to": "b"}', '{"kind": "budget", "from": "a", "to": "b"}', '{"kind": "budget", "from": "a", "to": "b", "max": -1, "id": "neg"}', '{"kind": "budget", "from": "a", "to": "b", "max": 1.5, "id": "frac"}',
             '{"kind": "forbid", "from": "a", "to": "b", "max": 3, "id": "m"}', '{"kind": "forbid", "from": "a", "to": "b", "severity": "loud", "id": "s"}', '{"kind": "forbid", "from": "a", "to": "b", "types": ["call", "sing"], "id": "t"}',
             '{"kind": "forbid", "from": "a", "to": "b", "id": "t"}', '[1, 2]', '{"kind": "forbid", "from": "a"}', '{"kind": "forbid", "from": "a", "to": "b", "colour": "red", "id": "k"}', '{"kind": ']


def _rules(s, texts):
    return C.parse_rules(s.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string"))


def _rule_sql() -> str:
    parts = []
    for r in RULES:
        name = r.get("id") or f"{r['kind']} {r['from']}->{r['to']}"
        where = f"class = 'cross' AND a = '{r['from']}' AND b = '{r['to']}'" + (f" AND list_has_any(types, {r['types']})" if "types" in r else "")
        parts.append(f"""SELECT '{name}' AS id, '{r.get('severity', 'error')}' AS severity, {r.get('max', 0)}::BIGINT AS "limit", (SELECT count(*) FROM cl WHERE {where}) AS wires,
 (SELECT coalesce(list(f || ' ' || g ORDER BY n DESC, f, g)[:5], []) FROM (SELECT src AS f, dst AS g, count(*) AS n FROM cl WHERE {where} GROUP BY ALL)) AS files,
 (SELECT greatest(count(*) - 5, 0) FROM (SELECT DISTINCT src, dst FROM cl WHERE {where})) AS more_files""")
    return " UNION ALL ".join(parts)


@query(f'WITH {CLASSED} SELECT id, severity, wires, "limit", wires > "limit" AS violated, files, more_files FROM ({_rule_sql()})')
def arch_check(s, d):
    return C.check_rules(_rules(s, [json.dumps(r) for r in RULES]), _classed(s, d))


@query("SELECT * FROM (VALUES (0, ['unknown kind']), (1, ['budget without max']), (2, ['negative max']), (3, ['max is no whole number']), (4, ['forbid with max']), (5, ['unknown severity']), (6, ['unknown type']), (7, ['duplicate id']), (8, ['not an object', 'unknown kind', 'missing end']), (9, ['missing end']), (10, ['unknown key']), (11, ['not an object', 'unknown kind', 'missing end', 'duplicate id'])) t(n, errors)")
def arch_rule_errors(s, d):
    return _rules(s, BAD_RULES).select("n", "errors")


def _calls(s, d):
    e = A.follow_edges(s, d).where("type = 'call'")
    num = lambda c: F.regexp_extract(c, "::p([0-9]+)$", 1).cast("long")
    ids = _emb(s, d).select("id")
    return e.select(num("src_key").alias("a"), num("dst_key").alias("b")).join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")


@query(f"""WITH {_NEAR}, {A.EDGES}, cp AS (SELECT regexp_extract(src_key, '::p([0-9]+)$', 1)::BIGINT AS a, regexp_extract(dst_key, '::p([0-9]+)$', 1)::BIGINT AS b FROM edges WHERE type = 'call'),
cc AS (SELECT least(a, b) AS x, greatest(a, b) AS y, least(count(*), 5)::DOUBLE AS w FROM cp WHERE a IN (SELECT id FROM e) AND b IN (SELECT id FROM e) AND a <> b GROUP BY 1, 2)
SELECT x, y, round(sum(w), 6) AS w FROM (SELECT a AS x, b AS y, 1.4::DOUBLE * sim AS w FROM mu UNION ALL SELECT x, y, w FROM cc) GROUP BY ALL""")
def sim_graph(s, d):
    return C.sim_graph(V.mutual(_near(s, d)), _calls(s, d)).select("x", "y", F.round("w", 6).alias("w"))


@query()
def louvain(s, d):
    """Communities of the similarity graph; checked by invariants in the tests."""
    return C.communities(C.sim_graph(V.mutual(_near(s, d)), _calls(s, d)))


_MEMBERS = "m AS (SELECT DISTINCT ON (cluster_id, repo, path) cluster_id, repo, path, class_name FROM cluster_members)"
_LABELS = rf"""{_MEMBERS}, w AS (SELECT cluster_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(translate(coalesce(class_name, ''), '_-', '  '), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '\s+'), lambda t: t <> '')) AS term FROM m),
tf AS (SELECT cluster_id, term, count(*) AS f FROM w WHERE length(term) >= 3 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({T.sql_list(T.LABEL_STOPWORDS + T.GENERIC_DIRS)}) GROUP BY ALL),
sc AS (SELECT cluster_id, term, round(f / sum(f) OVER (PARTITION BY cluster_id) * ln(1 + (SELECT count(DISTINCT cluster_id) FROM cluster_members) / count(*) OVER (PARTITION BY term)), 9) AS s FROM tf),
lt AS (SELECT cluster_id, list(term ORDER BY s DESC, term)[:3] AS terms FROM sc GROUP BY ALL),
ds AS (SELECT cluster_id, {SEED_SQL} AS seed FROM m),
md AS (SELECT cluster_id, seed, round(c / n, 4) AS share FROM (SELECT cluster_id, seed, count(*) AS c FROM ds WHERE seed IS NOT NULL GROUP BY ALL) JOIN (SELECT cluster_id, count(*) AS n FROM m GROUP BY ALL) USING (cluster_id) WHERE c >= 0.55 * n)"""


@query(f"WITH {_LABELS} SELECT cluster_id, terms FROM lt")
def ctfidf_labels(s, d):
    return C.label_terms(A.table(s, d, "cluster_members"), "cluster_id")


@query(f"WITH {_LABELS.replace('0.55 * n', '0.15 * n')} SELECT cluster_id, seed, share FROM md")
def majority_dir(s, d):
    """Folders that hold 15 per cent of a cluster; the label rule asks for 55."""
    return C.majority_dirs(A.table(s, d, "cluster_members"), "cluster_id", 0.15)


_STEM = r"regexp_replace(split_part(path, '/', -1), '\.[^.]*$', '')"
_TITLE = r"array_to_string(list_transform(regexp_extract_all(lower(trim(regexp_replace({x}, '[\s_-]+', ' ', 'g'), ' ')), '\p{{L}}+|[^\p{{L}}]+'), lambda w: upper(w[1]) || w[2:]), '')"
_SEGS = f"""sm AS (SELECT cluster_id, {_STEM} AS stem FROM m WHERE ends_with(path, '.tscn')), sn AS (SELECT cluster_id, count(*) AS n FROM sm GROUP BY ALL),
sx AS (SELECT cluster_id, lower(split_part(stem, '_', 1)) AS pfx, lower(coalesce(nullif(regexp_extract(split_part(stem, '_', 2), '([A-Z][a-z]*)', 1), ''), split_part(stem, '_', 2))) AS seg FROM sm WHERE split_part(stem, '_', 2) <> ''),
px AS (SELECT cluster_id, pfx, k AS pn FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY k DESC, pfx) AS r FROM (SELECT cluster_id, pfx, count(*) AS k FROM sx GROUP BY ALL)) JOIN sn USING (cluster_id) WHERE r = 1 AND k >= 0.6 * n),
sg AS (SELECT cluster_id, seg FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY k DESC, seg) AS r FROM (SELECT cluster_id, pfx, pn, seg, count(*) AS k FROM sx JOIN px USING (cluster_id, pfx) GROUP BY ALL)) WHERE r = 1 AND k >= 0.55 * pn AND seg <> pfx)"""
_DEEP = f"""cc AS (SELECT cluster_id, list_filter(string_split(path, '/')[:-2], lambda x: lower(x) NOT IN ({T.sql_list(T.GENERIC_DIRS)})) AS c FROM m), ck AS (SELECT cluster_id, c[:k] AS chain, count(*) AS k FROM (SELECT cluster_id, c, unnest(range(1, len(c) + 1)) AS k FROM cc) GROUP BY ALL),
dd AS (SELECT cluster_id, arg_max(chain, len(chain)) AS chain FROM ck JOIN (SELECT cluster_id, count(*) AS n FROM m GROUP BY ALL) USING (cluster_id) WHERE k >= 0.55 * n GROUP BY ALL)"""


@query(f"WITH {_MEMBERS}, {_SEGS} SELECT cluster_id, seg FROM sg")
def stem_prefixes(s, d):
    return C.stem_prefixes(A.table(s, d, "cluster_members"), "cluster_id")


@query(f"""WITH {_LABELS}, {_SEGS}, {_DEEP}, mc AS (SELECT cluster_id, repo, path, min(nullif(class_name, '')) AS cls FROM cluster_members GROUP BY ALL),
ev AS (SELECT cluster_id, count(*) AS n, count(*) FILTER (WHERE ends_with(path, '.tscn')) AS scenes, arg_min(cls, (path, repo)) AS cls FROM mc GROUP BY ALL),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY k DESC, stem) AS r FROM (SELECT cluster_id, stem, count(*) AS k FROM sm GROUP BY ALL)) WHERE r = 1)
SELECT cluster_id, CASE WHEN scenes * 2 > n AND seg IS NOT NULL THEN {_TITLE.format(x="seg")} WHEN chain IS NOT NULL THEN {_TITLE.format(x="chain[-1]")} WHEN scenes * 2 > n AND k >= 0.5 * n THEN {_TITLE.format(x="stem")} WHEN terms IS NOT NULL THEN array_to_string(terms, ' - ')
  WHEN cls IS NOT NULL THEN {_TITLE.format(x="cls")} ELSE 'Mixed (' || n || ')' END AS label, (CASE WHEN scenes * 2 > n AND seg IS NOT NULL THEN 0.7 WHEN chain IS NOT NULL THEN 0.85 WHEN scenes * 2 > n AND k >= 0.5 * n THEN 0.8 WHEN terms IS NOT NULL THEN 0.6 WHEN cls IS NOT NULL THEN 0.35 ELSE 0.2 END)::DOUBLE AS confidence,
  CASE WHEN scenes * 2 > n AND seg IS NOT NULL THEN 'stem' WHEN chain IS NOT NULL THEN 'dir' WHEN scenes * 2 > n AND k >= 0.5 * n THEN 'scene' WHEN terms IS NOT NULL THEN 'tfidf' WHEN cls IS NOT NULL THEN 'class' ELSE 'mixed' END AS rule
FROM ev LEFT JOIN sg USING (cluster_id) LEFT JOIN dd USING (cluster_id) LEFT JOIN tp USING (cluster_id) LEFT JOIN lt USING (cluster_id)""")
def cluster_labels(s, d):
    return C.cluster_labels(A.table(s, d, "cluster_members"), "cluster_id")


@query(f"""WITH {_MEMBERS}, z AS (SELECT cluster_id, count(*) AS size FROM m GROUP BY ALL) SELECT repo, path, cluster_id FROM (SELECT m.*, row_number() OVER (PARTITION BY repo, path ORDER BY size DESC, cluster_id) AS r FROM m JOIN z USING (cluster_id)) WHERE r = 1""")
def partition_dedupe(s, d):
    return C.one_cluster_each(A.table(s, d, "cluster_members"), "cluster_id")


@query(f"""WITH {CLASSED}, tp AS (SELECT cluster, path, indeg FROM (SELECT cluster, path, indeg, row_number() OVER (PARTITION BY cluster ORDER BY indeg DESC, path) AS r FROM (SELECT cluster, path, (SELECT count(*) FROM (SELECT DISTINCT src_key, dst_key, type FROM edges) e WHERE split_part(e.dst_key, '::', 1) = path AND split_part(e.src_key, '::', 1) <> path) AS indeg FROM membership)) WHERE r <= 3),
sz AS (SELECT cluster, count(*) AS size FROM membership GROUP BY ALL), xe AS (SELECT c, count(*) AS n FROM (SELECT a AS c FROM cl WHERE class = 'cross' UNION ALL SELECT b FROM cl WHERE class = 'cross') GROUP BY ALL)
SELECT cluster, size, list(path ORDER BY indeg DESC, path) AS hubs, coalesce(max(xe.n), 0) AS external FROM tp JOIN sz USING (cluster) LEFT JOIN xe ON xe.c = cluster GROUP BY cluster, size""")
def overview(s, d):
    """Every cluster with its size, its three files of most incoming edges, and its edges to other clusters."""
    member = A.part_membership(s, d)
    deg = G.in_degrees(A.follow_edges(s, d), member.select("path")).join(member, "path")
    best = deg.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("indeg"), "path"))).where("r <= 3")
    hubs = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x.path).alias("hubs"))
    cross = _classed(s, d).where("class = 'cross'")
    ext = cross.select(F.col("a").alias("cluster")).unionAll(cross.select("b")).groupBy("cluster").agg(F.count("*").alias("e"))
    return hubs.join(member.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").join(ext, "cluster", "left").select("cluster", "size", "hubs", F.coalesce("e", F.lit(0)).alias("external"))


@query(f"""WITH {_LABELS}, st AS (SELECT term, arg_max(df, counted_at) AS stored FROM label_terms WHERE term IS NOT NULL AND df IS NOT NULL GROUP BY ALL), tr AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)
SELECT term, stored, df, CASE WHEN stored IS NULL THEN 'missing' WHEN df IS NULL THEN 'gone' WHEN stored = df THEN 'right' ELSE 'outdated' END AS state FROM st FULL JOIN tr USING (term)""")
def label_drift(s, d):
    """Stored cluster counts of terms against those counted now."""
    from quillgraph.functions.text import admissible, ident_tokens

    m = A.table(s, d, "cluster_members").select("cluster_id", F.explode(ident_tokens(F.coalesce("class_name", F.lit("")))).alias("term")).where(admissible(F.col("term"))).distinct()
    now = m.groupBy("term").agg(F.count("*").alias("df"))
    old = A.table(s, d, "label_terms").where("term is not null and df is not null").groupBy("term").agg(F.max_by("df", "counted_at").alias("stored"))
    state = F.when(F.col("stored").isNull(), "missing").when(F.col("df").isNull(), "gone").when(F.col("stored") == F.col("df"), "right").otherwise("outdated")
    return old.join(now, "term", "full").select("term", "stored", "df", state.alias("state"))


_REFS = ("c3", "Brand12", "brand13", "TESTS", "c999", "nothing", "dup")


@query(f"""WITH {A.EDGES}, {A.MEMBERSHIP}, c AS (SELECT row_number() OVER (ORDER BY cluster) AS id, cluster AS label FROM (SELECT DISTINCT cluster FROM membership) UNION ALL SELECT 901, 'Dup' UNION ALL SELECT 902, 'DUP'),
r AS (SELECT unnest({list(_REFS)}) AS ref), f AS (SELECT ref, coalesce((SELECT min(id) FROM c WHERE 'c' || id = ref), (SELECT min(id) FROM c WHERE label = ref), (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM c WHERE lower(label) = lower(ref))) AS id,
  (SELECT count(*) FROM c WHERE lower(label) = lower(ref)) AS n FROM r) SELECT ref, id, CASE WHEN id IS NOT NULL THEN NULL WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS error FROM f""")
def cluster_refs(s, d):
    """Which clusters references by number or label mean."""
    named = G.rank_by_sorting(A.part_membership(s, d).select("cluster").distinct(), [F.asc("cluster")]).select(F.col("rank").cast("long").alias("id"), F.col("cluster").alias("label"))
    extra = s.createDataFrame([(901, "Dup"), (902, "DUP")], "id long, label string")
    return C.match_clusters(s.createDataFrame([(r,) for r in _REFS], "ref string"), named.unionByName(extra))
