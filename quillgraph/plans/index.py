"""Liveness, duplicates, document shapes, snapshots, budgets, exports; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import changes as H
from quillgraph.operators import graph as G
from quillgraph.operators import liveness as L
from quillgraph.operators import shaping as D
from quillgraph.plans.text import NORM_SQL
from quillgraph.sources import adapters as A

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_DELEGATE = f"""CASE WHEN ext IN ({T.sql_list(T.INDENTED)}) THEN regexp_matches(norm, '{T.DELEGATE_INDENTED}') WHEN ext IN ({T.sql_list(T.BRACED)}) THEN regexp_matches(norm, '{T.DELEGATE_BRACED}') ELSE false END"""
_NORM = f"""{A.FUNCS}, {NORM_SQL}, hs AS (SELECT func_id, sha1(norm) AS h, {_DELEGATE} AS dg FROM nb WHERE len(string_split(norm, chr(10))) >= 3), gr AS (SELECT h, count(*) AS n, arg_min(dg, func_id) AS delegate FROM hs GROUP BY ALL HAVING count(*) >= 2)"""


@query(f"WITH {_NORM} SELECT left(h, 8) AS hash, func_id, n FROM hs JOIN gr USING (h) WHERE NOT delegate")
def dup_exact(s, d):
    return L.duplicate_members(A.table(s, d, "funcs")).where("not delegate").drop("delegate")


@query(f"WITH {_NORM} SELECT n AS size, delegate, count(*) AS groups FROM gr GROUP BY ALL")
def dup_summary(s, d):
    """Groups by size, those of functions that only forward apart."""
    return L.duplicate_members(A.table(s, d, "funcs")).groupBy("n", "delegate").agg((F.count("*") / F.col("n")).cast("long").alias("groups")).select(F.col("n").alias("size"), "delegate", "groups")


@query(f"WITH {A.FUNCS}, {NORM_SQL} SELECT func_id, {_DELEGATE} AS delegate FROM nb")
def delegates(s, d):
    """Which functions only forward."""
    ext = T.file_ext(F.col("path"))
    norm = A.functions(s, d).where("body is not null").select("func_id", ext.alias("ext"), T.normal_body(F.col("body"), ext).alias("norm"))
    return norm.select("func_id", T.is_delegate(F.col("norm"), F.col("ext")).alias("delegate"))


_PAST = r"""bl AS (SELECT *, string_split(regexp_replace(regexp_replace(coalesce(body, ''), '\r\n?', chr(10), 'g'), chr(10) || '$', ''), chr(10)) AS ls FROM fn),
b2 AS (SELECT *, list_filter(range(2, len(ls) + 1), lambda k: trim(ls[k], ' ') <> '' AND length(regexp_extract(ls[k], '^[ \t]*', 0)) > length(regexp_extract(ls[1], '^[ \t]*', 0))) AS deep FROM bl),
ps AS (SELECT *, CASE WHEN regexp_matches(ls[1], ':\s*$|^\s*func') THEN CASE WHEN len(deep) > 0 THEN array_to_string(ls[deep[1]:], chr(10)) ELSE '' END ELSE coalesce(body, '') END AS past FROM b2)"""


@query(f"""WITH {A.FUNCS}, {_PAST}, x AS (SELECT repo, path, name, line, length(past) BETWEEN 1 AND 220 AS small FROM ps),
y AS (SELECT *, last_value(CASE WHEN NOT small THEN name END IGNORE NULLS) OVER (PARTITION BY repo, path ORDER BY line, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carrier FROM x) SELECT repo, path, name, carrier FROM y WHERE small""")
def micro_groups(s, d):
    return D.micro_carriers(A.functions(s, d))


@query(f"""WITH {A.FUNCS} SELECT func_id, path || ' :: func ' || coalesce(name, '') || '(' || coalesce(array_to_string(list_transform(params, lambda p: CASE WHEN coalesce(p.type, '') = '' THEN coalesce(p.name, '') ELSE concat_ws(': ', p.name, p.type) END), ', '), '') || ')' ||
  CASE WHEN coalesce(ret, '') <> '' THEN ' -> ' || ret ELSE '' END || chr(10) || substr(coalesce(body, ''), 1, 6000) AS doc FROM fn""")
def function_docs(s, d):
    return D.function_docs(A.functions(s, d))


@query()
def function_chunks(s, d):
    return D.function_chunks(A.functions(s, d))


@query()
def file_docs(s, d):
    return D.file_docs(A.live_files(s, d), A.functions(s, d))


_T0, _T1 = "2024-06-01", "2024-10-01"


def _snap_sql(name: str, at: str) -> str:
    return f"{name} AS (SELECT * EXCLUDE r FROM (SELECT repo, path, file_id, sha, mtime_ns, size, row_number() OVER (PARTITION BY repo, path ORDER BY indexed_at DESC, file_id DESC) AS r FROM files WHERE indexed_at <= TIMESTAMPTZ '{at} 00:00:00+00' AND (removed_at IS NULL OR removed_at > TIMESTAMPTZ '{at} 00:00:00+00')) WHERE r = 1)"


_RESCAN = f"""WITH {_snap_sql('o', _T0)}, {_snap_sql('n', _T1)}, ac AS (SELECT repo, path, CASE WHEN o.file_id IS NULL THEN 'added' WHEN n.file_id IS NULL THEN 'deleted' WHEN o.mtime_ns IS NOT DISTINCT FROM n.mtime_ns AND o.size IS NOT DISTINCT FROM n.size THEN 'unchanged'
  WHEN o.sha IS NOT DISTINCT FROM n.sha THEN 'touched' ELSE 'updated' END AS action FROM o FULL JOIN n USING (repo, path))"""


def _snaps(s, d):
    f = A.table(s, d, "files")
    return H.as_of(f, _T0), H.as_of(f, _T1)


@query(f"{_RESCAN} SELECT repo, path, action FROM ac")
def rescan_actions(s, d):
    return H.rescan(*_snaps(s, d), ["repo", "path"])


@query(f"{_RESCAN} SELECT action, count(*) AS n FROM ac GROUP BY ALL")
def rescan_stats(s, d):
    return H.rescan(*_snaps(s, d), ["repo", "path"]).groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {_snap_sql('o', _T0)}, {_snap_sql('n', _T1)} SELECT repo, path FROM o ANTI JOIN n USING (repo, path)")
def deleted_ids(s, d):
    old, new = _snaps(s, d)
    return old.join(new, ["repo", "path"], "left_anti").select("repo", "path")


@query(f"{_RESCAN} SELECT repo, count(*) AS n, bool_or(action <> 'unchanged') AS dirty FROM ac GROUP BY ALL")
def stat_diff(s, d):
    acts = H.rescan(*_snaps(s, d), ["repo", "path"])
    return acts.groupBy("repo").agg(F.count("*").alias("n"), F.bool_or(F.col("action") != "unchanged").alias("dirty"))


@query("""WITH o AS (SELECT l_orderkey, l_partkey, l_extendedprice, l_linenumber, l_suppkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS used FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, used FROM o WHERE used <= 60""")
def budget_prefix(s, d):
    rows = A.table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_linenumber", "l_suppkey", "l_quantity")
    order = [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")]
    return H.prefix_keep(rows, "l_orderkey", order, "l_quantity", 60).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "used")


@query("""WITH RECURSIVE o AS MATERIALIZED (SELECT l_orderkey, l_partkey, l_quantity AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem),
k(l_orderkey, r, used, kept) AS (SELECT DISTINCT l_orderkey, 0::BIGINT, 0.0::DOUBLE, []::BIGINT[] FROM o UNION ALL SELECT k.l_orderkey, o.r, CASE WHEN used + c <= 60 THEN used + c ELSE used END, CASE WHEN used + c <= 60 THEN list_append(kept, l_partkey) ELSE kept END FROM k JOIN o ON o.l_orderkey = k.l_orderkey AND o.r = k.r + 1)
SELECT l_orderkey, arg_max(kept, r) AS kept FROM k GROUP BY ALL""")
def budget_skip(s, d):
    rows = A.table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_linenumber", "l_suppkey", "l_quantity")
    order = [(-F.col("l_extendedprice")).alias("p"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return H.greedy_keep(rows, "l_orderkey", order, "l_partkey", "l_quantity", 60.0)


_COST = "length('[\"' || type || '\",\"' || src_key || '\",\"' || dst_key || '\"]')"
_BUDGET = 40_000


@query(f"""WITH RECURSIVE {A.EDGES}, pr AS MATERIALIZED (SELECT a, b, count(*) AS w, sum({_COST})::BIGINT AS c FROM (SELECT split_part(src_key, '/', 1) AS a, split_part(dst_key, '/', 1) AS b, * FROM edges) GROUP BY a, b),
od AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY w DESC, a, b) AS r FROM pr), k(r, used, taken) AS (SELECT 0::BIGINT, 0::BIGINT, false UNION ALL SELECT od.r, CASE WHEN used + c <= {_BUDGET} THEN used + c ELSE used END, used + c <= {_BUDGET} FROM k JOIN od ON od.r = k.r + 1)
SELECT a, b, w, c FROM od JOIN k USING (r) WHERE taken""")
def wire_budget(s, d):
    """Whole pairs of folders within a budget of characters, those of most wires first."""
    e = A.follow_edges(s, d)
    cost = F.length(F.concat(F.lit('["'), "type", F.lit('","'), "src_key", F.lit('","'), "dst_key", F.lit('"]')))
    rows = e.select(F.substring_index("src_key", "/", 1).alias("a"), F.substring_index("dst_key", "/", 1).alias("b"), F.lit(1).alias("one"), cost.alias("cost"))
    return H.pair_budget(rows, ["a", "b"], "one", "cost", _BUDGET).select("a", "b", "w", "c")


@query(f"""WITH {A.EDGES} SELECT type, split_part(src_key, '::', 1) AS sf, split_part(dst_key, '::', 1) AS df, split_part(src_key, '::', 2) AS sfn, split_part(dst_key, '::', 2) AS dfn FROM edges WHERE type IN ('call', 'var') AND split_part(src_key, '::', 1) <> split_part(dst_key, '::', 1)""")
def named_wires(s, d):
    part = lambda c, k: F.split_part(F.col(c), F.lit("::"), F.lit(k))
    e = A.follow_edges(s, d).where("type in ('call', 'var')")
    return e.select("type", part("src_key", 1).alias("sf"), part("dst_key", 1).alias("df"), part("src_key", 2).alias("sfn"), part("dst_key", 2).alias("dfn")).where("sf <> df").orderBy("type", "sf", "df", "dfn", "sfn")


@query(f"WITH {A.FUNCS} SELECT repo, path, list(line || ':' || name ORDER BY line, name) AS fns FROM fn WHERE line IS NOT NULL AND name IS NOT NULL GROUP BY ALL")
def fn_roster(s, d):
    """The functions of each file in line order; a file holds a bounded number of functions."""
    f = A.functions(s, d).where("line is not null and name is not null")
    return f.groupBy("repo", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda x: F.concat_ws(":", x.line.cast("string"), x["name"])).alias("fns"))


@query(f"WITH {A.FUNCS} SELECT repo, path, name, list_sort(list_distinct(list_filter(writes, lambda w: coalesce(w, '') <> ''))) AS writes, coalesce(len(params), 0) AS n_params FROM fn WHERE writes IS NOT NULL")
def fn_io(s, d):
    w = F.array_sort(F.array_distinct(F.filter("writes", lambda x: F.coalesce(x, F.lit("")) != "")))
    return A.functions(s, d).where("writes is not null").select("repo", "path", "name", w.alias("writes"), F.coalesce(F.size("params"), F.lit(0)).alias("n_params"))


@query("""SELECT file_id, (row_number() OVER (ORDER BY file_id) - 1) // 250 AS shard FROM (SELECT DISTINCT file_id FROM files)""")
def shards(s, d):
    """Shard of each row in id order, 250 rows to a shard, numbered without gathering the ids in one task."""
    ids = A.table(s, d, "files").select("file_id").distinct()
    return G.rank_by_sorting(ids, [F.asc("file_id")]).select("file_id", F.floor((F.col("rank") - 1) / 250).cast("long").alias("shard"))


@query("""WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 90 DAY GROUP BY ALL) SELECT l_partkey, n, round(n / (SELECT max(n) FROM c), 3) AS churn FROM c""")
def churn(s, d):
    """Touches in the last 90 days relative to the most touched."""
    li = A.table(s, d, "lineitem").select("l_partkey", "l_shipdate")
    last = li.agg(F.max("l_shipdate")).first()[0]
    n = li.where(F.col("l_shipdate") >= F.lit(last) - F.expr("INTERVAL 90 DAYS")).groupBy("l_partkey").agg(F.count("*").alias("n"))
    most = n.agg(F.max("n")).first()[0]
    return n.select("l_partkey", "n", F.round(F.col("n") / F.lit(most), 3).alias("churn"))


_HEX = " + ".join(f"(strpos('0123456789abcdef', substr(h, {k}, 1)) - 1) * {16 ** (12 - k)}::HUGEINT" for k in range(1, 13))


@query(f"""WITH {A.FILES}, rw AS (SELECT repo, sha256(concat_ws('|', CASE WHEN path IS NULL THEN '0' ELSE '1' || path END, CASE WHEN mtime_ns IS NULL THEN '0' ELSE '1' || mtime_ns END, CASE WHEN size IS NULL THEN '0' ELSE '1' || size END)) AS h FROM lf)
SELECT repo, count(*) AS n, sum({_HEX})::HUGEINT::VARCHAR AS digest FROM rw GROUP BY ALL""")
def fingerprints(s, d):
    return H.fingerprint(A.live_files(s, d), "repo", ["path", "mtime_ns", "size"])


@query("""SELECT repo, path, CASE WHEN length(path) - length(replace(path, '/', '')) > 0 THEN 1 ELSE 0 END AS nested, row_number() OVER (PARTITION BY repo ORDER BY list_transform(string_split(path, '/')[:-2], lambda x: '1' || x) || ['0' || split_part(path, '/', -1)]) AS walk_ord FROM (SELECT DISTINCT repo, path FROM files WHERE removed_at IS NULL)""")
def walk_order(s, d):
    """Files before folders, each sorted: the order of a walk through every repository."""
    parts = F.split("path", "/")
    key = F.concat(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.concat(F.lit("1"), x)), F.array(F.concat(F.lit("0"), F.element_at(parts, -1))))
    f = A.table(s, d, "files").where("removed_at is null").select("repo", "path").distinct().withColumn("k", key)
    return f.select("repo", "path", F.when(F.size(parts) > 1, 1).otherwise(0).alias("nested"), F.row_number().over(Window.partitionBy("repo").orderBy("k")).alias("walk_ord"))


@query(f"""WITH {A.EDGES}, ps AS (SELECT DISTINCT file, CASE WHEN true THEN p_brand END AS g FROM parts), px AS (SELECT g, row_number() OVER (ORDER BY g) * 100 % 700 AS x, row_number() OVER (ORDER BY g) * 37 % 500 AS y FROM (SELECT DISTINCT g FROM ps)),
w AS (SELECT least(a.p_brand, b.p_brand) AS a, greatest(a.p_brand, b.p_brand) AS b, count(*) AS w FROM edges JOIN parts a ON a.key = src_key JOIN parts b ON b.key = dst_key WHERE a.p_brand <> b.p_brand GROUP BY ALL),
j AS (SELECT w.a, w.b, w, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM w JOIN px p ON p.g = w.a JOIN px q ON q.g = w.b),
t AS (SELECT *, unnest(range(0, 17)) / 16.0::DOUBLE AS t FROM j WHERE d > 140)
SELECT a, b, t, round((1 - t) * (1 - t) * x0 + 2 * (1 - t) * t * ((x0 + x1) / 2.0 - (y1 - y0) * 0.2) + t * t * x1, 9) AS x, round((1 - t) * (1 - t) * y0 + 2 * (1 - t) * t * ((y0 + y1) / 2.0 + (x1 - x0) * 0.2) + t * t * y1, 9) AS y FROM t""")
def highway_arcs(s, d):
    """Seventeen points of a quadratic Bézier curve between clusters more than 140 units apart, bent to one side by a fifth of the way."""
    parts = A.table(s, d, "part").select("p_brand").distinct()
    place = G.rank_by_sorting(parts, [F.asc("p_brand")]).select(F.col("p_brand").alias("g"), (F.col("rank") * 100 % 700).alias("x"), (F.col("rank") * 37 % 500).alias("y"))
    keys = A.table(s, d, "part").select(A.part_key().alias("key"), "p_brand")
    e = A.follow_edges(s, d).join(keys.select(F.col("key").alias("src_key"), F.col("p_brand").alias("p")), "src_key").join(keys.select(F.col("key").alias("dst_key"), F.col("p_brand").alias("q")), "dst_key").where("p <> q")
    w = e.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    j = w.join(place.select(F.col("g").alias("a"), F.col("x").alias("x0"), F.col("y").alias("y0")), "a").join(place.select(F.col("g").alias("b"), F.col("x").alias("x1"), F.col("y").alias("y1")), "b")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    far = j.where(F.sqrt(dx * dx + dy * dy) > 140).withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: i / 16.0)))
    t = F.col("t")
    curve = lambda p0, p1, bend: F.round((1 - t) * (1 - t) * F.col(p0) + 2 * (1 - t) * t * ((F.col(p0) + F.col(p1)) / 2.0 + bend) + t * t * F.col(p1), 9)
    return far.select("a", "b", "t", curve("x0", "x1", -dy * 0.2).alias("x"), curve("y0", "y1", dx * 0.2).alias("y"))
