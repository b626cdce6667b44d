"""Composite answers and the rest of the inventory, with SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import bodies as B
from quillgraph.functions import text as T
from quillgraph.operators import coupling as C
from quillgraph.operators import explore as X
from quillgraph.operators import graph as G
from quillgraph.operators import grouping as U
from quillgraph.operators import textsearch as S
from quillgraph.plans import codegraph as K
from quillgraph.plans import recall as Q
from quillgraph.sources import adapters as A

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query()
def body_facts(s, d):
    """The logical lines of functions and their intro."""
    return B.body_facts(A.functions(s, d))


@query("SELECT p_partkey, list_filter(regexp_split_to_array(lower(regexp_replace(translate(p_type, '_-', '  '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '\\s+'), lambda t: t <> '') AS tokens, round(p_size::DOUBLE / (30 + p_partkey), 9) AS gain FROM part")
def sql_functions(s, d):
    """The registered SQL functions in use."""
    B.register(s)
    return A.table(s, d, "part").selectExpr("p_partkey", "ident_tokens(p_type) AS tokens", "round(rrf(p_partkey, cast(p_size AS DOUBLE)), 9) AS gain")


@query(f"""WITH {A.FILES}, sc AS (SELECT repo, path AS scene, list_filter(list_transform(coalesce(scripts, []), lambda x: regexp_replace(x, '^res://', '')), lambda x: x <> '') AS ls, nullif(regexp_replace(trim(coalesce(attached_script, ''), ' '), '^res://', ''), '') AS one FROM lf),
ea AS (SELECT repo, scene, CASE WHEN len(ls) > 0 THEN ls WHEN one IS NOT NULL THEN [one] ELSE [] END AS ls FROM sc) SELECT repo, scene, k - 1 AS ord, ls[k] AS script FROM (SELECT repo, scene, ls, unnest(range(1, len(ls) + 1)) AS k FROM ea)""")
def script_links(s, d):
    return U.script_links(A.live_files(s, d))




@query()
def weld_units(s, d):
    """Scenes and their scripts as units of at most twelve files."""
    links = U.script_links(A.live_files(s, d)).select(F.concat_ws("|", "repo", "scene").alias("a"), F.concat_ws("|", "repo", "script").alias("b")).where("a <> b")
    return U.weld(links)


@query()
def linkage_split(s, d):
    """Every label of the embeddings split by average linkage."""
    rows = A.table(s, d, "embeddings").where("embedding is not null and label is not null").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), "embedding")
    return U.split_groups(rows, 0.2)


@query(f"""WITH {A.FUNCS}, {A.DOCS}, mc AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM docs) GROUP BY ALL)
SELECT func_id, name, coalesce(n, 0) AS mentions, CASE WHEN coalesce(n, 0) >= 2 THEN 'review' ELSE 'likely' END AS tier FROM fn LEFT JOIN mc ON token = name WHERE name IS NOT NULL""")
def mention_floor(s, d):
    """Functions whose name texts mention twice or more are only for review."""
    n = S.mention_counts(A.docs(s, d)).select(F.col("token").alias("name"), "n")
    got = A.functions(s, d).where("name is not null").select("func_id", "name").join(n, "name", "left").withColumn("mentions", F.coalesce("n", F.lit(0)))
    return got.select("func_id", "name", "mentions", F.when(F.col("mentions") >= 2, "review").otherwise("likely").alias("tier"))


@query("""WITH p AS (SELECT DISTINCT repo, path FROM files WHERE removed_at IS NULL), x AS (SELECT repo, path, string_split(path, '/')[:-2] AS d, lag(string_split(path, '/')[:-2]) OVER (PARTITION BY repo ORDER BY path) AS b FROM p),
y AS (SELECT *, len(list_filter(range(1, len(d) + 1), lambda i: b IS NOT NULL AND d[:i] = b[:i])) AS same FROM x) SELECT repo, path, array_to_string(d[same + 1:], '/') AS header FROM y""")
def tree_delta(s, d):
    """The folders that change from one path to the next."""
    f = A.table(s, d, "files").where("removed_at is null").select("repo", "path").distinct().withColumn("d", T.dir_parts(F.col("path")))
    f = f.withColumn("b", F.lag("d").over(Window.partitionBy("repo").orderBy("path")))
    at = F.when(F.size("d") > 0, F.sequence(F.lit(1), F.size("d"))).otherwise(F.array().cast("array<int>"))
    same = F.size(F.filter(at, lambda i: F.col("b").isNotNull() & (F.slice("d", 1, i) == F.slice("b", 1, i))))
    return f.withColumn("same", same).select("repo", "path", F.array_join(F.slice("d", F.col("same") + 1, F.size("d")), "/").alias("header"))


_ONE = "(SELECT min(path) FROM membership)"
_CTX = f"""{A.EDGES}, {A.MEMBERSHIP}, ty AS (SELECT DISTINCT split_part(src_key, '::', 1) AS a, split_part(dst_key, '::', 1) AS b, src_key, dst_key, type FROM edges WHERE split_part(src_key, '::', 1) <> split_part(dst_key, '::', 1)),
nb AS (SELECT b AS nb, 'out' AS direction, count(*) AS n FROM ty WHERE a = {_ONE} GROUP BY ALL UNION ALL SELECT a, 'in', count(*) FROM ty WHERE b = {_ONE} GROUP BY ALL),
top AS (SELECT 'neighbour ' || direction AS section, nb AS name, n, (SELECT count(*) FROM nb) AS total FROM nb ORDER BY n DESC, nb, direction LIMIT 15),
own AS (SELECT 'cluster' AS section, cluster AS name, count(*) AS n, count(*) AS total FROM membership WHERE cluster = (SELECT cluster FROM membership WHERE path = {_ONE}) GROUP BY cluster),
hub AS (SELECT 'incoming' AS section, {_ONE} AS name, (SELECT count(*) FROM ty WHERE b = {_ONE}) AS n, (SELECT count(*) FROM ty WHERE b = {_ONE}) AS total)"""


@query(f"""WITH {_CTX}, al AS (SELECT nb, sum(n) AS n FROM nb GROUP BY ALL), pr2 AS (SELECT a, b FROM ty UNION SELECT b, a FROM ty), rg AS (SELECT pr2.b AS nb, arg_min(al.nb, (-al.n, al.nb)) AS via, count(DISTINCT al.nb) AS n FROM pr2 JOIN al ON al.nb = pr2.a WHERE pr2.b <> {_ONE} AND pr2.b NOT IN (SELECT nb FROM al) GROUP BY ALL),
rn AS (SELECT 'ring via ' || via AS section, nb AS name, n, (SELECT count(*) FROM rg) AS total FROM rg ORDER BY n DESC, nb LIMIT 10)
SELECT * FROM top UNION ALL SELECT * FROM own UNION ALL SELECT * FROM hub UNION ALL SELECT * FROM rn""")
def context(s, d):
    """Cluster, incoming edges, first neighbours of the first file and the files behind those."""
    edges, member = A.follow_edges(s, d), A.part_membership(s, d)
    first = member.agg(F.min("path")).first()[0] or ""
    return U.file_context(first, G.typed_adjacency(edges), member, G.in_degrees(edges, member.select("path")))


@query()
def explore(s, d):
    """The answer to one question: map of 900 tokens, clusters, files and slices of the functions found."""
    c = K.Code(s, d)
    edges = c.edges()
    hits = Q.function_hits(s, d, X.HITS, {"f1": Q.NAMED["f1"]}).select("key", "file", "name", "cos", "rank")
    symbols = c.decl.select(F.concat_ws("|", "repo", "path").alias("path"), "name", "key")
    ranks = G.pagerank(G.file_wires(edges), symbols.select("path").distinct())
    lines = G.repo_map(ranks, symbols, G.symbol_degrees(edges, symbols), 900).select(F.col("used").alias("rank"), "line")
    members = A.table(s, d, "cluster_members")
    sized = members.select("cluster_id", F.concat_ws("|", "repo", "path").alias("p")).distinct().groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("p").alias("p"))
    top = sized.orderBy(F.desc("size"), "cluster_id").limit(8).join(C.cluster_labels(members, "cluster_id"), "cluster_id")
    shown = top.orderBy(F.desc("size"), "cluster_id").select("label", "size", F.array("p").alias("paths"))
    bodies = A.functions(s, d).select(F.concat_ws("::", F.concat_ws("|", "repo", "path"), "name").alias("key"), "line", "body")
    return X.explore(hits, bodies, edges, lines, shown)


def _hard(first):
    r = first.withColumn("hard", F.coalesce("first", F.lit(1000)) > 3)
    return r.groupBy("hard").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@query(f"WITH {Q._EVAL} SELECT coalesce(first, 1000) > 3 AS hard, count(*) AS n, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM ev GROUP BY ALL")
def hard_easy(s, d):
    """Held-out items by whether the first target comes after the third place."""
    return _hard(Q._first_ranks(s, d))


@query(f"""WITH {Q._EVAL}, eg AS (SELECT DISTINCT item_id, array_to_string(tk[i:i+2], ' ') AS gram FROM (SELECT item_id, tk, unnest(range(1, len(tk) - 1)) AS i FROM it)), dg3 AS (SELECT DISTINCT path, array_to_string(tk[i:i+2], ' ') AS gram FROM (SELECT path, tk, unnest(range(1, len(tk) - 1)) AS i FROM (SELECT path, {Q.tokens_sql('body')} AS tk FROM docs))),
ec AS (SELECT item_id, count(DISTINCT path) AS n FROM eg JOIN dg3 USING (gram) GROUP BY ALL) SELECT item_id, item_id IN (SELECT item_id FROM tg) AS anchored, coalesce(n, 0) AS echoes FROM it LEFT JOIN ec USING (item_id)""")
def golden_check(s, d):
    """Of each held-out item whether its anchor stands in a document, and how many documents echo three of its tokens in a row."""
    tok = A.table(s, d, "eval_items").select("item_id", T.recall_tokens(F.col("text")).alias("tk"))
    there = Q.passage_targets(tok, A.docs(s, d)).select("item_id").distinct().withColumn("anchored", F.lit(True))
    got = tok.select("item_id").join(there, "item_id", "left").join(Q.echo_3gram(s, d), "item_id", "left")
    return got.select("item_id", F.coalesce("anchored", F.lit(False)).alias("anchored"), F.coalesce("n_docs", F.lit(0)).alias("echoes"))


@query(f"""WITH {A.EDGES}, tk AS (SELECT src_key, dst_key, type FROM (SELECT src_key, dst_key, type, row_number() OVER (PARTITION BY type ORDER BY src_key, dst_key) AS r FROM edges) WHERE r <= 10), an AS (SELECT src_key, dst_key FROM edges WHERE type <> 'var')
SELECT type, count(*) AS tasks, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM an WHERE an.src_key = tk.src_key AND an.dst_key = tk.dst_key)) AS solved, round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM an WHERE an.src_key = tk.src_key AND an.dst_key = tk.dst_key)) / count(*), 4) AS share FROM tk GROUP BY ALL""")
def task_scores(s, d):
    """Tasks by type with those that a set of answers solves; the answers here are the edges of two types."""
    answers = A.follow_edges(s, d).where("type <> 'var'").select("src_key", "dst_key").distinct().withColumn("hit", F.lit(1))
    per = task_sample(s, d).join(answers, ["src_key", "dst_key"], "left").groupBy("type").agg(F.count("*").alias("tasks"), F.count("hit").alias("solved"))
    return per.withColumn("share", F.round(F.col("solved") / F.col("tasks"), 4))


@query(f"""WITH {A.EDGES}, x AS (SELECT src_key, dst_key, type, row_number() OVER (PARTITION BY type ORDER BY src_key, dst_key) AS r FROM edges) SELECT src_key, dst_key, type FROM x WHERE r <= 10""")
def task_sample(s, d):
    """The first ten edges of each type: tasks for an evaluation."""
    w = Window.partitionBy("type").orderBy("src_key", "dst_key")
    return A.follow_edges(s, d).withColumn("r", F.row_number().over(w)).where("r <= 10").drop("r")


@query("""WITH RECURSIVE c AS (SELECT DISTINCT cluster_id, repo, path FROM cluster_members), m AS (SELECT a.cluster_id AS x, b.cluster_id AS y, count(*) AS n FROM c a JOIN c b ON a.repo = b.repo AND a.path = b.path AND a.cluster_id < b.cluster_id GROUP BY ALL) SELECT x, y, n FROM m""")
def shared_files(s, d):
    """Pairs of clusters that hold the same file; a file lies in a few clusters at most."""
    c = A.table(s, d, "cluster_members").select("cluster_id", "repo", "path").distinct()
    x, y = c.withColumnRenamed("cluster_id", "x"), c.withColumnRenamed("cluster_id", "y")
    return x.join(y, ["repo", "path"]).where("x < y").groupBy("x", "y").agg(F.count("*").alias("n"))


@query()
def modularity(s, d):
    """Quality of the communities of the similarity graph."""
    from quillgraph.operators import vectors as V
    from quillgraph.plans import clusters as P

    g = C.sim_graph(V.mutual(P._near(s, d)), P._calls(s, d))
    parts = C.communities(g)
    n = parts.select("community").distinct().count()
    return s.createDataFrame([(n, round(C.modularity(g, parts), 6))], "communities long, modularity double")
