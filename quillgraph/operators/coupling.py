"""Coupling between clusters, architecture rules, similarity graph, communities, labels."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import admissible, dir_seed, ident_tokens, node_file, seed_chain, stem, titleize
from quillgraph.session import release, stage

#: Known words of the rules.
KINDS, TYPES, SEVERITIES = ("forbid", "budget"), ("call", "var", "signal", "inst", "attach", "alias"), ("error", "warn")
RULE_KEYS = ("id", "kind", "from", "to", "max", "types", "severity")


def classed_edges(edges: DataFrame, membership: DataFrame, in_tests: Callable[[Column], Column] | None = None) -> DataFrame:
    """(src_key, dst_key, types, src, dst, a, b, class) of every distinct edge between different files.

    The order of the tests matters: tests, scene (both ends are scenes), unclustered, internal, cross. ``in_tests`` says of a
    file whether it belongs to the tests, otherwise the cluster of that name does.
    """
    e = edges.groupBy("src_key", "dst_key").agg(F.array_sort(F.collect_set("type")).alias("types"))
    e = e.withColumns({"src": node_file(F.col("src_key")), "dst": node_file(F.col("dst_key"))}).where("src <> dst")
    e = e.join(membership.select(F.col("path").alias("src"), F.col("cluster").alias("a")), "src", "left")
    e = e.join(membership.select(F.col("path").alias("dst"), F.col("cluster").alias("b")), "dst", "left")
    if in_tests is None:
        tests = F.coalesce(F.col("a") == "tests", F.lit(False)) | F.coalesce(F.col("b") == "tests", F.lit(False))
    else:
        tests = in_tests(F.col("src")) | in_tests(F.col("dst"))
    scenes = F.col("src_key").endswith("::tscn") & F.col("dst_key").endswith("::tscn")
    kind = F.when(tests, "tests").when(scenes, "scene").when(F.col("a").isNull() | F.col("b").isNull(), "unclustered").when(F.col("a") == F.col("b"), "internal").otherwise("cross")
    return e.withColumn("class", kind)


def pair_types(classed: DataFrame) -> DataFrame:
    """(x, y, type, n) of the edges across clusters by unordered pair; an edge counts once for each of its types."""
    cross = classed.where("class = 'cross'").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.explode("types").alias("type"))
    return cross.groupBy("x", "y", "type").agg(F.count("*").alias("n"))


def cluster_coupling(classed: DataFrame) -> DataFrame:
    """(cluster, internal, outgoing, incoming, share) of each cluster with an edge that counts."""
    inside = classed.where("class = 'internal'").select(F.col("a").alias("cluster"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("n"))
    cross = classed.where("class = 'cross'")
    rows = inside.unionAll(cross.select("a", F.lit(0), F.lit(1), F.lit(0))).unionAll(cross.select("b", F.lit(0), F.lit(0), F.lit(1)))
    out = rows.groupBy("cluster").agg(F.sum("i").alias("internal"), F.sum("o").alias("outgoing"), F.sum("n").alias("incoming"))
    total = F.col("internal") + F.col("outgoing") + F.col("incoming")
    return out.withColumn("share", F.round((F.col("outgoing") + F.col("incoming")) / total, 3))


def worst_pairs(classed: DataFrame, top: int = 10, file_pairs: int = 3) -> DataFrame:
    """(x, y, wires, files): the unordered cluster pairs with most edges, each with its heaviest file pairs."""
    cross = classed.where("class = 'cross'").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.least("src", "dst").alias("f"), F.greatest("src", "dst").alias("g"))
    best = cross.groupBy("x", "y").agg(F.count("*").alias("wires")).orderBy(F.desc("wires"), "x", "y").limit(top)
    per = cross.join(F.broadcast(best.select("x", "y")), ["x", "y"]).groupBy("x", "y", "f", "g").agg(F.count("*").alias("n"))
    w = Window.partitionBy("x", "y").orderBy(F.desc("n"), "f", "g")
    first = per.withColumn("r", F.row_number().over(w)).where(F.col("r") <= file_pairs)
    shown = first.groupBy("x", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(" ", "f", "g", F.col("n").cast("string")).alias("t")))), lambda s: s.t).alias("files"))
    return best.join(shown, ["x", "y"])


def parse_rules(lines: DataFrame) -> DataFrame:
    """(n, id, kind, from, to, max, types, severity, errors) of JSON rules, one a row (n, text); nothing is dropped.

    A missing id is made from the rule. An id used twice is an error of each rule after the first.
    """
    get = lambda k: F.get_json_object("text", f"$.{k}")
    rows = lines.withColumns({"kind": get("kind"), "from_": get("from"), "to_": get("to"), "max_": get("max"), "severity": F.coalesce(get("severity"), F.lit("error")), "types": F.from_json(get("types"), "array<string>")})
    rows = rows.withColumn("id", F.coalesce(get("id"), F.concat(F.coalesce("kind", F.lit("?")), F.lit(" "), F.coalesce("from_", F.lit("?")), F.lit("->"), F.coalesce("to_", F.lit("?")))))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("n"))
    rows = rows.withColumn("nth", nth)
    keys = F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>"))
    whole = F.col("max_").rlike("^-?[0-9]+$")
    tests = [
        (F.json_object_keys("text").isNull(), F.lit("not an object")),
        (F.size(F.array_except(keys, F.array(*map(F.lit, RULE_KEYS)))) > 0, F.lit("unknown key")),
        (~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), F.lit("unknown kind")),
        (F.col("from_").isNull() | F.col("to_").isNull(), F.lit("missing end")),
        ((F.col("kind") == "budget") & F.col("max_").isNull(), F.lit("budget without max")),
        (F.col("max_").isNotNull() & ~whole, F.lit("max is no whole number")),
        (whole & F.col("max_").startswith("-"), F.lit("negative max")),
        ((F.col("kind") == "forbid") & F.col("max_").isNotNull(), F.lit("forbid with max")),
        (~F.col("severity").isin(*SEVERITIES), F.lit("unknown severity")),
        (F.size(F.array_except(F.coalesce("types", F.array().cast("array<string>")), F.array(*map(F.lit, TYPES)))) > 0, F.lit("unknown type")),
        (F.col("nth") > 1, F.lit("duplicate id")),
    ]
    errors = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), e) for c, e in tests]), lambda x: x.isNotNull())
    limit = F.when(whole, F.try_to_number("max_", F.lit("S999999999"))).cast("long")
    return rows.select("n", "id", "kind", F.col("from_").alias("from"), F.col("to_").alias("to"), limit.alias("max"), "types", "severity", errors.alias("errors"))


def check_rules(rules: DataFrame, classed: DataFrame, pairs: int = 5) -> DataFrame:
    """(id, severity, wires, limit, violated, files, more_files) of every valid rule, by ordered cluster pair; errors first, then by rule and ends."""
    valid = rules.where(F.size("errors") == 0)
    cross = classed.where("class = 'cross'").select("a", "b", "types", F.col("src").alias("f"), F.col("dst").alias("g")).withColumnRenamed("types", "have")
    hit = valid.join(cross, (F.col("from") == F.col("a")) & (F.col("to") == F.col("b")), "left").where(F.col("types").isNull() | F.col("have").isNull() | F.arrays_overlap("types", "have"))
    per = hit.where("f is not null").groupBy("id", "f", "g").agg(F.count("*").alias("n"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "f", "g")
    top = per.withColumn("r", F.row_number().over(w))
    shown = top.where(F.col("r") <= pairs).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(" ", "f", "g").alias("t")))), lambda s: s.t).alias("files"))
    sums = per.groupBy("id").agg(F.sum("n").alias("wires"), F.count("*").alias("nf"))
    limit = F.when(F.col("kind") == "budget", F.col("max")).otherwise(F.lit(0))
    got = valid.join(sums, "id", "left").join(shown, "id", "left")
    wires = F.coalesce("wires", F.lit(0))
    got = got.orderBy(F.col("severity") != "error", "id", "from", "to")
    return got.select("id", "severity", wires.alias("wires"), limit.cast("long").alias("limit"), (wires > limit).alias("violated"), F.coalesce("files", F.array().cast("array<string>")).alias("files"), F.greatest(F.coalesce("nf", F.lit(0)) - pairs, F.lit(0)).alias("more_files"))


def sim_graph(mutual_pairs: DataFrame, calls: DataFrame) -> DataFrame:
    """(x, y, w), x < y: 0.7 sim once for each direction of a mutual pair, plus calls up to five."""
    sims = mutual_pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), (F.lit(1.4) * F.col("sim")).alias("w"))
    wired = calls.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).where("x <> y").groupBy("x", "y").agg(F.least(F.count("*"), F.lit(5)).cast("double").alias("w"))
    return sims.unionAll(wired).groupBy("x", "y").agg(F.sum("w").alias("w"))


def communities(graph: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, community) by rounds of local moves to the neighbouring community of the largest modularity gain.

    Half of the nodes, by a hash, may move in a round and the other half in the next, and ties go to the smallest
    community, so the result is the same on every run. It ends when both halves stood still, so that no node gains by a
    move, or after ``rounds`` if given. All of it is joins and sums; no graph is gathered in one task.
    """
    both = stage(graph.select("x", "y", "w").unionAll(graph.select("y", "x", "w")), "moves-edges")
    degree = stage(both.groupBy(F.col("x").alias("node")).agg(F.sum("w").alias("k")), "moves-degree")
    m2 = degree.agg(F.sum("k")).first()[0]
    held = stage(degree.select("node", "k", F.col("node").alias("c")), "moves")
    state = held
    if not m2:
        return state.select("node", F.col("c").alias("community"))
    still = False
    for i in count() if rounds is None else range(rounds):
        total = state.groupBy("c").agg(F.sum("k").alias("tot"))
        near = both.join(state.select(F.col("node").alias("y"), "c"), "y").groupBy(F.col("x").alias("node"), "c").agg(F.sum("w").alias("win"))
        own = state.select("node", "c").withColumn("win", F.lit(0.0))
        options = near.unionByName(own).groupBy("node", "c").agg(F.sum("win").alias("win")).join(total, "c").join(state.select("node", "k", F.col("c").alias("now")), "node")
        gain = F.col("win") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)) / m2
        best = options.withColumn("gain", F.round(gain, 9)).groupBy("node", "k", "now").agg(F.max_by("c", F.struct("gain", -F.col("c"))).alias("best"), F.max("gain").alias("top"), F.max(F.when(F.col("c") == F.col("now"), F.col("gain"))).alias("stay"))
        moves = (F.pmod(F.xxhash64("node", F.lit(i // 2)), F.lit(2)) == i % 2) & (F.col("top") > F.col("stay"))
        new = stage(best.select("node", "k", F.when(moves, F.col("best")).otherwise(F.col("now")).alias("c"), moves.alias("moved")), "moves")
        release(held)
        state, held = new.select("node", "k", "c"), new
        before, still = still, new.where("moved").isEmpty()
        if i % 2 and before and still:
            break
    names = state.groupBy("c").agg(F.min("node").alias("community"))
    return state.join(names, "c").select("node", "community")


def modularity(graph: DataFrame, parts: DataFrame) -> float:
    """Modularity of a partition of a weighted graph."""
    a = graph.join(parts.select(F.col("node").alias("x"), F.col("community").alias("cx")), "x").join(parts.select(F.col("node").alias("y"), F.col("community").alias("cy")), "y")
    m = graph.agg(F.sum("w")).first()[0] or 1.0
    inside = a.where("cx = cy").agg(F.sum("w")).first()[0] or 0.0
    ends = a.select(F.col("cx").alias("c"), "w").unionAll(a.select("cy", "w")).groupBy("c").agg(F.sum("w").alias("k"))
    return inside / m - (ends.agg(F.sum(F.pow(F.col("k") / (2 * m), 2))).first()[0] or 0.0)


def label_terms(members: DataFrame, group: str, top: int = 3) -> DataFrame:
    """(group, terms): the ``top`` admissible name tokens by f / n ln(1 + K / df), ties alphabetical."""
    tok = members.select(group, "repo", "path", "class_name").dropDuplicates([group, "repo", "path"]).select(group, F.explode(ident_tokens(F.coalesce("class_name", F.lit("")))).alias("term")).where(admissible(F.col("term")))
    tf = tok.groupBy(group, "term").agg(F.count("*").alias("f"))
    k = members.agg(F.countDistinct(group)).first()[0]
    n, df = tf.groupBy(group).agg(F.sum("f").alias("n")), tf.groupBy("term").agg(F.count("*").alias("df"))
    s = tf.join(n, group).join(df, "term").withColumn("score", F.round(F.col("f") / F.col("n") * F.log1p(F.lit(k) / F.greatest("df", F.lit(1))), 9))
    best = s.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "term"))).where(F.col("r") <= top)
    return best.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x.term).alias("terms"))


def majority_dirs(members: DataFrame, group: str, least: float = 0.55) -> DataFrame:
    """(group, seed, share): the folder seed that at least ``least`` of the members share."""
    m = members.select(group, "repo", "path").distinct().withColumn("seed", dir_seed(F.col("path")))
    n = m.groupBy(group).agg(F.count("*").alias("n"))
    per = m.where("seed is not null").groupBy(group, "seed").agg(F.count("*").alias("c")).join(n, group)
    return per.where(F.col("c") >= F.lit(least) * F.col("n")).select(group, "seed", F.round(F.col("c") / F.col("n"), 4).alias("share"))


def stem_prefixes(members: DataFrame, group: str) -> DataFrame:
    """(group, seg): of clusters of packed scenes the part that tells them apart: of the stems ``Pfx_Seg...`` of its scenes at least
    60 % have one prefix, and of those 55 % one first hump after it, which isn't the prefix."""
    m = members.select(group, "repo", "path").distinct().where(F.col("path").endswith(".tscn")).withColumn("stem", stem(F.col("path")))
    n = m.groupBy(group).agg(F.count("*").alias("n"))
    second = F.split_part("stem", F.lit("_"), F.lit(2))
    hump = F.coalesce(F.nullif(F.regexp_extract(second, "([A-Z][a-z]*)", 1), F.lit("")), second)
    c = m.where(second != "").select(group, F.lower(F.split_part("stem", F.lit("_"), F.lit(1))).alias("pfx"), F.lower(hump).alias("seg"))

    def top(rows: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(group).orderBy(F.desc("k"), name)
        return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")

    pfx = top(c.groupBy(group, "pfx").agg(F.count("*").alias("k")), "pfx").join(n, group).where("k >= 0.6 * n").select(group, "pfx", F.col("k").alias("pn"))
    seg = top(c.join(pfx, [group, "pfx"]).groupBy(group, "pfx", "pn", "seg").agg(F.count("*").alias("k")), "seg")
    return seg.where("k >= 0.55 * pn and seg <> pfx").select(group, "seg")


def deepest_dirs(members: DataFrame, group: str, least: float = 0.55) -> DataFrame:
    """(group, chain): the longest chain of folders, those without a meaning of their own left out, that ``least`` of the members share."""
    m = members.select(group, "repo", "path").distinct()
    n = m.groupBy(group).agg(F.count("*").alias("n"))
    chain = m.withColumn("c", seed_chain(F.col("path"))).where(F.size("c") > 0)
    every = chain.select(group, F.explode(F.transform(F.sequence(F.lit(1), F.size("c")), lambda k: F.slice("c", 1, k))).alias("chain"))
    per = every.groupBy(group, "chain").agg(F.count("*").alias("k")).join(n, group).where(F.col("k") >= F.lit(least) * F.col("n"))
    return per.groupBy(group).agg(F.max_by("chain", F.size("chain")).alias("chain"))


def cluster_labels(members: DataFrame, group: str) -> DataFrame:
    """(group, label, confidence, rule): the first that holds of: the segment of a pack of scenes (0.7), the deepest folder that 55 % share
    (0.85), a scene stem that half have (0.8), the most characteristic terms (0.6), the first class name (0.35), Mixed (0.2).

    The rules on scenes ask that more than half of the files are scenes.
    """
    m = members.select(group, "repo", "path", "class_name").groupBy(group, "repo", "path").agg(F.min(F.nullif("class_name", F.lit(""))).alias("class_name"))
    scene = F.col("path").endswith(".tscn")
    every = m.groupBy(group).agg(F.count("*").alias("n"), F.count_if(scene).alias("scenes"), F.min_by("class_name", F.when(F.col("class_name").isNotNull(), F.struct("path", "repo"))).alias("cls"))
    stems = m.where(scene).groupBy(group, stem(F.col("path")).alias("st")).agg(F.count("*").alias("k"))
    stems = stems.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("k"), "st"))).where("r = 1").select(group, "st", "k")
    got = every.join(stem_prefixes(members, group), group, "left").join(deepest_dirs(members, group), group, "left").join(stems, group, "left").join(label_terms(members, group), group, "left")
    many = F.col("scenes") * 2 > F.col("n")
    pack, half = many & F.col("seg").isNotNull(), many & (F.col("k") >= 0.5 * F.col("n"))
    rules = [
        (pack, titleize(F.col("seg")), 0.7, "stem"), (F.col("chain").isNotNull(), titleize(F.element_at("chain", -1)), 0.85, "dir"), (half, titleize(F.col("st")), 0.8, "scene"),
        (F.col("terms").isNotNull(), F.array_join("terms", " - "), 0.6, "tfidf"), (F.col("cls").isNotNull(), titleize(F.col("cls")), 0.35, "class"),
        (F.lit(True), F.concat(F.lit("Mixed ("), F.col("n").cast("string"), F.lit(")")), 0.2, "mixed"),
    ]
    label, conf, rule = None, None, None
    for ok, text, c, name in rules:
        ok = F.coalesce(ok, F.lit(False))
        label, conf, rule = (F.when(ok, v) if w is None else w.when(ok, v) for w, v in ((label, text), (conf, F.lit(c)), (rule, F.lit(name))))
    return got.select(group, label.alias("label"), conf.alias("confidence"), rule.alias("rule"))


def one_cluster_each(members: DataFrame, group: str) -> DataFrame:
    """(repo, path, group): every file in exactly one cluster, the larger one, then the lower id."""
    m = members.select(group, "repo", "path").distinct()
    size = m.groupBy(group).agg(F.count("*").alias("size"))
    return m.join(size, group).groupBy("repo", "path").agg(F.max_by(group, F.struct("size", -F.col(group))).alias(group))


def match_clusters(refs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(ref, id, error) of references (ref) to clusters (id, label): ``cN``, the exact label, or a label unique but for case.

    References are stated by the caller, a handful beside any number of clusters.
    """
    lab = clusters.groupBy(F.lower("label").alias("low")).agg(F.count("*").alias("n"), F.min("id").alias("any"))
    exact = clusters.groupBy("label").agg(F.min("id").alias("same"))
    r = refs.select("ref").distinct().withColumn("num", F.regexp_extract("ref", "^c([0-9]+)$", 1)).withColumn("low", F.lower("ref"))
    got = r.join(clusters.select(F.col("id").cast("string").alias("num"), F.col("id").alias("byid")).distinct(), "num", "left")
    got = got.join(exact, F.col("ref") == F.col("label"), "left").join(lab, "low", "left")
    found = F.coalesce("byid", "same", F.when(F.col("n") == 1, F.col("any")))
    return got.select("ref", found.alias("id"), F.when(found.isNotNull(), None).when(F.col("n") > 1, "ambiguous").otherwise("unknown").alias("error"))
