"""Edges from code: call sites resolved against the declarations of a corpus, scenes against their scripts.

Everything is a relation over (repo, path): declarations, classes and their ancestors, call sites read
from bodies, candidates of each site by rule, and of those the first by rule, distance and path. The
cascade is a union of equi-joins and one minimum per site, so no rule gathers a corpus anywhere.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import code_only, file_ext, stem
from quillgraph.operators.references import reference_target
from quillgraph.session import stage

#: A call with up to two receivers before it; words that look like calls and are none; words for the own object.
CALL = r"(?:([A-Za-z_]\w*)(?:\.|->|::))?(?:([A-Za-z_]\w*)(?:\.|->|::))?([A-Za-z_]\w*)\s*\("
NO_CALLS = tuple("if for while switch catch return function func fn def elif match sizeof typeof foreach and or not in else new throw await print super this self class".split())
OWN = ("self", "this", "cls", "super", "Self", "base", "parent")
#: Names that run without a call, by suffix, and names whose liveness can't be disproved.
ENTRIES = {
    ".py": r"^__\w+__$|^test_",
    ".gd": r"^_(ready|process|physics_process|init|enter_tree|exit_tree|input|unhandled_input|unhandled_key_input|gui_input|draw|notification|get|set|to_string|get_property_list)$|^(test_|before_each$|after_each$|before_all$|after_all$)",
    ".go": r"^(main|init)$|^(Test|Benchmark|Example|Fuzz)",
    ".rs": r"^main$|^test_",
    ".java": r"^main$|^test",
    ".cs": r"^Main$|^Test|^(Awake|Start|Update|FixedUpdate|LateUpdate|OnEnable|OnDisable|OnDestroy)$",
    ".c": r"^main$",
    ".cpp": r"^main$",
    ".php": r"^test",
    ".js": r"^(main|default)$|^test",
    ".mjs": r"^(main|default)$|^test",
    ".ts": r"^(main|default)$|^test",
    ".tsx": r"^(main|default)$|^test|^[A-Z]",
    ".lua": r"^main$|^test",
}
EXEMPT = {".go": r"^(init|String|Error)$", ".java": r"^(toString|equals|hashCode|clone|finalize|compareTo|run|close)$", ".php": r"^__\w+$", ".cpp": r"^(~|operator)"}
#: What in the bodies of a file hints at calls by computed names.
DYNAMIC = {
    ".gd": r"\.call\(|\.call_deferred|Callable\(|has_method\(|\.connect\(|\.rpc\(|\.emit\(",
    ".py": r"\b(getattr|setattr|eval|exec)\s*\(|\b(globals|locals)\s*\(\)|__getattr__",
    ".go": r"\breflect\.",
    ".java": r"\b(Override|FunctionalInterface)\b",
    ".cs": r"\.GetType\s*\(\s*\)|\.GetMethod\s*\(|\.Invoke\s*\(|Activator\.CreateInstance|Delegate\.CreateDelegate",
    ".js": r"\beval\(|\bnew\s+Function\(",
    ".ts": r"\bReflect\.|\bProxy\(|\beval\(",
    ".rs": r"\bdyn\b",
    ".php": r"function\s+__(call|callStatic)\s*\(",
    ".lua": r"\b(load|loadstring)\s*\(|\bdofile\s|\b_G\.",
}
#: Suffixes with a mention floor, the floor, and suffixes where an underscore name under an unknown base is for review.
FLOORED, FLOOR = (".cpp", ".c", ".ts", ".tsx", ".js", ".mjs", ".rs", ".go", ".java", ".cs", ".php", ".lua"), 2
BASE_REVIEW = (".gd", ".py", ".cpp", ".js", ".mjs", ".rs", ".lua")
#: Nodes and names that the symbol view shows.
VIEW_NODES, VIEW_NAMES = 13, 8


def _by_ext(patterns: dict[str, str], ext: Column, text: Column) -> Column:
    out = None
    for e, p in patterns.items():
        out = F.when(ext == e, text.rlike(p)) if out is None else out.when(ext == e, text.rlike(p))
    return F.coalesce(out, F.lit(False))


def declarations(functions: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, ext, name, line, key, code, params) of the named functions of live files; same-named ones of a file are one,
    its line the first. ``code`` is the body without literals and line comments."""
    live = files.select("repo", "path").distinct()
    f = functions.where("repo is not null and path is not null and name is not null").join(live, ["repo", "path"], "left_semi")
    ext = file_ext(F.col("path"))
    one = f.groupBy("repo", "path", "name").agg(F.min("line").alias("line"), F.min_by("body", F.struct("line", "func_id")).alias("body"), F.min_by("params", F.struct("line", "func_id")).alias("params"))
    key = F.concat_ws("::", F.concat_ws("|", "repo", "path"), "name")
    return one.select("repo", "path", ext.alias("ext"), "name", "line", key.alias("key"), code_only(F.coalesce("body", F.lit("")), ext).alias("code"), "params")


def class_map(files: DataFrame) -> DataFrame:
    """(repo, class_name, loc): the first path that declares each class."""
    return files.where("class_name <> ''").groupBy("repo", "class_name").agg(F.min("path").alias("loc"))


def lineage(files: DataFrame) -> DataFrame:
    """(repo, path, up, depth): every file above each file by ``extends`` (a class or a path), at its least distance; cycles end."""
    base = files.select("repo", "path", reference_target(F.col("extends")).alias("t")).where("t is not null")
    known = files.select("repo", F.col("path").alias("up")).distinct()
    by_class = base.join(class_map(files).withColumnRenamed("class_name", "t"), ["repo", "t"]).select("repo", "path", F.col("loc").alias("up"))
    by_path = base.withColumnRenamed("t", "up").join(known, ["repo", "up"]).select("repo", "path", "up")
    step = stage(by_class.unionByName(by_path).where("path <> up").distinct(), "extends")
    seen = frontier = step.withColumn("depth", F.lit(1))
    for depth in count(2):
        new = frontier.select("repo", "path", F.col("up").alias("mid")).join(step.select("repo", F.col("path").alias("mid"), "up"), ["repo", "mid"]).select("repo", "path", "up").distinct()
        frontier = stage(new.join(seen, ["repo", "path", "up"], "left_anti").withColumn("depth", F.lit(depth)), "extends")
        if frontier.isEmpty():
            return seen
        seen = seen.unionAll(frontier)


def call_sites(decl: DataFrame) -> DataFrame:
    """(repo, path, name, key, head, recv, callee): distinct calls of each function, ``head.recv.callee(``; empty where there is none."""
    each = decl.select("repo", "path", "name", "key", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(CALL), F.lit(0)))).alias("m"))
    g = [F.regexp_extract("m", CALL, k) for k in (1, 2, 3)]
    two = g[1] != ""
    out = each.select("repo", "path", "name", "key", F.when(two, g[0]).otherwise("").alias("head"), F.when(two, g[1]).otherwise(g[0]).alias("recv"), g[2].alias("callee"))
    return out.where(~F.col("callee").isin(*NO_CALLS)).distinct()


def resolve_calls(decl: DataFrame, files: DataFrame, up: DataFrame, sites: DataFrame) -> DataFrame:
    """(repo, key, head, recv, callee, loc, rule, depth): where each call lands, null where nothing declares it.

    Rules, first hit wins: 1 the own file, 2 the nearest ancestor (bare or on the own object); 3 a class named as receiver,
    5 the class of a parameter, 6 of a member, 7 of a member of a class, typed parameter or the own object, each in its file or
    (one more) its nearest ancestor; 10 an imported module of that file name; 11 the only file of the repository that declares
    the name (bare calls). Equal distances go to the first path.
    """
    has = decl.select("repo", F.col("path").alias("loc"), F.col("name").alias("callee")).distinct()
    cls = class_map(files)
    site = ["repo", "path", "key", "head", "recv", "callee"]
    s = sites.select(*site, "name")
    mine = (F.col("recv") == "") | F.col("recv").isin(*OWN) & (F.col("head") == "")
    own = s.where(mine & (F.col("recv") != "super")).select(*site, F.col("path").alias("to"), F.lit(1).alias("rule"), F.lit(0).alias("dist"))
    above = s.where(mine).join(up, ["repo", "path"]).select(*site, F.col("up").alias("to"), F.lit(2).alias("rule"), F.col("depth").alias("dist"))
    params = decl.select("repo", "path", "name", F.explode("params").alias("p")).select("repo", "path", "name", F.col("p.name").alias("var"), F.col("p.type").alias("class_name")).where("class_name <> '' and var <> ''")
    members = files.select("repo", "path", F.explode(F.map_entries("members")).alias("m")).select("repo", "path", F.col("m.key").alias("var"), F.col("m.value").alias("class_name")).where("class_name <> ''").distinct()
    typed = lambda rows: rows.join(cls, ["repo", "class_name"]).drop("class_name")
    params, members = typed(params), typed(members)
    one = s.where((F.col("head") == "") & (F.col("recv") != ""))
    named = one.join(cls.select("repo", F.col("class_name").alias("recv"), "loc"), ["repo", "recv"]).select(*site, F.col("loc").alias("to"), F.lit(3).alias("rule"))
    by_param = one.join(params.withColumnRenamed("var", "recv"), ["repo", "path", "name", "recv"]).select(*site, F.col("loc").alias("to"), F.lit(5).alias("rule"))
    by_member = s.where((F.col("head") == "") | F.col("head").isin(*OWN)).join(members.withColumnRenamed("var", "recv"), ["repo", "path", "recv"]).select(*site, F.col("loc").alias("to"), F.lit(6).alias("rule"))
    chain = s.where("head <> ''")
    heads = chain.join(cls.select("repo", F.col("class_name").alias("head"), F.col("loc").alias("mid")), ["repo", "head"]).select(*site, "mid").unionByName(
        chain.join(params.select("repo", "path", "name", F.col("var").alias("head"), F.col("loc").alias("mid")), ["repo", "path", "name", "head"]).select(*site, "mid")
    )
    by_chain = heads.join(members.select("repo", F.col("path").alias("mid"), F.col("var").alias("recv"), "loc"), ["repo", "mid", "recv"]).select(*site, F.col("loc").alias("to"), F.lit(7).alias("rule"))
    receivers = named.unionByName(by_param).unionByName(by_member).unionByName(by_chain).distinct()
    direct = receivers.withColumn("dist", F.lit(0))
    inherited = receivers.join(up.select("repo", F.col("path").alias("to"), "up", "depth"), ["repo", "to"]).select(*site, F.col("up").alias("to"), "rule", F.col("depth").alias("dist"))
    modules = files.select("repo", "path", F.explode("imported_modules").alias("module")).where("module <> ''").distinct().join(files.select("repo", F.col("path").alias("to"), stem(F.col("path")).alias("module")).distinct(), ["repo", "module"])
    imported = s.where("head = ''").join(modules, ["repo", "path"]).where("recv = '' or recv = module").select(*site, "to", F.lit(10).alias("rule"), F.lit(0).alias("dist"))
    only = has.groupBy("repo", "callee").agg(F.min("loc").alias("to"), F.count("*").alias("n")).where("n = 1").drop("n")
    lone = s.where("recv = ''").join(only, ["repo", "callee"]).select(*site, "to", F.lit(11).alias("rule"), F.lit(0).alias("dist"))
    every = own.unionByName(above).unionByName(direct).unionByName(inherited).unionByName(imported).unionByName(lone)
    lands = every.join(has.withColumnRenamed("loc", "to"), ["repo", "to", "callee"], "left_semi")
    best = lands.groupBy(*site).agg(F.min(F.struct("rule", "dist", "to")).alias("b"))
    return sites.select(*site).join(best, site, "left").select("repo", "path", "key", "head", "recv", "callee", F.col("b.to").alias("loc"), F.col("b.rule").alias("rule"), F.col("b.dist").alias("depth"))


def _node(repo: Column, path: Column, name: Column) -> Column:
    return F.concat_ws("::", F.concat_ws("|", repo, path), name)


def call_edges(calls: DataFrame, decl: DataFrame, up: DataFrame) -> DataFrame:
    """(src_key, dst_key, type): resolved calls, and for each the overrides below where it lands (a call may reach any of them)."""
    hit = calls.where("loc is not null").select("repo", F.col("key").alias("src_key"), "loc", "callee").distinct()
    below = hit.join(up.select("repo", F.col("up").alias("loc"), F.col("path").alias("sub")), ["repo", "loc"]).select("repo", "src_key", F.col("sub").alias("loc"), "callee")
    below = below.join(decl.select("repo", F.col("path").alias("loc"), F.col("name").alias("callee")), ["repo", "loc", "callee"], "left_semi")
    both = hit.unionByName(below).select("src_key", _node(F.col("repo"), F.col("loc"), F.col("callee")).alias("dst_key"))
    return both.where("src_key <> dst_key").distinct().withColumn("type", F.lit("call"))


def scene_scripts(files: DataFrame) -> DataFrame:
    """(repo, scene, ord, script): the known scripts of a scene in file order; the attached one only where none of them is known."""
    known = files.select("repo", F.col("path").alias("script")).distinct()
    bare = lambda c: F.regexp_replace(F.trim(c), "^res://", "")
    listed = files.select("repo", F.col("path").alias("scene"), F.posexplode("scripts").alias("ord", "raw")).select("repo", "scene", "ord", bare(F.col("raw")).alias("script")).where("script <> ''")
    listed = listed.join(known, ["repo", "script"], "left_semi").groupBy("repo", "scene", "script").agg(F.min("ord").alias("ord"))
    other = files.select("repo", F.col("path").alias("scene"), F.lit(0).alias("ord"), bare(F.col("attached_script")).alias("script")).where("script <> ''").join(known, ["repo", "script"], "left_semi")
    other = other.join(listed.select("repo", "scene").distinct(), ["repo", "scene"], "left_anti")
    return listed.select("repo", "scene", "ord", "script").unionByName(other.select("repo", "scene", "ord", "script").distinct())


def scene_edges(files: DataFrame, decl: DataFrame, scripts: DataFrame) -> DataFrame:
    """(src_key, dst_key, type): scenes to their scripts (attach), to scenes in them (inst) and to the handlers of their connections (signal)."""
    scene = F.lit("tscn")
    attach = scripts.select(_node(F.col("repo"), F.col("scene"), scene).alias("src_key"), F.concat_ws("|", "repo", "script").alias("dst_key"), F.lit("attach").alias("type"))
    inst = files.select("repo", "path", F.explode("instances").alias("raw")).select("repo", "path", F.regexp_replace(F.trim("raw"), "^res://", "").alias("to")).where("to <> '' and to <> path")
    inst = inst.join(files.select("repo", F.col("path").alias("to")).distinct(), ["repo", "to"], "left_semi").select(_node(F.col("repo"), F.col("path"), scene), _node(F.col("repo"), F.col("to"), scene), F.lit("inst"))
    signal = signal_handlers(files, decl, scripts).where("script is not null").select(_node(F.col("repo"), F.col("scene"), scene), _node(F.col("repo"), F.col("script"), F.col("method")), F.lit("signal"))
    return attach.unionAll(inst).unionAll(signal).distinct()


def signal_handlers(files: DataFrame, decl: DataFrame, scripts: DataFrame) -> DataFrame:
    """(repo, scene, signal, method, script): a row for each script of the scene that declares the method, or one with null."""
    c = files.select("repo", F.col("path").alias("scene"), F.explode("connections").alias("c")).select("repo", "scene", F.col("c.signal").alias("signal"), F.col("c.method").alias("method")).where("method <> ''").distinct()
    found = c.join(scripts.select("repo", "scene", "script"), ["repo", "scene"]).join(decl.select("repo", F.col("path").alias("script"), F.col("name").alias("method")), ["repo", "script", "method"], "left_semi")
    return c.join(found, ["repo", "scene", "signal", "method"], "left").select("repo", "scene", "signal", "method", "script")


def entry_keys(decl: DataFrame, files: DataFrame, calls: DataFrame, handlers: DataFrame) -> DataFrame:
    """(key): names that run by themselves, functions of tool scripts, handlers, and names called on receivers that nothing is known of."""
    by_name = decl.where(_by_ext(ENTRIES, F.col("ext"), F.col("name")) | F.col("path").startswith("tests/") & F.col("name").startswith("test_")).select("key")
    tools = decl.join(files.where("is_tool").select("repo", "path").distinct(), ["repo", "path"], "left_semi").select("key")
    heard = handlers.where("script is not null").select(_node(F.col("repo"), F.col("script"), F.col("method")).alias("key"))
    loose = calls.where("loc is null and recv <> ''").select("repo", F.col("callee").alias("name")).distinct()
    return by_name.unionAll(tools).unionAll(heard).unionAll(decl.join(loose, ["repo", "name"], "left_semi").select("key")).distinct()


def argument_names(decl: DataFrame) -> DataFrame:
    """(repo, class_name): capitalised names that are handed over as arguments."""
    return decl.select("repo", F.explode(F.regexp_extract_all("code", F.lit(r"[(,]\s*([A-Z]\w*)\s*[,)]"), F.lit(1))).alias("class_name")).distinct()


def dead_functions(decl: DataFrame, files: DataFrame, alive: DataFrame, mentions: DataFrame) -> DataFrame:
    """(repo, path, name, line, tier) of functions that nothing reaches and that aren't exempt.

    Tier ``likely``, or ``review`` where the file calls by computed names, the base class is unknown and the name is one that a
    framework may call, the class is handed over as a value, or texts mention the name twice or more.
    """
    ext = F.col("ext")
    dynamic = decl.groupBy("repo", "path").agg(F.bool_or(_by_ext(DYNAMIC, ext, F.col("code"))).alias("dynamic"))
    head = files.select("repo", "path", "class_name", reference_target(F.col("extends")).alias("base")).groupBy("repo", "path").agg(F.min("class_name").alias("class_name"), F.min("base").alias("base"))
    known = class_map(files).select("repo", F.col("class_name").alias("base"), F.lit(True).alias("known"))
    given = argument_names(decl).withColumn("given", F.lit(True))
    left = decl.join(alive.select("key"), "key", "left_anti").where(~_by_ext(EXEMPT, ext, F.col("name")))
    left = left.join(dynamic, ["repo", "path"], "left").join(head, ["repo", "path"], "left").join(known, ["repo", "base"], "left").join(given, ["repo", "class_name"], "left")
    left = left.join(mentions.select(F.col("token").alias("name"), "n"), "name", "left")
    unknown = (F.col("base") != "") & F.col("known").isNull() & ext.isin(*BASE_REVIEW) & F.col("name").startswith("_")
    stand_in = (ext == ".py") & F.col("given")
    said = ext.isin(*FLOORED) & (F.col("n") >= FLOOR)
    review = F.coalesce(F.col("dynamic"), F.lit(False)) | F.coalesce(unknown, F.lit(False)) | F.coalesce(stand_in, F.lit(False)) | F.coalesce(said, F.lit(False))
    return left.select("repo", "path", "name", "line", F.when(review, "review").otherwise("likely").alias("tier"))


def dead_view(dead: DataFrame, n: int = 100) -> DataFrame:
    """(tier, repo, path, name, line, shown, total): the first ``n`` (1 to 100) rows, likely ones first, with how many of each tier are shown and there are."""
    total = dead.groupBy("tier").agg(F.count("*").alias("total"))
    first = dead.orderBy("tier", "repo", "path", "line", "name").limit(min(100, max(1, n)))
    shown = first.groupBy("tier").agg(F.count("*").alias("shown"))
    return first.join(F.broadcast(shown.join(total, "tier")), "tier").select("tier", "repo", "path", "name", "line", "shown", "total")


def resolve_symbol(decl: DataFrame, classes: DataFrame, symbol: str, top: int = 10) -> DataFrame:
    """(key): functions of that name and all functions of a class of that name; if there are none, names that contain it in any case.

    The first ``top`` in the order of repository, path and line.
    """
    exact = decl.join(F.broadcast(classes.where(F.col("class_name") == symbol).select("repo", F.col("loc").alias("path"), F.lit(True).alias("c"))), ["repo", "path"], "left")
    rank = F.when((F.col("name") == symbol) | F.col("c"), 0).when(F.lower("name").contains(symbol.lower()), 1)
    hits = exact.withColumn("rank", rank).where("rank is not null")
    best = hits.agg(F.min("rank").alias("rank"))
    return hits.join(F.broadcast(best), "rank").orderBy("repo", "path", "line", "name").limit(top).select("key")


def symbol_view(edges: DataFrame, seeds: DataFrame, depth: int = 1, nodes: int = VIEW_NODES, names: int = VIEW_NAMES) -> DataFrame:
    """(hop, key, callers, n_callers, callees, n_callees, n_nodes): the symbols within ``depth`` - 1 (1 to 3 hops) of the seeds both ways, by hop and key.

    Scenes are named but not walked. The first ``nodes`` are shown, each with its first ``names`` neighbours; counts are the true ones.
    """
    both = edges.select(F.col("src_key").alias("a"), F.col("dst_key").alias("b"))
    step = both.unionAll(both.select("b", "a")).where("not endswith(b, '::tscn')").distinct()
    seen = frontier = seeds.select("key").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, min(3, max(1, depth))):
        new = step.join(frontier.select(F.col("key").alias("a")), "a").select(F.col("b").alias("key")).distinct().join(seen.select("key"), "key", "left_anti")
        frontier = stage(new.withColumn("hop", F.lit(hop)), "symbol-view")
        seen = seen.unionAll(frontier)
    shown = seen.orderBy("hop", "key").limit(nodes)
    e = edges.select("src_key", "dst_key").distinct()

    def row(own: str, other: str, name: str) -> DataFrame:
        near = e.join(shown.select(F.col("key").alias(own)), own)
        n = near.groupBy(own).agg(F.count("*").alias(f"n_{name}"))
        first = near.withColumn("r", F.row_number().over(Window.partitionBy(own).orderBy(other))).where(F.col("r") <= names)
        return first.groupBy(own).agg(F.array_sort(F.collect_list(other)).alias(name)).join(n, own).withColumnRenamed(own, "key")

    total = seen.agg(F.count("*").alias("n_nodes")).withColumn("one", F.lit(1))
    out = shown.join(row("dst_key", "src_key", "callers"), "key", "left").join(row("src_key", "dst_key", "callees"), "key", "left")
    out = out.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    none, zero = F.array().cast("array<string>"), F.lit(0)
    return out.select("hop", "key", F.coalesce("callers", none).alias("callers"), F.coalesce("n_callers", zero).alias("n_callers"), F.coalesce("callees", none).alias("callees"), F.coalesce("n_callees", zero).alias("n_callees"), "n_nodes")
