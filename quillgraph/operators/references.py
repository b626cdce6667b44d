"""Problem 3: references to records that do not exist at the time they are made.

References are reduced to distinct non-null keys first; only keys that some parent has go on to the
decision in time, and a left anti-join against the keys that are alive at their time, back on all
references, gives the orphans. In time: a key is alive at t if some parent row begins at or
before t and ends after it, which holds exactly if the latest end among the parents that begin at or
before t lies after t. That running maximum is kept per day, and one value per key and day is
carried into the next days, so the rows of one hot key are sorted in as many pieces as it has days and
pre-aggregation bounds what is shuffled. References and spans are read from the files once each and
kept as tables, as several steps need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import stage

FIELDS = ("extends", "instances", "attached_script")
FOREVER = "9999-12-31"


def reference_target(raw: Column) -> Column:
    """What a written reference points at: blanks and double quotes around it and a leading ``res://``
    are dropped; with a ``/`` left it is a path, otherwise a class name, of which type arguments and
    qualifiers are dropped. Null, empty and blank give null."""
    bare = F.regexp_replace(F.regexp_replace(raw, r'^[\s"]+|[\s"]+$', ""), "^res://", "")
    name = F.regexp_replace(F.regexp_replace(bare, r"(?s)[<\[].*$", ""), r"(?s)^.*\.", "")
    return F.nullif(F.when(bare.contains("/"), bare).otherwise(F.trim(name)), F.lit(""))


def references(files: DataFrame) -> DataFrame:
    """(file_id, repo, field, kind, target, at), one row per reference that is one; kind: path or class.

    Null and empty fields, arrays and elements give no rows; repeated elements and rows count once.
    """
    item = lambda f, raw: F.struct(F.lit(f).alias("field"), raw.alias("raw"))
    many = F.transform(F.coalesce("instances", F.array().cast("array<string>")), lambda x: item("instances", x))
    rows = files.select("file_id", "repo", F.explode(F.concat(F.array(item("extends", F.col("extends")), item("attached_script", F.col("attached_script"))), many)).alias("r"), F.col("indexed_at").alias("at"))
    rows = rows.select("file_id", "repo", "r.field", "r.raw", "at")
    return (
        rows.withColumn("target", reference_target(F.col("raw")))
        .where("target is not null")
        .select("file_id", "repo", "field", F.when(F.col("target").contains("/"), "path").otherwise("class").alias("kind"), "target", "at")
        .distinct()
    )


def parent_spans(files: DataFrame) -> DataFrame:
    """(repo, kind, target, lo, hi): when a key had a row; null ends are open."""
    keys = F.explode(F.array(
        F.struct(F.lit("path").alias("kind"), F.col("path").alias("target")),
        F.struct(F.lit("class").alias("kind"), F.col("class_name").alias("target")),
    ))
    return (
        files.where("indexed_at is not null")
        .select("repo", keys.alias("k"), F.col("indexed_at").alias("lo"), F.coalesce("removed_at", F.lit(FOREVER).cast("timestamp")).alias("hi"))
        .select("repo", "k.kind", "k.target", "lo", "hi")
        .where("target is not null and target <> ''")
        .groupBy("repo", "kind", "target", "lo")
        .agg(F.max("hi").alias("hi"))
    )


def orphan_references(files: DataFrame, base_types: DataFrame) -> DataFrame:
    """(file_id, field, target, at) of every reference without a live target when it was made.

    A class in ``base_types`` (any language) is no reference in ``extends``. A reference without a
    time has no live target. Null repositories match no parent. Empty tables: without parents every
    reference is an orphan; without files there are no rows. Other columns are ignored.
    """
    return orphans(_real_references(files, base_types), files)


def _real_references(files: DataFrame, base_types: DataFrame) -> DataFrame:
    """``references`` without built-in classes in ``extends``, as a table."""
    builtin = base_types.select(F.col("type_name").alias("target"), F.lit("extends").alias("field"), F.lit("class").alias("kind")).where("target is not null").distinct()
    return stage(references(files).join(builtin, ["target", "field", "kind"], "left_anti"), "references")


def orphans(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, field, target, at) of the references (file_id, repo, field, kind, target, at) without a live target."""
    key = ["repo", "kind", "target"]
    spans = parent_spans(files)
    had = refs.select(*key).distinct()
    spans = stage(spans.join(had, key, "left_semi"), "spans")
    day = F.to_date("at")
    spans_d = spans.withColumnRenamed("lo", "at").withColumn("day", day)
    asked = refs.select(*key, "at").where("at is not null").distinct().join(spans.select(*key).distinct(), key, "left_semi").withColumn("day", day)
    per_day = spans_d.groupBy(*key, "day").agg(F.max("hi").alias("day_hi")).unionByName(
        asked.select(*key, "day").distinct().withColumn("day_hi", F.lit(None).cast("timestamp"))
    ).groupBy(*key, "day").agg(F.max("day_hi").alias("day_hi"))
    earlier = Window.partitionBy(*key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_day.withColumn("carried", F.max("day_hi").over(earlier)).where("carried is not null").select(*key, "day", "carried")
    events = spans_d.select(*key, "day", "at", "hi", F.lit(0).alias("ask")).unionByName(
        asked.select(*key, "day", "at", F.lit(None).cast("timestamp").alias("hi"), F.lit(1).alias("ask"))
    )
    so_far = Window.partitionBy(*key, "day").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = events.withColumn("reach", F.max("hi").over(so_far)).where("ask = 1").select(*key, "day", "at", "reach")
    alive = (
        inside.join(carried, [*key, "day"], "left")
        .where(F.greatest("reach", "carried") > F.col("at"))
        .select(*key, "at")
    )
    return refs.join(alive, [*key, "at"], "left_anti").select("file_id", "field", "target", "at")


def orphan_report(files: DataFrame, base_types: DataFrame) -> DataFrame:
    """(field, month, n_refs, n_orphans) by field and month of ``indexed_at``; every reference counts once."""
    refs = _real_references(files, base_types)
    month = F.date_format("at", "yyyy-MM").alias("month")
    all_ = refs.groupBy("field", month).agg(F.count("*").alias("n_refs"))
    bad = orphans(refs, files).groupBy("field", month).agg(F.count("*").alias("n_orphans"))
    return (
        all_.join(bad.withColumnsRenamed({"field": "bf", "month": "bm"}), (F.col("field") == F.col("bf")) & F.col("month").eqNullSafe(F.col("bm")), "left")
        .select("field", "month", "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))
    )
