"""Mixing sources to target weights with hash-threshold histograms.

DataFrame functions only: no Python in tasks, no sort of documents, no join by source
that moves texts.

1. Sizes (words) are counted once and kept with a 36-bit hash of id and text, without texts.
2. Source totals give the targets: shares by weight, capped at ``MAX_REPEATS`` times the
   source and the excess reshared until no source is above its cap.
3. A target is a number of whole copies and a rest.  For the rest, sizes are summed by
   source and hash bucket; where the running sum passes the rest lies the boundary
   bucket, and only its documents are summed again by the next 12 bits, three times.
   Documents below the threshold, which holds for the source's whole life in every
   rerun and nests for growing budgets, give one copy more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .keys import split_by_slot

MAX_REPEATS = 3
DIGITS = 3  # hex digits of the hash that a refinement adds: 4096 buckets
LEVELS = 3
WEIGHTS = (1.0, 2.0, 3.0)
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: str, text: str) -> Column:
    """What tells a row from others for the hash: its id and its text."""
    own = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(own))


def place_of(key: Column, copy: Column) -> Column:
    """The hash of a row as hex text, so that prefixes are buckets and order is the order of text."""
    return F.substring(F.md5(F.concat(key, F.lit(":"), copy.cast("string")).cast("binary")), 1, DIGITS * LEVELS)


def _places(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (with ``source`` and ``key``) that share both with no other and have their ``place``, and the others with theirs.

    Of rows that share source and key each gets a number of its own, so they are taken
    apart: they are counted by task, and numbered from the sum of the tasks before.  So
    no task holds all copies, and rows without copies are not moved.
    """
    same = ["source", "key"]
    repeated = stage(rows.groupBy(*same).agg(F.count("*").alias("n")).filter("n > 1").select(*same), "repeated-keys")
    sure, unsure = split_by_slot(rows, [F.col(c) for c in same], repeated)
    numbered = stage(unsure.withColumn("_row", F.monotonically_increasing_id()), "copies")
    task = F.shiftright("_row", 33).alias("_task")
    counts = numbered.groupBy(*same, task).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*same).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    offsets = counts.select(*same, "_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")).toDF("_source", "_key", "_task", "_before")
    within = Window.partitionBy(*same, "_task").orderBy("_row")
    ranked = numbered.select(*same, "_row", task).withColumn("_rank", F.row_number().over(within))
    own = (ranked["_task"] == offsets["_task"]) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("key") == F.col("_key"))
    copies = ranked.join(offsets, own)
    copies = copies.select("_row", place_of(F.col("key"), F.col("_before") + F.col("_rank")).alias("place"))
    return sure.withColumn("place", place_of(F.col("key"), F.lit(1))), numbered.join(copies, "_row").drop("_row")


def targets(totals: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``source, source_size, target``; one row per source in, so a window over all of them is small.

    Sources take the weights in the order of their code points (null last), repeating.
    With caps sorted by cap over weight, the capped sources are a prefix, and what is
    left over them is shared by weight.
    """
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn(
        "weight",
        F.element_at(weight, (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights) + 1),
    ).withColumn("ceiling", MAX_REPEATS * F.col("source_size").cast("double"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left_over = F.sum("source_size").over(everything) - MAX_REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left_over / weight_left).withColumn("capped", F.col("level") * F.col("weight") > F.col("ceiling"))
    # the first source that is not capped sets the level of all that follow
    final = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return level.select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("ceiling")).otherwise(F.least(F.col("ceiling"), final * F.col("weight"))).alias("target"),
    )


def thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``_source, bound, with_bound`` of every source with words.

    ``bound`` is the first hash at which the running sum of sizes passes the rest;
    documents below it are taken, and those at it if that brings the sum nearer.
    """
    state = plan.select(F.col("source").alias("_source"), "rest", F.lit("").alias("bound"), F.lit(0).cast("long").alias("below"))
    for level in range(1, LEVELS + 1):
        known = F.substring("place", 1, DIGITS * (level - 1))
        within = sizes.join(state, F.col("source").eqNullSafe(F.col("_source")) & (known == F.col("bound")))
        sums = within.groupBy("_source", "rest", "below", F.substring("place", 1, DIGITS * level).alias("bucket")).agg(F.sum("size").alias("inside"))
        running = sums.withColumn("after", F.col("below") + F.sum("inside").over(Window.partitionBy("_source").orderBy("bucket")))
        edge = running.filter("after > rest").groupBy("_source", "rest").agg(F.min(F.struct("bucket", "after", "inside")).alias("edge"))
        state = stage(edge.select(
            "_source", "rest", F.col("edge.bucket").alias("bound"),
            (F.col("edge.after") - F.col("edge.inside")).alias("below"), F.col("edge.after").alias("after"),
        ), "bounds")
    return state.select("_source", "bound", (F.col("after") - F.col("rest") < F.col("rest") - F.col("below")).alias("with_bound"))


def mixture_plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``_source, source_size, target, full, bound, with_bound`` per source, from ``source, size, place`` rows."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stage(targets(totals, weights), "targets")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    goal = goal.withColumn("full", full).withColumn(
        "rest", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("source_size"))
    )
    bounds = thresholds(sizes, goal)
    return stage(
        goal.withColumnRenamed("source", "_goal").join(bounds, F.col("_goal").eqNullSafe(F.col("_source")), "left")
        .select(F.col("_goal").alias("_source"), "source_size", "target", "full", "bound", "with_bound"),
        "mixture-plan",
    )


def copies() -> Column:
    """How often a row with ``place`` and its source's plan is taken; one without words never is."""
    more = (F.col("place") < F.col("bound")) | ((F.col("place") == F.col("bound")) & F.col("with_bound"))
    return F.when(F.col("size") > 0, F.col("full") + F.coalesce(more, F.lit(False)).cast("long")).otherwise(F.lit(0).cast("long"))


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan and ``copies``.  Spark sends the plan to all tasks up to its broadcast limit in bytes."""
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", copies())


def _sizes(documents: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    narrow = stage(documents.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(text).alias("size"), key_of(doc_id, text).alias("key"),
    ), "sizes")
    alone, repeated = _places(narrow)
    return stage(alone.union(repeated.select(*alone.columns)).drop("key"), "places")


def taken(documents: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row.

    A null or empty text has size 0 and is taken for nothing; a null source is a source
    and comes last.  Rows that share id, text and source are numbered and taken apart, so
    that targets are met whatever the ids; a null id is an empty one.  A source without
    words has target 0.  Empty tables give no rows.  Other columns are not read.
    """
    sizes = _sizes(documents, doc_id, source, text)
    return _planned(sizes, mixture_plan(sizes, weights)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(documents: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mixture: rows taken once or more, as they came, with ``copies`` and the columns of ``taken``.

    Columns of those names are replaced.  Texts are read twice, and of them only rows with
    exact copies of the same id are moved, unless there are more sources than Spark sends
    to all tasks.  Which of several such copies are taken is open.
    """
    plan = mixture_plan(_sizes(documents, doc_id, source, text), weights)
    made = ["size", "source_size", "target", "copies", "taken"]
    own = [c for c in documents.columns if c not in made]
    rows = documents.select(F.struct(*own).alias("row"), F.col(source).cast("string").alias("source"), size_of(text).alias("size"), key_of(doc_id, text).alias("key"))
    alone, repeated = _places(rows)
    mixed = _planned(alone.union(repeated.select(*alone.columns)), plan).filter("copies > 0")
    return mixed.select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
