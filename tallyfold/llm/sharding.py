"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

DataFrame functions only: no Python in tasks.

1. Rows stay where they are read and get a number there.  A block is a run of at most
   ``BLOCK`` rows of one task, so blocks are bounded whatever the partitions are.
2. How many rows of each block go to each shard is drawn exactly: the margins are the
   blocks' sizes and the shards' sizes, the law is that of a uniform permutation
   (multivariate hypergeometric).  Blocks are the leaves of a tree of fan-out ``FAN``;
   a node's counts are split over its children, one level a job, so no task ever sees
   the whole matrix.
3. Every block is permuted by a random key: its first rows go to shard 0, the next to
   shard 1, and so on (the local permutation).
4. Rows go to their shards and are permuted there again by a second key.  A shard is cut
   by the leading bits of that key into bins, which are counted first, so that a place is
   the bin's offset and a rank in the bin: no task holds a whole shard.

No key of the data decides where a row goes, so equal ids, equal texts and a source with
a third of all rows are spread like any others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARDS = 8
BLOCK_BITS = 16  # 65,536 rows of one task at most are permuted together
BIN_ROWS = 1 << 14  # rows that a bin of a shard has on average, at most
FAN_BITS = 4
SPREAD = 10  # standard deviations to both sides of the mode that a draw looks at: e ** -50 lies beyond
_IN_TASK = 33  # bits of Spark's row numbers that count within a task


def uniform(*parts: Column) -> Column:
    """A hash of the parts as a double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def hypergeometric(good: Column, bad: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items out of ``good`` + ``bad`` are good, for a uniform ``u``.

    By inversion.  The law's weights follow from their ratios, starting with 1 at the
    mode, so neither factorials nor logarithms are needed: one walk adds them up, and a
    second one stops where the running sum passes ``u`` of that.  Both span ``SPREAD``
    deviations, a number of steps that grows with the root of ``drawn``, and a state of
    three numbers.
    """
    def law(s: Column) -> Column:
        g, b, n = s["g"], s["b"], s["n"]
        total = F.greatest(g + b, F.lit(1))
        share = g / total
        deviation = F.sqrt(n * share * (1 - share) * (total - n) / F.greatest(total - 1, F.lit(1)))
        mode = F.floor((n + 1) * ((g + 1) / (total + 2))).cast("long")
        reach = F.ceil(SPREAD * deviation).cast("long") + 12
        low, high = F.greatest(F.lit(0), n - b).cast("long"), F.least(n, g).cast("long")
        mode = F.least(F.greatest(mode, low), high)
        return F.struct(
            g.alias("g"), b.alias("b"), n.alias("n"), mode.alias("mode"),
            F.greatest(low, mode - reach).alias("low"), F.least(high, mode + reach).alias("high"),
        )

    def up(s: Column, k: Column) -> Column:  # weight of k over that of k - 1
        return ((s["g"] - k + 1).cast("double") * (s["n"] - k + 1)) / (k.cast("double") * (s["b"] - s["n"] + k))

    def down(s: Column, k: Column) -> Column:  # weight of k over that of k + 1
        return ((k + 1).cast("double") * (s["b"] - s["n"] + k + 1)) / ((s["g"] - k).cast("double") * (s["n"] - k))

    def steps(first: Column, last: Column) -> Column:
        return F.when(first <= last, F.sequence(first, last, F.lit(1).cast("long"))).otherwise(F.array().cast("array<long>"))

    def walk(s: Column, upward: bool, goal: Column, start: Column) -> Column:
        """Weights from the mode to one end: last weight, sum, and the first k whose sum passes the goal."""
        ks = steps(s["mode"] + 1, s["high"]) if upward else F.transform(steps(F.lit(1).cast("long"), s["mode"] - s["low"]), lambda i: s["mode"] - i)
        zero = F.struct(F.lit(1.0).alias("w"), start.alias("sum"), F.lit(None).cast("long").alias("at"))

        def step(state: Column, k: Column) -> Column:
            weight = state["w"] * (up(s, k) if upward else down(s, k))
            return F.struct(
                weight.alias("w"), (state["sum"] + weight).alias("sum"),
                F.coalesce(state["at"], F.when(state["sum"] + weight > goal, k)).alias("at"),
            )

        return F.aggregate(ks, zero, step)

    def let(value: Column, then: Callable[[Column], Column]) -> Column:
        """``then`` of a value that is worked out once."""
        return F.element_at(F.transform(F.array(value), then), 1)

    infinite = F.lit(float("inf"))

    def draw(s: Column) -> Column:
        sums = F.struct(
            walk(s, True, infinite, F.lit(1.0))["sum"].alias("upper"), walk(s, False, infinite, F.lit(0.0))["sum"].alias("lower")
        )

        def find(t: Column) -> Column:
            goal = s["u"] * (t["upper"] + t["lower"])
            return F.when(goal < 1.0, s["mode"]).otherwise(
                F.when(goal < t["upper"], F.coalesce(walk(s, True, goal, F.lit(1.0))["at"], s["high"])).otherwise(
                    F.coalesce(walk(s, False, goal - t["upper"], F.lit(0.0))["at"], s["low"])
                )
            )

        return let(sums, find)

    numbers = F.struct(good.alias("g"), bad.alias("b"), drawn.alias("n"))
    return let(numbers, lambda s: let(law(s).withField("u", u), draw))


def _split(capacities: Column, child: Column, seed: Column) -> Column:
    """A child's counts per shard, drawn from what its parent has left for the rest of its children.

    The state keeps what the child still has to draw and what the shards to come hold.
    """
    total = F.aggregate(capacities, F.lit(0).cast("long"), lambda a, c: a + c)
    zero = F.struct(child.alias("draw"), total.alias("rest"), F.array().cast("array<long>").alias("counts"))

    def one(state: Column, shard: Column) -> Column:
        good = F.element_at(capacities, shard + 1)
        bad = state["rest"] - good
        drawn = hypergeometric(good, bad, state["draw"], uniform(seed, shard))
        return F.element_at(F.transform(F.array(drawn), lambda x: F.struct(
            (state["draw"] - x).alias("draw"), bad.alias("rest"), F.concat(state["counts"], F.array(x)).alias("counts"))), 1)

    return F.aggregate(F.sequence(F.lit(0), F.size(capacities) - 1), zero, one)["counts"]


def _next_child(seed: int, level: int) -> Callable[[Column, Column], Column]:
    """The step of a node's split over its children: draw the next child's counts, keep what is left."""

    def step(state: Column, child: Column) -> Column:
        drawn = _split(state["left"], child["n"], F.struct(F.lit(seed), F.lit(level), child["child"]))
        return F.element_at(F.transform(F.array(drawn), lambda counts: F.struct(
            F.zip_with(state["left"], counts, lambda a, b: a - b).alias("left"),
            F.concat(state["done"], F.array(F.struct(child["child"].alias("child"), counts.alias("counts")))).alias("done"),
        )), 1)

    return step


def communication_matrix(blocks: DataFrame, capacities: list[int], seed: int = 0) -> DataFrame:
    """``block, counts``: rows of every block (``block`` long from 0, ``n``) for each shard.

    ``capacities`` are the shards' sizes and add up to the blocks'.  One job per level of
    the tree; a node has at most ``2 ** FAN_BITS`` children.
    """
    top = blocks.agg(F.max("block")).first()[0]
    spark = blocks.sparkSession
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("node"), F.array(*[F.lit(c).cast("long") for c in capacities]).alias("counts"))
    if top is None:
        return nodes.select(F.col("node").alias("block"), "counts").limit(0)
    depth = 0
    while top >> FAN_BITS * depth:
        depth += 1
    for level in reversed(range(depth)):
        children = (
            blocks.groupBy(F.shiftright("block", FAN_BITS * level).alias("child")).agg(F.sum("n").alias("n"))
            .groupBy(F.shiftright("child", FAN_BITS).alias("node"))
            .agg(F.sort_array(F.collect_list(F.struct("child", "n"))).alias("children"))
        )
        zero = F.struct(F.col("counts").alias("left"), F.array().cast("array<struct<child:bigint,counts:array<bigint>>>").alias("done"))

        split = nodes.join(children, "node").select(F.explode(F.aggregate("children", zero, _next_child(seed, level))["done"]).alias("d"))
        nodes = stage(split.select(F.col("d.child").alias("node"), "d.counts"), "matrix")
    return nodes.withColumnRenamed("node", "block")


def assign(numbered: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The rows of ``numbered`` with ``shard`` and ``slot``, given Spark's row numbers as ``_row``.

    Shards differ by one row at most, the first ones being larger; a shard's slots run
    from 0 without gaps.
    """
    # task after task, then the further blocks of tasks with more than one: nearly gapless numbers
    tasks = (numbered.agg(F.max(F.shiftright("_row", _IN_TASK))).first()[0] or 0) + 1
    in_task = F.col("_row").bitwiseAND(F.lit((1 << _IN_TASK) - 1))
    block = F.shiftright(in_task, BLOCK_BITS) * tasks + F.shiftright("_row", _IN_TASK)
    placed = numbered.withColumn("_block", block)
    blocks = stage(placed.groupBy(F.col("_block").alias("block")).agg(F.count("*").alias("n")), "blocks")
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(blocks, sizes, seed)
    ends = matrix.select(F.col("block").alias("_block"), F.transform(F.sequence(F.lit(1), F.size("counts")), lambda i: F.aggregate(
        F.slice("counts", 1, i), F.lit(0).cast("long"), lambda a, c: a + c)).alias("_ends"))

    local = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "_row"), "_row")
    ranked = placed.withColumn("_rank", F.row_number().over(local)).join(ends, "_block")
    # ends rise, so the shard is the number of ends below the rank
    shard = F.size(F.filter("_ends", lambda end: end < F.col("_rank"))).alias("shard")
    bits = max(0, (max(sizes) // BIN_ROWS).bit_length())
    key = F.xxhash64(F.lit(seed), F.lit("shard"), "_row")
    bin_ = F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")
    dealt = stage(ranked.select(*numbered.columns, shard, key.alias("_key"), bin_.alias("_bin")), "dealt")
    counts = dealt.groupBy("shard", "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row per bin
    offsets = counts.select("shard", "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_bin").orderBy("_key", "_row")
    slot = F.col("_offset") + F.row_number().over(within) - 1
    return dealt.join(offsets, ["shard", "_bin"]).select(*numbered.columns, "shard", slot.cast("long").alias("slot"))


def shuffled(documents: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """All rows and columns with ``shard`` and ``slot`` (own columns of those names are replaced).

    Rows are staged once with their numbers, the shards are drawn on the numbers alone,
    and whole rows then move once, to their places.
    """
    own = [c for c in documents.columns if c not in ("shard", "slot")]
    rows = stage(documents.select(F.struct(*own).alias("row"), F.monotonically_increasing_id().alias("_row")), "numbered")
    placed = assign(rows.select("_row"), shards, seed)
    return rows.join(placed, "_row").select("row.*", "shard", "slot")


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, seed: int = 0, rows_per_file: int = 1 << 20) -> None:
    """Write the shuffle as Parquet folders ``shard=0``, ``shard=1``, ..., every file a run of slots in order."""
    placed = shuffled(documents, shards, seed)
    piece = F.floor(F.col("slot") / rows_per_file)
    placed.repartition("shard", piece).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest_rows(documents: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; the law is ``rows``.

    A null text has size 1 and the checksum of no bytes.  Null and equal ids and repeated
    rows are rows like any other; each gets a slot of its own.  Fewer rows than shards
    leave the last shards empty; an empty table gives no rows.  Other columns are not
    read.  The same files read with the same split sizes give the same shards.
    """
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = documents.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(own) + 1).cast("long").alias("size"),
        F.crc32(F.encode(own, "UTF-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"),
    )
    placed = assign(stage(narrow, "numbered"), shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
