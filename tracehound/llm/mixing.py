"""Mix sources to target weights by repeating documents.

Words are summed per source, targets follow the weights with each target
limited to ``max_epochs`` times its source, and a document of a source with
repetition rate r is emitted floor(r) times plus one more copy with
probability frac(r).  The extra copy is a Bernoulli draw from a hash of the
seed and the document id, so a rerun draws the same copies and no row has to
meet another row.

The draw compares the hash with a per-source threshold.  The threshold is the
one of ``CELLS`` + 1 hash levels at which the words drawn come closest to the
words wanted, so it equals the fraction up to the noise that plain draws would
have left in the result.

Rows: a null or empty text has size 0 and is emitted like any other row; a
null source is a source of its own, ordered last; rows that repeat a
``doc_id`` draw alike.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import common

WEIGHTS = (5, 2, 1)
CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_cell(id_col: Column, seed: int) -> Column:
    """Hash level 0..CELLS-1 of a document: three hex digits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one
    row per source.  Sources in code-point order take the weights in turn.

    Sharing the excess of capped sources again and again ends where the
    sources with the smallest limit per weight are capped and the rest share
    what is left by weight; one running sum in that order finds the point.
    The window is over one row per source, not over documents."""
    ranked = sizes.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    r = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * max_epochs)
    r = r.withColumn("turn", F.row_number().over(W.orderBy((F.col("most") / F.col("weight")), "k")))
    before, whole = W.orderBy("turn").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    r = r.withColumn("rest", F.sum("source_size").over(whole) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    r = r.withColumn("rest_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    r = r.withColumn("capped", F.col("most") * F.col("rest_weight") <= F.col("rest") * F.col("weight"))
    # the first source that is not capped sets the level for all after it
    first = F.min(F.when(~F.col("capped"), F.struct("turn", "rest", "rest_weight"))).over(whole)
    r = r.withColumn("first", first)
    free = F.col("turn") >= F.col("first.turn")
    target = F.when(F.coalesce(free, F.lit(False)), F.col("weight") * F.col("first.rest") / F.col("first.rest_weight")).otherwise(F.col("most"))
    return r.select("source", "source_size", "weight", target.cast("double").alias("target"))


def plan(light: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Per source: source_size, target, whole (copies every document gets) and
    threshold (hash levels that get one more), from (source, size, cell)."""
    cells = light.groupBy("source", "cell").agg(F.sum("size").alias("w"))
    cells = common.stash(cells, "mix-cells")
    goal = targets(cells.groupBy("source").agg(F.sum("w").cast("long").alias("source_size")), weights, share, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int"))
    goal = goal.withColumn("wanted", (F.col("rate") - F.col("whole")) * F.col("source_size"))
    g = goal.select(F.col("source").alias("s"), "wanted")
    run = cells.join(g, F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "upto", F.sum("w").over(W.partitionBy("source").orderBy("cell"))
    )
    none = g.select(F.col("s").alias("source"), F.lit(0).alias("threshold"), F.col("wanted").alias("gap"))
    steps = run.select("source", (F.col("cell") + 1).alias("threshold"), F.abs(F.col("upto") - F.col("wanted")).alias("gap"))
    best = none.unionByName(steps).groupBy("source").agg(F.min(F.struct("gap", "threshold")).alias("b"))
    best = best.select(F.col("source").alias("s"), F.col("b.threshold").alias("threshold"))
    return goal.join(best, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "target", "whole", "threshold")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17,
) -> DataFrame:
    """``docs`` with one struct column ``mix``: (size, source_size, target,
    copies, taken).  ``copies`` 0 leaves the document out of the mix."""
    sized = docs.withColumn("mix", F.struct(words(F.col(text_col)).alias("size"), draw_cell(F.col(id_col), seed).alias("cell")))
    light = sized.select(F.col(source_col).alias("source"), "mix.size", "mix.cell")
    per = common.stash(plan(light, weights, share, max_epochs).coalesce(1), "mix-plan")
    names = {c: f"_plan_{c}" for c in per.columns}
    per = common.bounded(per.withColumnsRenamed(names), 200)
    out = sized.join(per, F.col(source_col).eqNullSafe(F.col("_plan_source")), "left")
    copies = F.col("_plan_whole") + (F.col("mix.cell") < F.col("_plan_threshold")).cast("int")
    made = F.struct(
        F.col("mix.size").alias("size"), F.col("_plan_source_size").alias("source_size"), F.col("_plan_target").alias("target"),
        copies.alias("copies"), (copies * F.col("mix.size")).cast("long").alias("taken"),
    )
    return out.withColumn("mix", made).drop(*names.values())


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document ``mix.copies`` times, without ``mix``."""
    return mixed.where("mix.copies > 0").withColumn("mix", F.explode(F.array_repeat(F.lit(0), F.col("mix.copies")))).drop("mix")
