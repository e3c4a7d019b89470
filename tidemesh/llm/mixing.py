"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1. Its integral, scaled to the source's target, is the
source's cumulative token demand; inverting it gives each document copy its training position, and a range sort by
position gives the training order. All work is DataFrame functions on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemesh.llm.common import buckets_for, saved, table, word_count

#: How steeply the schedules of the sources, in turn, rise (above 0) or fall over training time.
RAMPS = (-0.5, 0.0, 0.5)


def demand_inverse(share: Column, ramp: Column) -> Column:
    """The time at which a source has asked for this share (0 to 1) of its tokens.

    The schedule is w(t) = 1 + ramp * (2t - 1), |ramp| < 1; its integral is (1 - ramp) t + ramp t^2.
    """
    b = 1 - ramp
    return F.when(ramp == 0, share).otherwise((F.sqrt(b * b + 4 * ramp * share) - b) / (2 * ramp))


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """sizes (source, source_size), with nth, weight, target and ramp.

    The total share * sum(source_size) is dealt by weight; a target stops at most * source_size and the excess is
    dealt again by weight until none is above. Each driver round fetches three sums. Sources are few against rows:
    one row each is ordered in one sort.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("nth") % len(values) + 1).cast("int"))
    ranked = saved(sizes.withColumn("nth", turn).withColumn("weight", pick(weights)).withColumn("ramp", pick(RAMPS)), "sources")
    limit = F.col("source_size") * most
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, before = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level > limit
        capped, weight, held = ranked.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if level is not None and held == before:
            break
        if not weight:
            break
        level, before = (share * total - (capped or 0.0)) / weight, held
    dealt = F.col("weight") * F.lit(float(level or 0.0))
    return ranked.withColumn("target", F.when(dealt > limit, limit).otherwise(dealt).cast("double"))


def plan_mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), whole: bool = False, mark: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, passes, extra, position, and mark as _mark.

    A source's rows stand in the order of an md5 of doc_id and text. The mix passes floor(target / source_size) times
    over all of them and once more over the first, up to the target; the row that reaches it gives only the words still
    missing (with whole: it counts if its middle is before the target). taken is the sum in words, position the training
    time of the row's first copy, null where nothing is taken. Null and empty texts have size 0 and take no part; a null
    source is a source, last in order; repeated rows stay rows of their own; an empty table gives no rows. Other columns
    are not read. Only digests of the rows are shuffled.
    """
    size = word_count(F.col("text"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit(""))))
    held = (F.lit(None).cast("binary") if mark is None else mark).alias("_mark")
    rows = saved(docs.select("doc_id", size.alias("size"), "source", F.unhex(key).alias("key"), held), "mix")
    n = buckets_for(rows.count(), 4_000)
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") * n, 32))
    per = saved(rows.groupBy("source", "bucket").agg(F.sum("size").alias("_sum")), "mix-sums")
    targets = source_targets(per.groupBy("source").agg(F.sum("_sum").alias("source_size")), share, most, weights)
    told = per.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return _placed(rows, told, whole).select("doc_id", "size", "source_size", "target", "taken", "passes", "extra", "position", "_mark")


def _placed(rows: DataFrame, told: DataFrame, whole: bool) -> DataFrame:
    keys = ["source", "bucket"]
    first = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = told.select(*(F.col(k).alias(f"_{k}") for k in keys), "source_size", "target", "ramp", F.coalesce(F.sum("_sum").over(first), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*keys).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    placed = placed.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(0))
    left = F.round(F.col("target")).cast("long") - passes * F.col("source_size") - F.col("before")
    extra = F.when(left * 2 > F.col("size"), F.col("size")).otherwise(0) if whole else F.greatest(F.lit(0), F.least(F.col("size"), left))
    placed = placed.withColumn("extra", extra.cast("long"))
    taken = F.col("passes") * F.col("size") + F.col("extra")
    share = F.least(F.lit(1.0), F.col("before") / F.col("target"))
    return placed.withColumn("taken", taken).withColumn("position", F.when(taken > 0, demand_inverse(share, F.col("ramp"))))


def copies_of(plan: DataFrame) -> DataFrame:
    """One row per copy: the plan's rows, with copy (from 0), words, and position the copy's own.

    Later passes over a source follow the first by the time that one pass takes.
    """
    n = F.col("passes") + F.when(F.col("extra") > 0, 1).otherwise(0)
    copies = plan.where(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    copies = copies.withColumn("words", F.when(F.col("copy") < F.col("passes"), F.col("size")).otherwise(F.col("extra")))
    later = F.col("position") + F.col("copy") * F.least(F.lit(1.0), F.col("source_size") / F.col("target"))
    return copies.withColumn("position", later)


def order_copies(plan: DataFrame) -> DataFrame:
    """The plan's copies (see copies_of) in training order, range-sorted by position."""
    return copies_of(plan).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mix_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """The rows of docs, whole and as often as the mix takes them, in training order.

    The mix is planned on digests (see plan_mix, with whole); texts meet the plan once, by the digest of their row, of
    which equal rows have one, and are range-sorted once.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kinds = [F.md5(c) if kind == "string" else c.cast("string") for c, (_, kind) in zip(columns, docs.dtypes, strict=True)]
    mark = F.unhex(F.md5(F.to_json(F.struct(*(k.alias(f"c{i}") for i, k in enumerate(kinds))))))
    copies = copies_of(plan_mix(docs, share, most, weights, whole=True, mark=mark)).select("_mark", "position", "copy")
    rows = docs.select(mark.alias("_mark"), F.struct(*columns).alias("_row")).groupBy("_mark").agg(F.first("_row").alias("_row"))
    told = copies.join(rows, "_mark").repartitionByRange("position", "_mark", "copy").sortWithinPartitions("position", "_mark", "copy")
    return told.select("_row.*")


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target, words taken and training position of every document (see plan_mix)."""
    plan = plan_mix(table(spark, sf_dir, "documents"))
    plan = plan.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))
    return plan.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth
  FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][(nth % 3 + 1)::INT] AS weight, [-0.5, 0.0, 0.5][(nth % 3 + 1)::INT]::DOUBLE AS ramp FROM s
), ranked AS (
  -- sources in the order in which their targets fill up; level is what fills the rest once those before are full
  SELECT *, coalesce(sum(source_size * 2.0::DOUBLE) OVER f, 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS weight_left
  FROM w WINDOW f AS (ORDER BY source_size * 2.0::DOUBLE / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM w)::DOUBLE - capped) / weight_left AS level FROM ranked
), chosen AS (
  SELECT arg_min(level, source_size * 2.0::DOUBLE / weight) AS level FROM levels WHERE weight * level <= source_size * 2.0::DOUBLE
), t AS (
  SELECT w.*, least(source_size * 2.0::DOUBLE, weight * chosen.level) AS target,
         floor(least(source_size * 2.0::DOUBLE, weight * chosen.level) / nullif(source_size, 0))::BIGINT AS passes
  FROM w, chosen
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.ramp, coalesce(t.passes, 0) AS passes,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, (passes * size + greatest(0, least(size, round(target)::BIGINT - passes * source_size - before)))::BIGINT AS taken,
         least(1.0::DOUBLE, before / nullif(target, 0)) AS share, 1 - ramp AS b
  FROM p
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(CASE WHEN ramp = 0 THEN share
            ELSE (sqrt(b * b + 4 * ramp * share) - b) / (2 * ramp) END, 9) END AS position
FROM q
"""
