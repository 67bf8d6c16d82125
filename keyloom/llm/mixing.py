"""Mixing sources to target weights by Pareto order sampling.

Native: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import WORD, cut, kept_columns, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Ranks fall into so many bins; only the bin where a source's words run out is sorted.
BINS = 4096
#: Up to so many sources, their targets (under 100 bytes each) are broadcast; beyond, they are joined with salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 64


def uniform(key: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 that depends on nothing but the key and the seed."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":" + seed))), 1, 13), 16, 10)
    return (bits.cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, n, source_size, target: how many words the mix takes of each source.

    Sources by code point, null last, have the weights in turn. They share share times all words by weight, none more
    than most times its own; what exceeds that goes to the others by weight. In order of most * size / weight the sources
    reach that bound one after another, so the common level is the largest of (words left) / (weight left).
    """
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    wanted = F.lit(float(share)) * F.sum("source_size").over(every)
    left = wanted - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    levels = weighed.withColumn("level", left / weight_left).withColumn("level", F.max("level").over(every))
    target = F.least(F.col("level") * F.col("w"), (most * F.col("source_size")).cast("double"))
    return levels.select("source", "n", "source_size", target.alias("target"))


def with_source(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """rows with what plan has for their sources. A hot source stays spread over tasks either way."""
    renamed = plan.withColumnRenamed("source", "__source")
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(renamed), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    salted = rows.withColumn("__salt", F.pmod("row", F.lit(SALTS)))
    copies = renamed.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__turn"))).drop("__source", "__salt", "__turn")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    seed: str = "mix",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per row of docs: doc_id, the struct keep of the columns listed in keep, size, source_size, target, copies and
    taken (copies * size).

    Each document gets the whole copies that its source's ratio of target to words makes certain. The words still wanted
    come from one more copy of some documents, chosen by Pareto order sampling with inclusion odds in proportion to size:
    documents are ranked by (u / (1 - u)) / odds, u a hash of id and seed, and taken in this order while that brings the
    words nearer to the target. So a source misses its target by at most half of one document, no document is taken
    more than most times, and reruns agree.

    Null and blank texts have size 0; they go with the certain copies only. A null source is a source of its own. Ties
    in rank (repeated ids) go by id, then by text hash; rows that agree in both are alike, and their place in the table tells
    them apart. An empty table gives an empty result.
    Other columns are ignored unless listed in keep. docs is read more than once: it must be a stored table, or another plan
    that gives the same rows in the same partitions each time.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    whole = docs.select(F.col(id_col).alias("doc_id"), kept_columns(keep), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    rows = cut(whole.drop("keep"))
    plan = cut(targets(rows, weights, share, most))
    n_sources = plan.count()
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("certain", F.floor(ratio)).withColumn("wanted", F.col("target") - F.col("certain") * F.col("source_size"))
    # the share that gets one more copy, below one whatever the rounding
    plan = plan.withColumn("chance", F.when(F.col("source_size") > 0, F.least(F.col("wanted") / F.col("source_size"), F.lit(1 - 2.0**-40))))

    def ranked(rows: DataFrame) -> DataFrame:
        u = uniform(F.col("doc_id"), seed)
        odds = F.col("chance") / (1 - F.col("chance")) * F.try_divide(F.col("size") * F.col("n"), F.col("source_size"))
        rank = F.when((F.col("size") > 0) & (F.col("chance") > 0), F.try_divide(u / (1 - u), odds))
        return with_source(rows, plan, n_sources).withColumn("rank", rank)

    # without the source's own chance, which only scales its ranks, these spread over the bins alike in every source
    spread = F.col("rank") * (F.col("chance") / (1 - F.col("chance")))
    bin_ = F.floor(spread / (1 + spread) * BINS).cast("int")
    binned = ranked(rows).filter("rank is not null").withColumn("bin", bin_)
    so_far = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = binned.groupBy("source", "bin", "wanted").agg(F.sum("size").alias("words")).withColumn("through", F.sum("words").over(so_far))
    cutoff = cut(bins.filter("through > wanted").groupBy("source").agg(F.min(F.struct("bin", (F.col("through") - F.col("words")).alias("n"))).alias("cutoff")))
    place = F.struct("rank", "doc_id", "text_hash", "row")
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "text_hash", "row").rowsBetween(Window.unboundedPreceding, 0)
    close = with_source(binned, cutoff, n_sources).filter("bin = cutoff.bin").withColumn("sum", F.col("cutoff.n") + F.sum("size").over(order))
    taken = close.filter(2 * F.col("sum") - F.col("size") <= 2 * F.col("wanted")).groupBy("source").agg(F.max(place).alias("last"))
    limits = cut(
        plan.select("source").join(cutoff.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        .join(taken.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    )

    # a document gets one more copy if it comes no later than the last that does; nothing but the sources' limits moves
    out = with_source(ranked(whole if keep else rows), limits, n_sources)
    more = F.when(F.col("rank").isNull(), 0).when(F.col("cutoff").isNull() | (bin_ < F.col("cutoff.bin")), 1).when((bin_ == F.col("cutoff.bin")) & (place <= F.col("last")), 1).otherwise(0)
    out = out.withColumn("copies", F.col("certain") + more)
    return out.select("doc_id", *(["keep"] if keep else []), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
sizes AS (
  SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size,
         list_extract([5, 2, 1], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - 2 * coalesce(sum(source_size) OVER o, 0)::DOUBLE)
            / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level
  FROM sizes WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (
  SELECT source, n, source_size, least(max(level) OVER () * w, 2 * source_size::DOUBLE) AS target FROM levels),
halves AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS certain FROM plan),
wants AS (SELECT *, target - certain * source_size AS wanted FROM halves),
chances AS (SELECT *, CASE WHEN source_size > 0 THEN wanted / source_size END AS chance FROM wants),
ranked AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.certain, p.wanted,
         CASE WHEN size > 0 AND chance > 0 THEN u / (1 - u) / (chance / (1 - chance) * (size * n / source_size)) END AS rank
  FROM sized d JOIN chances p ON d.source IS NOT DISTINCT FROM p.source),
summed AS (
  SELECT *, sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS through FROM ranked)
SELECT doc_id, size, source_size, target,
       (size * (certain + CASE WHEN rank IS NOT NULL AND 2 * through - size <= 2 * wanted THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""
