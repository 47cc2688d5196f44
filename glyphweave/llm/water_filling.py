"""Mixing sources to target weights by capped water-filling.

Every source has a weight. A budget of words is shared out by weight; a
source whose share exceeds ``cap`` times its own size is clamped there and
the excess goes to the others by weight, until no share is above its cap.
As the clamped sources are a prefix of the sources ordered by cap over
weight, the water level has a closed form and needs no iteration.

A source with target T and size S is repeated floor(T / S) times whole. The
rest of T is a fraction of one more repetition: documents are taken in the
order of a seeded hash until their words reach it, and the document that
crosses the mark gives its first words only, so that a source's words meet
its target to within one word.

Scale: the hash order is cut into 4096 buckets, so that a hot source spreads
over 4096 keys. Only (source, bucket) sums are shuffled, texts are not; the
sort within a bucket happens in the one bucket of each source that holds the
mark. Of the plan there is one row a source, broadcast up to a stated number.

Defined results: null text is empty and has size 0; a null source is a source
of its own, ordered last; sources without words get target 0 and nothing is
taken; repeated rows count as documents of their own; an empty table gives an
empty table; columns named like this module's results are replaced by them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .sieve import numbered
from .storage import documents, written

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_HEX = 3  # 16**3 buckets
SEED = "mix-1"
BROADCAST = 10_000  # sources
RESULTS = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` has one row for each source: ``source``, ``source_size``.

    Adds ``target``. The one window without a key runs over sources, not
    documents.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("__weight", cycle).withColumn("__cap", F.lit(float(cap)) * F.col("source_size"))
    ordered = W.orderBy((F.col("__cap") / F.col("__weight")).asc(), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (
        F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))
    )
    stepped = weighed.withColumn("__level", level).withColumn("__rank", F.row_number().over(ordered))
    stepped = stepped.withColumn("__clamped", F.col("__level") * F.col("__weight") > F.col("__cap"))
    free = F.min(F.when(~F.col("__clamped"), F.struct("__rank", "__level"))).over(everything)["__level"]
    target = F.when(free.isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), free * F.col("__weight")))
    return stepped.select("source", "source_size", target.alias("target"))


def water_filling_mix(
    docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: str = SEED
) -> DataFrame:
    """``docs`` (doc_id, text, source, …) with ``size``, ``source_size``,
    ``target`` and ``taken`` added: every row stays, ``taken`` counts the
    words of it that the mix takes, repeats included."""
    plain = numbered(docs)
    kept = [f"c{i}" for i, c in enumerate(docs.columns) if c not in RESULTS]
    names = [c for c in docs.columns if c not in RESULTS]
    doc_id, text, by = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text", "source"))
    size = word_count(F.col(text))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    source = F.when(F.col(by).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(by)))
    rows = plain.select(*kept, size.alias("size"), order.alias("__order"), source.alias("__source"))
    rows = rows.withColumn("__bucket", F.substring("__order", 1, BUCKET_HEX))

    # Slim columns only: the scan reads text for its size and drops it.
    buckets = rows.groupBy("__source", "__bucket").agg(F.sum("size").alias("__in_bucket"))
    sums = buckets.groupBy("__source").agg(F.sum("__in_bucket").alias("source_size"))
    named = sums.withColumn("source", F.when(F.col("__source") != "1", F.expr("substring(__source, 2)")))
    targets = source_targets(named.select("source", "source_size"), weights, share, cap)
    keyed = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    targets = targets.select(keyed.alias("__source"), "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("__whole", whole)
    rest = F.floor(F.col("target") - F.col("__whole") * F.col("source_size") + F.lit(0.5)).cast("long")
    targets = targets.withColumn("__rest", rest)
    ahead = F.coalesce(F.sum("__in_bucket").over(W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    line = buckets.withColumn("__ahead", ahead).join(targets, "__source")
    # the bucket where a source's fraction ends: those before it are taken, those behind it not
    beyond = F.col("__ahead") + F.col("__in_bucket") > F.col("__rest")
    mark = F.min(F.when(beyond, F.struct("__bucket", "__ahead")))
    plan = line.groupBy("__source", "source_size", "target", "__whole", "__rest").agg(mark.alias("__m"))
    plan = plan.select("__source", "source_size", "target", "__whole", "__rest", F.col("__m.__bucket").alias("__mark"), F.col("__m.__ahead").alias("__ahead"))
    plan = written(plan, "mix-plan", narrow=True)
    placed = rows.join(F.broadcast(plan) if plan.count() <= BROADCAST else plan, "__source")

    at_mark = F.coalesce(F.col("__bucket") == F.col("__mark"), F.lit(False))
    sure = F.when(F.col("__mark").isNull() | (F.col("__bucket") < F.col("__mark")), F.col("size")).otherwise(F.lit(0))
    plain = placed.where(~at_mark).withColumn("__part", sure.cast("long"))
    before = W.partitionBy("__source").orderBy("__order", doc_id, F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1)
    crossing = placed.where(at_mark).withColumn("__run", F.col("__ahead") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("__run")))
    crossing = crossing.withColumn("__part", part.cast("long")).drop("__run")
    out = plain.unionByName(crossing)
    taken = (F.col("__whole") * F.col("size") + F.col("__part")).alias("taken")
    return out.select(*(F.col(c).alias(n) for c, n in zip(kept, names, strict=True)), "size", "source_size", "target", taken)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return water_filling_mix(docs).select("doc_id", *RESULTS)


ORACLE = """
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
             2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, row_number() OVER q AS rank,
        (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM s) - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w WINDOW q AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT min_by(level, rank) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size,
        CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * weight) END AS target FROM l, f),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
v AS (SELECT *, floor(target - whole * source_size + 0.5)::BIGINT AS rest FROM u),
r AS (SELECT d.doc_id, d.size, v.source_size, v.target, v.whole, v.rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.doc_id, d.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM r
"""
