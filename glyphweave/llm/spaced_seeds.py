"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask fixes which positions of a short stretch of tokens count and which are
ignored. Every stretch of the test items and of the documents is hashed under
every mask; a shared hash puts an item on a diagonal of a document, where all
tokens that face each other are compared. A document leaks an item if some
stretch of ``WINDOW`` facing tokens (or the whole item, if that is shorter)
has at most ``MISSES`` differences: substitutions are tolerated, as a seed
skips the positions that its mask ignores. Wherever up to ``MISSES`` of the
facing tokens differ, at least one mask finds a seed (tests go through all
placements); items of under ``WINDOW`` tokens have masks of their own, and those
of under ``SPAN`` tokens have to occur whole and unchanged.

Scale: a first pass over the documents finds seeds. Their hashes meet the
items' in a broadcast table while these are at most ``BROADCAST`` rows, and
otherwise pass a bitmap of fixed size before a shuffle join. Only distinct
(document, item, diagonal) leave it, however many seeds a diagonal has. A second
pass reads the documents on that list (broadcast up to ``BROADCAST`` rows,
thinned by the bitmap beyond) and compares each diagonal once; the last
aggregation is on (document, item).

Defined results: tokens are runs of letters and digits in lower case; null and
empty texts have none and no leaks, nor have items without tokens; repeated rows
and rows that share a doc_id count as one document; of equal items each is
reported; an empty benchmark and an empty table give no rows; a leak that stands
on several diagonals is one row, from its first to its last token; a text is one
row whatever its length; other columns of the documents stay as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sieve import thinned, without
from .storage import documents, written

#: Positions that count; fixed, as seeds of items and documents must agree. SHORT is for items of SPAN to WINDOW - 1 tokens.
MASKS = ((0, 1, 2, 4, 5), (0, 2, 7, 8, 9), (0, 1, 6, 8, 9))
SHORT = ((0, 1, 3, 4), (0, 1, 6, 7), (0, 2, 4, 6))
SPAN = 10
WINDOW = 13
MISSES = 3
BROADCAST = 1_000_000


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the tokens of a text."""
    tokens = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(tokens, lambda w: F.xxhash64(w))


def masks_for(sizes: set[int]) -> list[tuple[tuple[int, ...], int, int]]:
    """The masks that items of these sizes (WINDOW stands for all from there on)
    need, each with the least and the most tokens of its items."""
    masks = [(mask, WINDOW, 1 << 30) for mask in MASKS]
    if any(SPAN <= n < WINDOW for n in sizes):
        masks += [(mask, SPAN, WINDOW - 1) for mask in SHORT]
    return masks + [(tuple(range(n)), n, n) for n in sorted(sizes) if 0 < n < SPAN]


def seeded(df: DataFrame, hashes: str, masks: list[tuple[tuple[int, ...], int, int]], by_size: bool) -> DataFrame:
    """``df`` with a row for each stretch and mask: ``pos`` and ``seed``, which is
    null where the mask doesn't fit (``by_size``: or isn't for an item of that size)."""
    size, least = F.size(hashes), min(mask[-1] + 1 for mask, _, _ in masks)
    places = df.where(size >= least).withColumn("pos", F.explode(F.sequence(F.lit(0), size - least)))
    seeds = []
    for number, (mask, fewest, most) in enumerate(masks):
        fits = F.col("pos") + mask[-1] < size
        seed = F.xxhash64(F.lit(number), *[F.get(F.col(hashes), F.col("pos") + k) for k in mask])
        seeds.append(F.when(fits & size.between(fewest, most) if by_size else fits, seed))
    return places.withColumn("seed", F.explode(F.array(*seeds)))


def hits(docs: DataFrame, items: DataFrame, broadcast: int) -> DataFrame:
    """Distinct (doc_id, item_id, shift): diagonals with a seed."""
    sizes = {x.n for x in items.select(F.least(F.size("item"), F.lit(WINDOW)).alias("n")).distinct().collect()}  # WINDOW + 1 rows at most
    masks = masks_for(sizes)
    item_seeds = seeded(items, "item", masks, True).where("seed is not null").select("seed", "item_id", F.col("pos").alias("item_pos")).distinct()
    seeds = seeded(docs.select("doc_id", token_hashes(F.col("text")).alias("h")), "h", masks, False).select("doc_id", "pos", "seed")
    if item_seeds.limit(broadcast + 1).count() <= broadcast:
        met = seeds.join(F.broadcast(item_seeds), "seed")
    else:
        met = thinned(seeds, "seed", item_seeds.select("seed")).join(item_seeds, "seed")
    return met.select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """Leaked items of ``docs`` (doc_id, text): ``doc_id``, ``item_id``,
    ``first_token`` and ``end_token`` of the verified stretches in the
    document, and ``n_matched``, most equal tokens on one diagonal."""
    docs = docs.select("doc_id", "text")
    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("item"))
    found = written(hits(docs, items, broadcast), "seed-hits", narrow=True)
    ids = found.select(F.col("doc_id").alias("hit_id")).distinct()
    few = found.limit(broadcast + 1).count() <= broadcast
    small = F.broadcast if few else lambda df: df
    own = docs if few else thinned(docs, "doc_id", ids)
    own = own.join(small(ids), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi").select("doc_id", token_hashes(F.col("text")).alias("h"))
    met = own.join(small(found.withColumnRenamed("doc_id", "hit_id")), F.col("doc_id").eqNullSafe(F.col("hit_id"))).drop("hit_id")
    met = met.join(F.broadcast(items) if items.limit(broadcast + 1).count() <= broadcast else items, "item_id")
    met = met.withColumn("in_doc", F.greatest("shift", F.lit(0))).withColumn("in_item", F.greatest(-F.col("shift"), F.lit(0)))
    met = met.withColumn("n", F.least(F.size("h") - F.col("in_doc"), F.size("item") - F.col("in_item")))
    window, missed = F.least(F.lit(WINDOW), F.size("item")), F.when(F.size("item") < SPAN, 0).otherwise(MISSES)
    met = met.select("doc_id", "item_id", "in_doc", "n", "h", "item", "in_item", window.alias("window"), missed.alias("missed")).where("n >= window")
    # where facing tokens differ, with the places before the first and behind the last
    differ = F.expr("filter(sequence(0, n - 1), i -> h[in_doc + i] != item[in_item + i])")
    met = met.withColumn("edges", F.concat(F.array(F.lit(-1)), differ, F.array("n"))).drop("h", "item", "in_item")
    # longest stretches with as many differences as allowed lie between an edge and one some edges on
    stretches = F.expr("transform(sequence(0, greatest(0, size(edges) - 2 - missed)), k -> named_struct('a', edges[k] + 1, 'b', edges[least(k + missed + 1, size(edges) - 1)]))")
    met = met.withColumn("good", F.filter(stretches, lambda x: x["b"] - x["a"] >= F.col("window"))).where(F.size("good") > 0)
    verified = met.select(
        "doc_id", "item_id", (F.col("in_doc") + F.array_min("good")["a"]).alias("first_token"), (F.col("in_doc") + F.array_max("good")["b"]).alias("end_token"),
        (F.col("n") - F.size("edges") + 2).alias("n_matched"),
    )
    return verified.groupBy("doc_id", "item_id").agg(
        F.min("first_token").cast("long").alias("first_token"), F.max("end_token").cast("long").alias("end_token"), F.max("n_matched").cast("long").alias("n_matched")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    leaky = written(leaks(docs, benchmark).select("doc_id").distinct(), "leaky-ids", narrow=True)
    return without(docs, ["doc_id"], leaky)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
