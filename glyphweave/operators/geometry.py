"""Page geometry: columns, reading-order distance, boxes, widths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.derived import Read

#: Pixels, as the alignment's contract states them.
CLUSTER_GAP, AT_EDGE, AT_TYPICAL_EDGE = 100, 100, 150
SAME_LINE, LINE_WRAP, LINE_WRAP_ACROSS, COLUMN_WRAP = 50, 100, 1000, 200
BAND, WIDTH_TOLERANCE = 50, 0.35


def edges(words: DataFrame) -> DataFrame:
    """(doc_id, side, position): edges of blocks, of lines, and of each line's first and last word."""
    right = F.col("hpos") + F.col("width")
    lines = words.groupBy("doc_id", "block_seq", "line_seq").agg(
        F.min("hpos").alias("l"), F.max(right).alias("r"), F.min_by("hpos", "seq").alias("first"), F.max_by(right, "seq").alias("last")
    )
    blocks = lines.groupBy("doc_id", "block_seq").agg(F.min("l").alias("l"), F.max("r").alias("r"))
    sides = lambda **of: F.array(*[F.struct(F.lit(name.split("_")[0]).alias("side"), F.col(c).cast("long").alias("position")) for name, c in of.items()])
    of_blocks = blocks.select("doc_id", F.inline(sides(left="l", right="r")))
    return of_blocks.unionByName(lines.select("doc_id", F.inline(sides(left="l", right="r", left_word="first", right_word="last"))))


def edge_clusters(positions: DataFrame) -> DataFrame:
    """Positions less than CLUSTER_GAP apart are a cluster, which its upper
    median stands for: (doc_id, side, cluster, n, edge)."""
    line = W.partitionBy("doc_id", "side").orderBy("position")
    jump = F.when(F.col("position") - F.lag("position").over(line) < CLUSTER_GAP, 0).otherwise(1)
    numbered = positions.withColumn("jump", jump).withColumn("cluster", F.sum("jump").over(line) - 1)
    grouped = numbered.groupBy("doc_id", "side", "cluster").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("position")).alias("all"))
    return grouped.select("doc_id", "side", "cluster", "n", F.element_at("all", F.floor(F.col("n") / 2).cast("int") + 1).alias("edge"))


def typical_edges(positions: DataFrame) -> DataFrame:
    """The commonest position of each side; the least of equally common ones."""
    counted = positions.groupBy("doc_id", "side", "position").agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id", "side").agg(F.max_by("position", F.struct("n", -F.col("position"))).alias("typical"), F.max("n").alias("n"))


def columns(words: DataFrame) -> DataFrame:
    """One row a page: left_edges, right_edges, typical_left, typical_right."""
    positions = edges(words)
    lists = edge_clusters(positions).groupBy("doc_id", "side").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    both = lists.join(typical_edges(positions).drop("n"), ["doc_id", "side"])
    of = lambda side, c: F.first(F.when(F.col("side") == side, F.col(c)), ignorenulls=True)
    return both.groupBy("doc_id").agg(of("left", "edges").alias("left_edges"), of("right", "edges").alias("right_edges"), of("left", "typical").alias("typical_left"), of("right", "typical").alias("typical_right"))


def at_edge(position: Column, positions: Column, typical: Column) -> Column:
    near = F.exists(positions, lambda e: F.abs(position - e) < AT_EDGE)
    return near | (F.abs(position - typical) < AT_TYPICAL_EDGE)


def edge_index(position: Column, positions: Column, typical: Column) -> Column:
    """Index of the first edge nearby; the last one for the typical edge; else null."""
    found = F.array_position(F.transform(positions, lambda e: F.abs(position - e) < AT_EDGE), F.lit(True))
    return F.when(found > 0, found - 1).when(F.abs(position - typical) < AT_TYPICAL_EDGE, F.greatest(F.size(positions) - 1, F.lit(0)).cast("long"))


def adjacent_columns(right_index: Column, left_index: Column, hpos1: Column, hpos2: Column) -> Column:
    """The first word ends a column and the second one begins the next, or wraps to the left."""
    return F.coalesce((left_index == right_index + 1) | (hpos2 < hpos1), F.lit(False)) & right_index.isNotNull() & left_index.isNotNull()


def reading_distance(h1: Column, v1: Column, h2: Column, v2: Column, wraps: Column) -> Column:
    """Distance along the reading order; ``wraps``: the first word ends and the second begins a line."""
    dx, dy = F.abs(h1 - h2), F.abs(v1 - v2)
    column = 10 * dy + 0.1 * dx
    return (
        F.when(dy < SAME_LINE, dx.cast("double"))
        .when(wraps & (dy < LINE_WRAP) & (dx < LINE_WRAP_ACROSS), 0.1 * dy)
        .when(wraps & (h2 < h1) & (dy < COLUMN_WRAP), column)
        .when(wraps & (v2 < v1) & (h2 < h1), column)
        .otherwise((1000 * dy + dx).cast("double"))
    )


def neighbour_distances(words: DataFrame) -> DataFrame:
    """Reading-order distance from each word to the next."""
    line = W.partitionBy("doc_id").orderBy("seq")
    rows = words.withColumn("h2", F.lead("hpos").over(line)).withColumn("v2", F.lead("vpos").over(line)).where(F.col("h2").isNotNull()).join(columns(words), "doc_id")
    right = F.col("hpos") + F.col("width")
    ends, begins = edge_index(right, F.col("right_edges"), F.col("typical_right")), edge_index(F.col("h2"), F.col("left_edges"), F.col("typical_left"))
    rows = rows.withColumn("ends", ends).withColumn("begins", begins)
    wraps = F.col("ends").isNotNull() & F.col("begins").isNotNull()
    return rows.select(
        "doc_id", "seq", reading_distance(F.col("hpos"), F.col("vpos"), F.col("h2"), F.col("v2"), wraps).alias("distance"), adjacent_columns(F.col("ends"), F.col("begins"), F.col("hpos"), F.col("h2")).alias("adjacent")
    )


#: Larger than any place on a page, so that page and place are one number.
WIDE = 1 << 40


def clusters(page: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pages and edges of ``edge_clusters`` for one side, in order."""
    order = np.lexsort((position, page))
    page, position = page[order], position[order]
    first = np.flatnonzero(np.append(True, (page[1:] != page[:-1]) | (np.diff(position) >= CLUSTER_GAP)))
    return page[first], position[first + np.diff(np.append(first, len(page))) // 2]


def typical(page: np.ndarray, position: np.ndarray, pages: int) -> np.ndarray:
    """The position of ``typical_edges`` for one side of each page."""
    keys, n = np.unique(page * WIDE + position, return_counts=True)
    order = np.lexsort((keys, -n, keys // WIDE))
    own, at = np.unique(keys[order] // WIDE, return_index=True)
    out = np.zeros(pages, np.int64)
    out[own] = keys[order][at] % WIDE
    return out


def edge_indexes(page: np.ndarray, position: np.ndarray, own: np.ndarray, edge: np.ndarray, common: np.ndarray) -> np.ndarray:
    """``edge_index`` of positions among the edges (``own``, ``edge``) of their pages; -1 for none."""
    begins, ends = np.searchsorted(own, page), np.searchsorted(own, page, "right")
    k = np.searchsorted(own * WIDE + edge, page * WIDE + position - AT_EDGE, "right")
    near = (k < ends) & (edge[np.minimum(k, len(edge) - 1)] < position + AT_EDGE)
    return np.where(near, k - begins, np.where(np.abs(position - common[page]) < AT_TYPICAL_EDGE, ends - begins - 1, -1))


def distance_columns(r: Read) -> Iterator[tuple]:
    """The page of each word that another follows, its seq, distance and adjacent as ``neighbour_distances`` gives them."""
    n, right = len(r.seq), (r.hpos + r.width).astype(np.int64)
    if not n:
        return
    hpos, vpos, pages = r.hpos.astype(np.int64), r.vpos.astype(np.int64), len(r.at) - 1
    new_page = np.append(True, r.page[1:] != r.page[:-1])
    new_block = new_page | np.append(True, r.block[1:] != r.block[:-1])
    first = np.flatnonzero(new_block | np.append(True, r.line[1:] != r.line[:-1]))
    last = np.append(first[1:], n) - 1
    low, high, own = np.minimum.reduceat(hpos, first), np.maximum.reduceat(right, first), r.page[first]
    blocks = np.flatnonzero(new_block[first])
    page = np.concatenate([own[blocks], own, own])
    indexes = []
    word = np.flatnonzero(~new_page) - 1  # words that another of their page follows
    for least, ends, edge_of_word, place in ((np.maximum.reduceat(high, blocks), high, right[last], right[word]), (np.minimum.reduceat(low, blocks), low, hpos[first], hpos[word + 1])):
        position = np.concatenate([least, ends, edge_of_word])
        indexes.append(edge_indexes(r.page[word], place, *clusters(page, position), typical(page, position, pages)))
    ends, begins = indexes
    h1, h2, v1, v2 = hpos[word], hpos[word + 1], vpos[word], vpos[word + 1]
    dx, dy, wraps = np.abs(h1 - h2), np.abs(v1 - v2), (ends >= 0) & (begins >= 0)
    distance = np.select(
        [dy < SAME_LINE, wraps & (dy < LINE_WRAP) & (dx < LINE_WRAP_ACROSS), wraps & (h2 < h1) & ((dy < COLUMN_WRAP) | (v2 < v1))],
        [dx.astype(float), 0.1 * dy, 10 * dy + 0.1 * dx], (1000 * dy + dx).astype(float),
    )
    yield r.page[word], r.seq[word], distance, wraps & ((begins == ends + 1) | (h2 < h1))


def merged_bounds(words: DataFrame, *key: str) -> DataFrame:
    """The box around all boxes of each key."""
    return words.groupBy(*key).agg(
        F.min("hpos").alias("hpos"), F.min("vpos").alias("vpos"), (F.max(F.col("hpos") + F.col("width")) - F.min("hpos")).alias("width"),
        (F.max(F.col("vpos") + F.col("height")) - F.min("vpos")).alias("height"), F.count("*").alias("n"),
    )


def band_char_width(matched: DataFrame) -> DataFrame:
    """Mean pixels a character of matched words whose top is within BAND of the
    word's: (doc_id, seq, char_width). ``matched`` has width, vpos and word."""
    band = W.partitionBy("doc_id").orderBy("vpos").rangeBetween(-BAND, BAND)
    return matched.select("doc_id", "seq", (F.sum("width").over(band) / F.sum(F.length("word")).over(band)).alias("char_width"))


def width_fit(width: Column, estimated: Column) -> Column:
    """100 within the tolerance, then two points less for each percent off."""
    ratio = estimated / width
    off = F.abs(ratio - 1.0)
    return F.when(width == 0, 0.0).when((ratio < 1.0 - WIDTH_TOLERANCE) | (ratio > 1.0 + WIDTH_TOLERANCE), F.greatest(F.lit(0.0), 100.0 - off * 200.0)).otherwise(100.0)
