"""Operators on tokens in reading order: neighbours, paragraphs, layout tags, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx


def reading():
    """Rows of a page in reading order."""
    return W.partitionBy("doc_id").orderBy("seq")


def with_neighbours(words: DataFrame, *columns: str) -> DataFrame:
    """Adds ``before_x`` and ``after_x`` for the given columns."""
    for c in columns:
        words = words.withColumn(f"before_{c}", F.lag(c).over(reading())).withColumn(f"after_{c}", F.lead(c).over(reading()))
    return words


def page_text(words: DataFrame, content: str = "content", separator: str = " ") -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("seq", F.col(content).alias("w"))))
    return words.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["w"]), separator).alias("text"))


def paragraph_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, para_id, seq, word): paragraphs are parted by blank lines; an
    empty one uses up an id."""
    paragraphs = docs.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n+")).alias("para_id", "part"))
    each = paragraphs.select("doc_id", "para_id", F.posexplode(tx.tokens(F.col("part"))).alias("i", "word"))
    seq = F.row_number().over(W.partitionBy("doc_id").orderBy("para_id", "i")) - 1
    return each.select("doc_id", "para_id", seq.alias("seq"), "word")


TAG_LINE = r"^\s*\[([^\]]+)\]\s*$"


def layout_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text, layout_tag): lines under the tag line above them;
    tag lines themselves go."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    found = F.regexp_extract("text", TAG_LINE, 1)
    tag = F.when(found != "", F.replace(F.lower(F.trim(found)), F.lit(" "), F.lit("_")))
    lines = lines.withColumn("own", tag)
    above = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("layout_tag", F.last("own", ignorenulls=True).over(above)).where(F.col("own").isNull()).select("doc_id", "line", "text", "layout_tag")


def prepared_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, word, norm, layout_tag, clean_para_id): the tokens of texts
    without their tag lines, with the tag above them and their paragraph."""
    lines = layout_lines(docs)
    each = lines.select("doc_id", "line", "layout_tag", F.posexplode(tx.tokens(F.col("text"))).alias("i", "word"))
    seq = F.row_number().over(W.partitionBy("doc_id").orderBy("line", "i")) - 1
    tagged = each.select("doc_id", seq.alias("seq"), "word", tx.normalized(F.col("word")).alias("norm"), "layout_tag")
    joined = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l"))
    plain = joined.select("doc_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))
    paragraphs = paragraph_tokens(plain).select("doc_id", "seq", F.col("para_id").alias("clean_para_id"))
    return tagged.join(paragraphs, ["doc_id", "seq"])


def word_search(words: DataFrame, query: str) -> DataFrame:
    """Words that contain the query, or that end in a hyphen and whose stem is part of it."""
    low = F.lower("content")
    stem = F.regexp_replace(low, r"[-—]+\s*$", "")
    broken = tx.hyphen_ended(F.col("content")) & (stem != "") & F.contains(F.lit(query.lower()), stem)
    return words.where(F.contains(low, F.lit(query.lower())) | broken)


def split_parts(words: DataFrame) -> DataFrame:
    """Words that hold separators as their parts, each with its share of the box
    by characters: (doc_id, seq, part_no, part, part_hpos, part_width)."""
    parts = F.filter(F.split("content", r"[ ,!*~]+"), lambda p: p != "")
    rows = words.withColumn("parts", parts).where(F.size("parts") > 1)
    rows = rows.withColumn("letters", F.aggregate("parts", F.lit(0), lambda a, p: a + F.length(p)))
    each = rows.select("doc_id", "seq", "hpos", "width", "letters", "parts", F.posexplode("parts").alias("part_no", "part"))
    ahead = F.aggregate(F.slice("parts", 1, F.col("part_no")), F.lit(0), lambda a, p: a + F.length(p))
    return each.select(
        "doc_id", "seq", "part_no", "part",
        (F.col("hpos") + F.floor(F.col("width") * ahead / F.col("letters"))).cast("long").alias("part_hpos"),
        F.floor(F.col("width") * F.length("part") / F.col("letters")).cast("long").alias("part_width"),
    )
