"""Gates that a refined text must pass against its OCR text, and the units of refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx
from ..functions.similarity import indel_ratio_udf

LENGTH_TOLERANCE, NOVEL_SHARE, LEAST_SIMILARITY = 0.15, 0.12, 50.0
TABLE_LINES = 3


def length_gate(out: Column, ocr: Column, tolerance: float = LENGTH_TOLERANCE) -> Column:
    """Struct (ok, word_ratio, char_ratio): both ratios within the tolerance of 1;
    an empty OCR text admits an empty output only."""
    out, ocr = tx.squeezed(out), tx.squeezed(ocr)
    words, chars = F.struct(tx.word_count(out).alias("o"), tx.word_count(ocr).alias("i")), F.struct(F.length(out).alias("o"), F.length(ocr).alias("i"))
    ratio = lambda c: F.when(c["i"] > 0, c["o"] / c["i"]).otherwise(F.lit(0.0))
    ok = lambda c: F.when(c["i"] > 0, (ratio(c) >= 1 - tolerance) & (ratio(c) <= 1 + tolerance)).otherwise(c["o"] == 0)
    return F.struct((ok(words) & ok(chars)).alias("ok"), ratio(words).alias("word_ratio"), ratio(chars).alias("char_ratio"))


def novel_gate(out: Column, ocr: Column, most: float = NOVEL_SHARE) -> Column:
    """Struct (ok, n_novel, novel_ratio): share of the output's distinct words
    that the OCR text, the stop words and plain numbers don't account for."""
    words = tx.word_set(out)
    stop = F.array(*[F.lit(w) for w in tx.STOPWORDS])
    novel = F.size(F.filter(F.array_except(words, tx.word_set(ocr)), lambda w: ~F.array_contains(stop, w) & ~w.rlike(r"^\p{Nd}+$")))
    ratio = F.when(F.size(words) > 0, novel / F.size(words)).otherwise(F.lit(0.0))
    return F.struct((ratio <= most).alias("ok"), novel.alias("n_novel"), ratio.alias("novel_ratio"))


def similarity_gate(out: Column, ocr: Column, least: float = LEAST_SIMILARITY) -> Column:
    """Struct (ok, similarity)."""
    score = indel_ratio_udf(out, ocr)
    return F.struct((score >= least).alias("ok"), score.alias("similarity"))


def all_gates(pairs: DataFrame, out: str, ocr: str) -> DataFrame:
    """``pairs`` with ``ok``, ``reasons`` and ``stats``."""
    rows = pairs.withColumn("__l", length_gate(F.col(out), F.col(ocr))).withColumn("__n", novel_gate(F.col(out), F.col(ocr))).withColumn("__s", indel_ratio_udf(F.col(out), F.col(ocr)))
    similar = F.col("__s") >= LEAST_SIMILARITY
    reasons = F.filter(F.array(F.when(~F.col("__l.ok"), "length"), F.when(~F.col("__n.ok"), "novel words"), F.when(~similar, "similarity")), lambda r: r.isNotNull())
    stats = F.create_map(*[x for k, c in (("word_ratio", "__l.word_ratio"), ("char_ratio", "__l.char_ratio"), ("novel_ratio", "__n.novel_ratio"), ("similarity", "__s")) for x in (F.lit(k), F.col(c))])
    return rows.withColumn("ok", F.size(reasons) == 0).withColumn("reasons", reasons).withColumn("stats", stats).drop("__l", "__n", "__s")


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def table_runs(lines: DataFrame, least: int = TABLE_LINES) -> DataFrame:
    """Runs of table lines: (doc_id, start_line, end_line, n)."""
    order = W.partitionBy("doc_id").orderBy("line")
    rows = lines.withColumn("is_table", tx.table_line(F.col("text")))
    begins = F.when(F.col("is_table") & ~F.coalesce(F.lag("is_table").over(order), F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("run", F.sum(begins).over(order.rowsBetween(W.unboundedPreceding, 0))).where("is_table")
    return rows.groupBy("doc_id", "run").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count("*").alias("n")).where(F.col("n") >= least).drop("run")
