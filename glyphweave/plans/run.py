"""From page files to aligned pages, in one call each: recognise, clean, align, all.

Files of a page share their name up to the first full stop. Results are Parquet
tables in the folder given, so that a step that is run again overwrites its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.words import prepared_tokens
from ..sources import alto, files, hocr, sinks
from .align import align, quality
from .page import CUTOFF
from .refine import identity, refined_documents


def key(path: str = "path"):
    return F.xxhash64(files.page_name(F.col(path)))


def recognise(spark: SparkSession, images: str, out: str, **options) -> DataFrame:
    """Images to (path, markup) in ``out``."""
    files.recognised(spark, images, **options).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def clean(spark: SparkSession, texts: str, out: str, refiner: Callable[[str], str] = identity, page_mode: bool = True, rounds: int = 6) -> DataFrame:
    """Text files to (doc_id, text) in ``out``."""
    read = spark.read.text(texts, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    refined_documents(read.select(key().alias("doc_id"), "text"), refiner, rounds, page_mode).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def align_pages(spark: SparkSession, paths: list[str], kind: str, texts: DataFrame, out: str, cutoff: float = CUTOFF) -> DataFrame:
    """Page files of one kind and (doc_id, text) to aligned words, and to the page
    files' markup with the new words, in ``out``."""
    pages = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("markup")).withColumn("doc_id", key())
    if kind == "alto":
        sizes = pages.select("doc_id", F.regexp_extract("markup", r"""<(?:\w+:)?Page\b[^>]*\bHEIGHT=["'](\d+)""", 1).try_cast("int").alias("page_height"))
        words = alto.marked_strings(pages).withColumn("block_seq", F.lit(0)).withColumnRenamed("line_no", "line_seq")
    else:
        sizes = hocr.page_sizes(pages).select("doc_id", F.col("height").alias("page_height"))
        words = hocr.words(pages)
    aligned = align(words.join(sizes, "doc_id", "left"), prepared_tokens(texts), cutoff)
    aligned.write.mode("overwrite").parquet(f"{out}/words")
    aligned = spark.read.parquet(f"{out}/words")
    (sinks.updated_alto if kind == "alto" else sinks.updated_hocr)(pages.select("doc_id", "markup"), aligned).write.mode("overwrite").parquet(f"{out}/markup")
    return aligned


def run_all(spark: SparkSession, folder: str, out: str, refiner: Callable[[str], str] = identity, cutoff: float = CUTOFF) -> DataFrame:
    """Cleans the folder's page texts (NAME.txt) and aligns its page files with them;
    returns the quality of each page. Page files that can't be found are an error."""
    found = files.page_files(spark, folder).collect()  # names of a document's pages
    kinds = {r.kind for r in found}
    if len(kinds) != 1:
        raise ValueError(f"the folder holds {'no page files' if not kinds else 'documents of several kinds'}")
    texts = clean(spark, f"{folder}/*.txt", f"{out}/clean", refiner)
    return quality(align_pages(spark, [r.path for r in found], kinds.pop(), texts, out, cutoff), "doc_id")
