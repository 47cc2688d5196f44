"""Files of pages: discovery, order, clean texts, and recognition by outside programs."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def natural_order(path: Column) -> tuple[Column, Column]:
    """Shorter names first, so that page-2 comes before page-10."""
    name = stem(path)
    return F.length(name), name


def page_name(path: Column) -> Column:
    """A page's name: its file's, up to the first full stop."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def ranked(rows: DataFrame, place: str, *keys: Column) -> DataFrame:
    """``rows`` with their place by ``keys``, the first two of them a length and a
    text. Counts of their beginnings are added up first, so that no task sorts all rows."""
    from pyspark.sql.window import Window as W

    rows = rows.withColumns({"__n": keys[0], "__head": F.substring(keys[1], 1, 8)})
    heads = rows.groupBy("__n", "__head").agg(F.count("*").alias("__in"))
    ahead = F.coalesce(F.sum("__in").over(W.orderBy("__n", "__head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("__n", "__head").orderBy(*keys))
    placed = rows.join(heads.withColumn("__ahead", ahead), ["__n", "__head"])
    return placed.withColumn(place, (own + F.col("__ahead")).cast("int")).drop("__n", "__head", "__in", "__ahead")


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, stem) of the page files below a folder, each document by itself:
    its folder ``alto`` if that holds XML, else its folder ``hocr``, else hOCR files beside these."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    parent, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    page = name.rlike(r"\.hocr(\.html?)?(\.gz)?$|\.html?(\.gz)?$")
    rank = F.when(parent.endswith("/alto") & name.endswith(".xml"), 0).when(parent.endswith("/hocr") & page, 1).when(name.endswith(".xml"), 2).when(page & name.contains("hocr"), 3)
    rows = files.withColumn("rank", rank).where("rank is not null")
    rows = rows.withColumn("document", F.when(F.col("rank") < 2, F.regexp_extract(parent, r"^(.*)/[^/]*$", 1)).otherwise(parent))
    best = rows.groupBy("document").agg(F.min("rank").alias("rank"))
    rows = rows.join(best, ["document", "rank"]).withColumn("kind", F.when(F.col("rank") % 2 == 0, "alto").otherwise("hocr"))
    return rows.select("path", "kind", stem(F.col("path")).alias("stem")).orderBy(*natural_order(F.col("path")))


def clean_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): whole files; the id is a hash of the stem."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(stem(F.input_file_name())).alias("doc_id"), F.col("value").alias("text"))


def clean_file_tokens(spark: SparkSession, path: str) -> DataFrame:
    rows = clean_texts(spark, path).select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("seq", "word"))
    return rows.withColumn("norm", tx.normalized(F.col("word")))


def recognised(spark: SparkSession, images: str, language: str = "eng", layout: int = 3, program: str = "tesseract") -> DataFrame:
    """(path, markup): hOCR of page images by an outside program, which must be
    on every worker; images spread over the cluster one by one."""
    if shutil.which(program) is None:
        raise FileNotFoundError(f"{program} isn't installed")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with tempfile.TemporaryDirectory() as d:  # scratch of one image, gone with it
                    image = Path(d, "page" + Path(path).suffix)
                    image.write_bytes(content)
                    done = subprocess.run([program, str(image), "stdout", "-l", language, "--psm", str(layout), "hocr"], capture_output=True, check=True)
                    out.append((path, done.stdout.decode()))
            yield pd.DataFrame(out, columns=["path", "markup"])

    return spark.read.format("binaryFile").load(images).select("path", "content").mapInPandas(run, "path string, markup string")
