"""Pages that arrive as files are aligned as they come.

Words and clean text are matched by the file's stem. Every micro-batch aligns
its own pages; results go to a sink that overwrites by batch, so that a batch
that runs again writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..plans.align import align
from ..sources import hocr
from ..sources.files import page_name

FILES = "path string, modificationTime timestamp, length long, content binary"
MOST = 1000  # files in a batch


def aligned_pages(spark: SparkSession, markup_dir: str, clean_dir: str, out: str, checkpoint: str, cutoff: float = 60.0) -> StreamingQuery:
    """Start a query over hOCR files in ``markup_dir`` (plain or gzip); of the clean
    texts in ``clean_dir`` only those of a batch's pages are read. Pages whose text
    isn't there yet are listed in ``out``/_waiting, and tried again in later batches."""
    arriving = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", MOST).load(markup_dir)

    def batch(files: DataFrame, number: int) -> None:
        paths = [r.path for r in files.select("path").collect()] + waiting(spark, out, number)  # MOST names, and those that wait
        if not paths:
            return
        pages = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("markup"))  # undoes gzip
        pages = pages.withColumn("doc_id", F.xxhash64(page_name(F.col("path"))))
        names = sorted({p.rsplit("/", 1)[-1].split(".")[0] for p in paths})
        texts = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(names) + "}.*").load(clean_dir)
        clean = texts.select(F.xxhash64(page_name(F.col("path"))).alias("doc_id"), F.decode("content", "UTF-8").alias("text"))
        here = pages.join(clean.select("doc_id"), "doc_id", "left_semi")
        pages.join(clean.select("doc_id"), "doc_id", "left_anti").select("path").write.mode("overwrite").parquet(f"{out}/_waiting/batch={number}")
        tokens = clean.select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("seq", "word"))
        sizes = hocr.page_sizes(here).select("doc_id", F.col("height").alias("page_height"))
        align(hocr.words(here).join(sizes, "doc_id", "left"), tokens, cutoff).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def waiting(spark: SparkSession, out: str, number: int) -> list[str]:
    """Files that the batch before left without a text."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_waiting/batch={number - 1}")
    if number == 0 or not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return []
    return [r.path for r in spark.read.parquet(f"{out}/_waiting/batch={number - 1}").collect()]
