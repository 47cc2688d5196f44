"""OCR pages made from clean documents by fixed rules, for tables that have no scans.

A document is a page. Its tokens get recognition errors by their position
(every 17th takes the next token on with a star, every 11th loses its last
character, every 7th has its first ``e`` read as ``c``), a box on a grid of
ten words a line and 25 lines a column, and a confidence.

The rules have two forms: column expressions, and ``Read``, whole columns of some
pages at a time, for what works within a page's row and would otherwise sort words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as tx

WORDS_A_LINE, LINES_A_COLUMN = 10, 25
CHAR, LINE, COLUMN, HEIGHT = 12, 40, 1000, 30


def clean_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, seq, word, norm) of all tokens in order."""
    rows = docs.select("doc_id", F.posexplode(tx.tokens(F.col(text))).alias("seq", "word"))
    return rows.withColumn("norm", tx.normalized(F.col("word")))


def page_words(docs: DataFrame) -> DataFrame:
    """(doc_id, clean, read): a page's tokens, and what recognition made of them, made within the page's row."""
    rows = docs.select("doc_id", tx.tokens(F.col("text")).alias("clean"))

    def content(word, i):
        following = F.get(F.col("clean"), i + 1)
        at = F.instr(word, F.lit("e"))
        misread = F.when(at > 0, F.concat(F.substring(word, F.lit(1), at - 1), F.lit("c"), F.substring(word, at + 1, F.length(word)))).otherwise(word)
        return (
            F.when((i % 17 == 0) & following.isNotNull(), F.concat(word, F.lit("*"), following))
            .when((i % 11 == 0) & (F.length(word) > 1), F.substring(word, F.lit(1), F.length(word) - 1))
            .when(i % 7 == 0, misread)
            .otherwise(word)
        )

    return rows.select("doc_id", "clean", F.transform("clean", content).alias("read"))


def boxes(rows: DataFrame, *more: str) -> DataFrame:
    """Adds line, block and box to words (seq, content, before), where ``before`` counts what stands before a word on its line."""
    line = F.floor(F.col("seq") / WORDS_A_LINE).cast("int")
    rows = rows.withColumn("line_seq", line).withColumn("block_seq", F.floor(line / LINES_A_COLUMN).cast("int"))
    return rows.select(
        "doc_id", "seq", "line_seq", "block_seq", "content", tx.normalized(F.col("content")).alias("norm"), (COLUMN * F.col("block_seq") + CHAR * F.col("before")).cast("int").alias("hpos"),
        (LINE * (F.col("line_seq") % LINES_A_COLUMN)).alias("vpos"), (CHAR * F.length("content")).alias("width"), F.lit(HEIGHT).alias("height"), (40 + (F.col("seq") * 7) % 60).alias("wc"), *more,
    )


def ahead(line, i):
    """Characters and blanks before the i-th word of a line."""
    return F.aggregate(F.slice(line, F.lit(1), i), F.lit(0), lambda n, w: n + F.length(w) + 1)


def ocr_words(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, line_seq, block_seq, content, norm, hpos, vpos, width, height, wc)."""
    rows = page_words(docs).where(F.size("clean") > 0)
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size("read") - 1) / WORDS_A_LINE).cast("int")), lambda k: F.slice("read", k * WORDS_A_LINE + 1, WORDS_A_LINE))
    each = rows.select("doc_id", F.posexplode(lines).alias("no", "line"))
    each = each.select("doc_id", "no", "line", F.posexplode("line").alias("i", "content"))
    return boxes(each.select("doc_id", (F.col("no") * WORDS_A_LINE + F.col("i")).alias("seq"), "content", ahead(F.col("line"), F.col("i")).alias("before")))


def pages(docs: DataFrame) -> DataFrame:
    """Pages as ``operators.pages`` takes them; their words lack boxes, which ``boxes`` adds."""

    def word(content, i):
        place = (i % WORDS_A_LINE).cast("int")
        return F.struct(i.alias("seq"), content.alias("content"), ahead(F.slice("read", i - place + 1, WORDS_A_LINE), place).alias("before"))

    return page_words(docs).select(
        "doc_id", F.transform("read", word).alias("words"), F.transform("read", tx.normalized).alias("norms"),
        F.transform("clean", lambda x, i: F.struct(i.alias("seq"), x.alias("word"))).alias("tokens"), F.transform("clean", tx.normalized).alias("token_norms"),
    )


def forms(docs: DataFrame) -> DataFrame:
    """The same with the words' and tokens' places only, for what asks for forms."""
    place = lambda _, i: F.struct(i.alias("seq"))
    return page_words(docs).select(
        "doc_id", F.transform("read", place).alias("words"), F.transform("read", tx.normalized).alias("norms"),
        F.transform("clean", place).alias("tokens"), F.transform("clean", tx.normalized).alias("token_norms"),
    )


class Read:
    """Words of some pages in order: tokens, contents and boxes; page k's stand from ``at[k]`` to ``at[k + 1]``."""

    def __init__(self, texts: pa.Array):
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        real = pc.not_equal(parts.values, "")
        self.tokens = parts.values.filter(real)
        self.at = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[parts.offsets.to_numpy()]
        n = len(self.tokens)
        self.page = np.repeat(np.arange(len(texts)), np.diff(self.at))
        self.seq = (np.arange(n) - self.at[self.page]).astype(np.int32)
        self.line, self.wc = self.seq // WORDS_A_LINE, 40 + (self.seq * 7) % 60
        self.block = self.line // LINES_A_COLUMN
        self.content = self.read()
        self.length = pc.utf8_length(self.content).to_numpy()
        ahead = np.append(0, np.cumsum(self.length + 1, dtype=np.int64))
        first = np.arange(n) - self.seq % WORDS_A_LINE
        self.hpos = (COLUMN * self.block + CHAR * (ahead[:-1] - ahead[first])).astype(np.int32)
        self.vpos, self.width, self.height = LINE * (self.line % LINES_A_COLUMN), CHAR * self.length, np.full(n, HEIGHT, np.int32)

    def read(self) -> pa.Array:
        """What recognition made of the tokens."""
        last = np.zeros(len(self.seq), bool)
        last[self.at[1:][np.diff(self.at) > 0] - 1] = True
        joined = (self.seq % 17 == 0) & ~last
        cut = ~joined & (self.seq % 11 == 0) & (pc.utf8_length(self.tokens).to_numpy() > 1)
        misread = ~joined & ~cut & (self.seq % 7 == 0)
        of = lambda mask, step=0: self.tokens.take(pa.array(np.flatnonzero(mask) + step))
        content = self.tokens
        for mask, made in (
            (joined, pc.binary_join_element_wise(of(joined), of(joined, 1), "*")),
            (cut, pc.utf8_slice_codeunits(of(cut), 0, -1)),
            (misread, pc.replace_substring(of(misread), "e", "c", max_replacements=1)),
        ):
            content = pc.replace_with_mask(content, pa.array(mask), made)
        return content


#: Bytes of text that ``each_read`` takes at a time, which bounds memory; a page is never parted.
AT_ONCE = 200_000


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of rows that have about ``most`` bytes in all."""
    ends = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield first, last - first
        first = last


def sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def each_page(pages: DataFrame, column: str, schema: str, run: Callable[[pa.Array], Iterator[tuple]]) -> DataFrame:
    """What ``run`` gives for a column of some pages, in parts: the page of each row, then the columns of
    ``schema``, which follow doc_id."""
    kind = T.StructType([pages.schema["doc_id"], *T._parse_datatype_string(schema)])
    to = to_arrow_schema(kind)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            doc_id, values = batch.columns
            for page, *columns in run(values):
                columns = [doc_id.take(pa.array(page)), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, to, strict=True)], schema=to)

    return pages.select("doc_id", column).mapInArrow(batches, kind)


def each_read(docs: DataFrame, schema: str, run: Callable[[Read], Iterator[tuple]]) -> DataFrame:
    """The same for the words of texts."""

    def parts(texts: pa.Array) -> Iterator[tuple]:
        for first, n in slices(sizes(texts), AT_ONCE):
            for page, *columns in run(Read(texts.slice(first, n))):
                yield page + first, *columns

    return each_page(docs, "text", schema, parts)


def conversation_texts(turns: DataFrame) -> DataFrame:
    """(doc_id, text): the turns of a conversation as paragraphs, each under a tag line with its role."""
    one = F.struct("turn", F.concat(F.lit("["), F.upper("role"), F.lit("]\n"), "text").alias("t"))
    joined = turns.where("text is not null").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return joined.select("doc_id", F.array_join(F.transform("turns", lambda x: x["t"]), "\n\n").alias("text"))
