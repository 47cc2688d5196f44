"""Words broken by hyphens: pairs over a line end, and word-hyphen-word triplets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx
from ..sources.derived import Read
from .pages import known
from .words import reading


def broken_words(tokens: DataFrame, every: int = 19, shortest: int = 6) -> DataFrame:
    """A made OCR line where every n-th long token is broken into two with a hyphen:
    (doc_id, seq, part_no, content), in order."""
    broken = (F.col("seq") % every == 0) & (F.length("word") >= shortest)
    parts = F.when(broken, F.array(F.concat(F.expr("substring(word, 1, cast(floor(length(word) / 2) as int))"), F.lit("-")), F.expr("substring(word, cast(floor(length(word) / 2) as int) + 1)"))).otherwise(F.array("word"))
    return tokens.select("doc_id", "seq", F.posexplode(parts).alias("part_no", "content"))


def merged_pairs(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """Hyphen-ended words that make a clean word of their page with the word
    after them, without the hyphen or with it: (doc_id, seq, part_no, merged, kept_hyphen)."""
    line = W.partitionBy("doc_id").orderBy("seq", "part_no")
    rows = words.withColumn("following", F.lead("content").over(line)).where(tx.hyphen_ended(F.col("content")) & F.col("following").isNotNull())
    stem, after = tx.normalized(F.regexp_replace("content", r"[-—]+\s*$", "")), tx.normalized(F.col("following"))
    forms = F.array(F.struct(F.lit(0).alias("o"), F.concat(stem, after).alias("norm")), F.struct(F.lit(1).alias("o"), F.concat(stem, F.lit("-"), after).alias("norm")))
    each = rows.select("doc_id", "seq", "part_no", F.inline(forms))
    vocab = tokens.select("doc_id", "norm").distinct()
    best = each.join(vocab, ["doc_id", "norm"]).groupBy("doc_id", "seq", "part_no").agg(F.min(F.struct("o", "norm")).alias("b"))
    return best.select("doc_id", "seq", "part_no", F.col("b.norm").alias("merged"), (F.col("b.o") == 1).alias("kept_hyphen"))


#: A page's tokens, and what its words that end in a hyphen are followed by.
PAIRS = "words array<string>, pairs array<struct<seq:int,part_no:int,content:string,following:string>>"


def broken_pairs(r: Read, every: int = 19, shortest: int = 6) -> Iterator[tuple]:
    """Of the parts that ``broken_words`` gives, those that end in a hyphen and the ones after them: the pages that
    have any, then the columns of ``PAIRS``."""
    broken = np.flatnonzero((r.seq % every == 0) & (pc.utf8_length(r.tokens).to_numpy() >= shortest))
    whole = r.tokens.take(pa.array(broken)).to_pylist()
    halves = [pa.array([f(w, len(w) // 2) for w in whole], pa.string()) for f in (lambda w, k: w[:k] + "-", lambda w, k: w[k:])]
    times = np.ones(len(r.seq), np.int64)
    times[broken] = 2
    token = np.repeat(np.arange(len(r.seq)), times)
    part = np.append(False, token[1:] == token[:-1]).astype(int)[: len(token)]
    place = token.copy()
    for no, half in enumerate(halves):
        place[np.flatnonzero((times[token] == 2) & (part == no))] = len(r.seq) + no * len(broken) + np.arange(len(half))
    content = pa.concat_arrays([r.tokens, *halves]).take(pa.array(place))
    # the end is that of Java, before a last line's end as well
    ended = pc.match_substring_regex(content, r"[-—][\t-\r ]*[\x{85}\x{2028}\x{2029}]?$").to_numpy(zero_copy_only=False)
    page = r.page[token]
    at = np.flatnonzero(ended[:-1] & (page[1:] == page[:-1])) if len(page) else np.zeros(0, np.int64)
    own, first = np.unique(page[at], return_index=True)
    if not len(own):
        return
    pairs = pa.StructArray.from_arrays([pa.array(r.seq[token[at]]), pa.array(part[at].astype(np.int32)), content.take(pa.array(at)), content.take(pa.array(at + 1))], ["seq", "part_no", "content", "following"])
    words = pa.ListArray.from_arrays(pa.array(r.at, pa.int32()), r.tokens).take(pa.array(own))
    yield own, words, pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pairs)


def merged_within(pages: DataFrame) -> DataFrame:
    """``merged_pairs`` for pages (doc_id, words, pairs), whose pairs meet their tokens within their row."""

    def forms(p: Column) -> Column:
        stem, after = tx.normalized(F.regexp_replace(p["content"], r"[-—]+\s*$", "")), tx.normalized(p["following"])
        return F.array(F.concat(stem, after), F.concat(stem, F.lit("-"), after))

    def places(p: Column) -> Column:
        return F.array(*(F.struct(p["seq"].alias("seq"), p["part_no"].alias("part_no"), F.lit(o).alias("o")) for o in (0, 1)))

    norms = F.transform("words", tx.normalized)
    tokens = F.transform("words", lambda _, k: F.struct(k.alias("seq")))
    found = known(pages.select("doc_id", F.flatten(F.transform("pairs", places)).alias("words"), F.flatten(F.transform("pairs", forms)).alias("norms"), tokens.alias("tokens"), norms.alias("token_norms")))
    best = found.groupBy("doc_id", "seq", "part_no").agg(F.min(F.struct("o", "norm")).alias("b"))
    return best.select("doc_id", "seq", "part_no", F.col("b.norm").alias("merged"), (F.col("b.o") == 1).alias("kept_hyphen"))


def triplets(tokens: DataFrame) -> DataFrame:
    """Three tokens in a row whose middle one is a lone hyphen: (doc_id, seq, left_word, right_word)."""
    rows = tokens.select("doc_id", "seq", "word", F.lead("word", 1).over(reading()).alias("middle"), F.lead("word", 2).over(reading()).alias("right_word"))
    return rows.where(F.col("middle").isin("-", "–", "—") & F.col("right_word").isNotNull()).select("doc_id", "seq", F.col("word").alias("left_word"), "right_word")


def with_triplets(tokens: DataFrame, every: int = 23) -> DataFrame:
    """Clean tokens where every n-th is followed by a lone hyphen, renumbered."""
    parts = F.when(F.col("seq") % every == 0, F.array(F.col("word"), F.lit("-"))).otherwise(F.array("word"))
    rows = tokens.select("doc_id", "seq", F.posexplode(parts).alias("part_no", "word"))
    return rows.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("seq", "part_no")) - 1).alias("seq"), "word")


def split_boxes(words: DataFrame) -> DataFrame:
    """Boxes of a word with an inner hyphen as word, hyphen, word: widths by
    share of characters, gaps of 1 % (2 px at least), a hyphen of 5 px at least."""
    rows = words.where(tx.inner_hyphen(F.col("content"))).withColumn("left_part", F.regexp_extract("content", r"^([^-—]+)[-—]+(.+)$", 1)).withColumn("right_part", F.regexp_extract("content", r"^([^-—]+)[-—]+(.+)$", 2))
    rows = rows.where("left_part <> '' and right_part <> ''")
    gap = F.greatest(F.lit(2), F.floor(F.col("width") * 0.01))
    share = F.col("width") / F.length("content")
    left = F.floor(share * F.length("left_part"))
    hyphen = F.greatest(F.lit(5), F.floor(share))
    return rows.select(
        "doc_id", "seq", F.col("hpos").cast("long").alias("left_hpos"), left.cast("long").alias("left_width"), (F.col("hpos") + left + gap).cast("long").alias("hyphen_hpos"), hyphen.cast("long").alias("hyphen_width"),
        (F.col("hpos") + left + hyphen + 2 * gap).cast("long").alias("right_hpos"), F.floor(share * F.length("right_part")).cast("long").alias("right_width"),
    )
