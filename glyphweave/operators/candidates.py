"""Candidates of OCR words among the clean words of their page."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.similarity import word_ratios
from .pages import Numbered, each_part, gathered, picked, shared_forms


def by_page(rows: DataFrame):
    """Grouped by page, over as many tasks as the session's shuffles have: what
    Python does with a page outweighs its bytes, by which Spark would join partitions."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    # new names, as both sides of a co-group may come from one table
    return rows.toDF(*rows.columns).repartition(n, "doc_id").groupBy("doc_id")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(doc_id, norm, n, first_seq): a page's distinct clean words."""
    return tokens.groupBy("doc_id", "norm").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def exact_candidates(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, seq, norm, n_tokens) of words that stand in the page's vocabulary."""
    return exact_of(shared_forms(gathered(words.select("doc_id", "seq", "norm"), tokens.select("doc_id", "seq", "norm"))))


def exact_of(forms: DataFrame) -> DataFrame:
    """The same from the forms that words and tokens share."""
    return forms.select("doc_id", F.explode("seqs").alias("seq"), "norm", F.size("tok_seqs").cast("long").alias("n_tokens"))


def fuzzy_candidates(words: DataFrame, tokens: DataFrame, cutoff: float) -> DataFrame:
    """(doc_id, norm, clean_form, score, first_seq): for each distinct word, its
    exact clean word at 100, or else all clean words of the page at or above
    the cutoff. Pages meet their own vocabulary only."""
    seq = "seq" if "seq" in words.columns else F.lit(0).alias("seq")
    return fuzzy_of(gathered(words.select("doc_id", seq, "norm"), tokens.select("doc_id", "seq", "norm")), cutoff)


def similar_forms(p: Numbered, cutoff: float, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(form of words, form of tokens, score, first token): the forms of a page that are equal
    or, for words that no token equals, similar; the best one only, if asked for."""
    words, tokens = p.form[: p.n], p.form[p.n :]
    known = p.forms % p.base > 0  # not null
    has = np.bincount(words, minlength=len(p.forms)) > 0
    first = np.full(len(p.forms), -1)
    first[tokens[::-1]] = np.arange(len(tokens))[::-1]
    equal = np.flatnonzero(known & has & (first >= 0))
    out = [(equal, equal, np.full(len(equal), 100.0))]
    text = p.dictionary.to_pylist()
    of = lambda forms: [text[k] for k in (p.forms[forms] % p.base - 1).tolist()]
    at = np.searchsorted(p.forms, np.arange(p.pages + 1) * p.base)
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        one = slice(low, high)
        rest, vocab = low + np.flatnonzero(known[one] & has[one] & (first[one] < 0)), low + np.flatnonzero(known[one] & (first[one] >= 0))
        i, j, score = word_ratios(of(rest), of(vocab), cutoff)
        i, j = rest[i], vocab[j]
        if best:
            order = np.lexsort((first[j], -score, i))
            order = order[np.diff(i[order], prepend=-1) > 0]
            i, j, score = i[order], j[order], score[order]
        out.append((i, j, score))
    left, right, score = (np.concatenate(x) for x in zip(*out, strict=True))
    return left, right, score, first[right]


def fuzzy_of(pages: DataFrame, cutoff: float, best: bool = False) -> DataFrame:
    """The same for pages; with ``best`` the first candidate of each word only."""

    def run(p: Numbered, _: pa.Array, __: pa.Array, tokens: pa.Array, ___: pa.Array) -> list:
        left, right, score, first = similar_forms(p, cutoff, best)
        form = lambda f: p.dictionary.take(pa.array(p.forms[f] % p.base - 1))
        return [p.forms[left] // p.base, form(left), form(right), pa.array(score), picked(tokens.field("seq"), first)]

    text = [T.StructField(c, T.StringType()) for c in ("norm", "clean_form")]
    return each_part(pages, T.StructType([pages.schema["doc_id"], *text, T.StructField("score", T.DoubleType()), T.StructField("first_seq", T.LongType())]), run)


def scored_words(pages: DataFrame, cutoff: float) -> DataFrame:
    """(doc_id, score, n): words of a page by the score of their best candidate, 0 if there is none."""

    def run(p: Numbered, _: pa.Array, __: pa.Array, ___: pa.Array, ____: pa.Array) -> list:
        left, _, score, _ = similar_forms(p, cutoff, True)
        of_form = np.zeros(len(p.forms))
        of_form[left] = score
        n = np.bincount(p.form[: p.n], minlength=len(p.forms))
        some = np.flatnonzero(n)
        page = p.forms[some] // p.base
        pairs, row = np.unique(np.stack([page, of_form[some]]), axis=1, return_inverse=True)
        count = np.bincount(row.ravel(), n[some], minlength=pairs.shape[1]).astype(np.int64)
        return [pairs[0].astype(np.int64), pa.array(pairs[1]), pa.array(count)]

    return each_part(pages, T.StructType([pages.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("n", T.LongType())]), run)


def best_matches(candidates: DataFrame) -> DataFrame:
    """The first candidate of each word: highest score, then earliest in the clean text."""
    order = W.partitionBy("doc_id", "norm").orderBy(F.col("score").desc(), "first_seq", "clean_form")
    return candidates.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def accuracy_buckets(words: DataFrame, best: DataFrame) -> DataFrame:
    """Words by their best score: exact, 80 to below 100, below 80."""
    joined = words.join(best.select("doc_id", "norm", "score"), ["doc_id", "norm"], "left")
    return buckets(joined.select("score", F.lit(1).alias("n")))


def buckets(scored: DataFrame) -> DataFrame:
    """The same of scores and how many words have them."""
    score = F.coalesce("score", F.lit(0.0))
    bucket = F.when(score >= 100, "exact").when(score >= 80, "close").otherwise("far")
    counted = scored.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(whole), 6))  # three rows


def candidate_tokens(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, norm, seqs, tok_seqs): the words of a form and the tokens of that
    form on their page. Every word of a row goes with every token of it; the
    pairs themselves aren't made."""
    return shared_forms(gathered(words.select("doc_id", "seq", "norm"), tokens.select("doc_id", "seq", "norm")))
