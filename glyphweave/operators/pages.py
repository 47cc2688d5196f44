"""Whole pages as rows: what words and tokens of one page have in common.

A page holds ``words`` (structs with ``seq``), their ``norms``, ``tokens`` (structs
with ``seq``) and their ``token_norms``, each in order. Words meet the tokens of
their own page only, so they meet within its row: nothing is shuffled or sorted
over pages. The norms of some pages at a time are numbered as an Arrow dictionary, and
the rest is arithmetic on these numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Words and tokens that are numbered at a time, which bounds memory; a page is never parted.
AT_ONCE = 200_000


def spread(rows: DataFrame, source: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Rows dealt by page over as many tasks as the session's shuffles have, or more for more
    input, so that what groups by page later needs no shuffle and tasks stay small. Rows that are
    spread like one ``source`` meet without another shuffle."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, 16 * (rows if source is None else source).rdd.getNumPartitions())
    return rows.repartition(n, key)


def gathered(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tables of words and tokens as pages; pages without words have no row."""
    columns = [c for c in words.columns if c not in ("doc_id", "seq", "norm")]
    own = [c for c in tokens.columns if c not in ("doc_id", "seq", "norm")]
    left = words.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.struct("seq", *columns).alias("x"), "norm"))).alias("w"))
    right = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.struct("seq", *own).alias("x"), "norm"))).alias("t"))
    of = lambda c, name: F.coalesce(F.transform(c, lambda x: x[name]), F.array())
    rows = left.join(right, "doc_id", "left")
    return rows.select("doc_id", F.transform("w", lambda x: x["x"]).alias("words"), of("w", "norm").alias("norms"), of("t", "x").alias("tokens"), of("t", "norm").alias("token_norms"))


class Numbered:
    """Words and tokens of some pages: the page and the number of each norm from 1, and
    the number of its form, which is a norm of one page."""

    def __init__(self, words: pa.ListArray, tokens: pa.ListArray, first: int, last: int):
        sides = []
        for a in (words, tokens):
            at = a.offsets.to_numpy()[first : last + 1].astype(np.int64)
            sides.append((a.values.slice(at[0], at[-1] - at[0]), at - at[0]))
        (w, self.word_at), (t, self.token_at) = sides
        coded = pa.concat_arrays([w, t]).dictionary_encode()
        self.dictionary, number = coded.dictionary, coded.indices.fill_null(-1).to_numpy().astype(np.int64) + 1
        self.first, self.last = first, last
        self.n, self.pages, self.base = len(w), last - first, len(self.dictionary) + 1
        self.number = number
        self.page = np.concatenate([np.repeat(np.arange(self.pages), np.diff(at)) for at in (self.word_at, self.token_at)])
        self.forms, self.form = np.unique(self.page * self.base + number, return_inverse=True)

    def neighbours(self) -> np.ndarray:
        """The numbers of both neighbours as one number; a page's edge is 0."""
        sides = []
        for number, at in ((self.number[: self.n], self.word_at), (self.number[self.n :], self.token_at)):
            before, after = np.zeros(len(number) + 1, np.int64), np.zeros(len(number) + 1, np.int64)
            before[1:], after[: len(number)] = number, np.append(number[1:], 0)
            before[at[:-1]] = 0
            after[np.maximum(at[1:] - 1, 0)[np.diff(at) > 0]] = 0
            sides.append(before[:-1] * self.base + after[:-1])
        return np.concatenate(sides)


def numbered(words: pa.ListArray, tokens: pa.ListArray) -> Iterator[Numbered]:
    total = words.offsets.to_numpy().astype(np.int64) + tokens.offsets.to_numpy()
    first = 0
    while first < len(words):
        last = max(first + 1, int(np.searchsorted(total, total[first] + AT_ONCE, "right")) - 1)
        yield Numbered(words, tokens, first, min(last, len(words)))
        first = last


def lists(at: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)


def first_choices(p: Numbered) -> tuple[np.ndarray, np.ndarray]:
    """For each word the token that the first pass over context gives it, among all tokens, or -1; for
    each token whether a word took it."""
    beside = p.neighbours()
    context, number = np.unique(beside, return_inverse=True)
    _, key = np.unique(p.form * len(context) + number, return_inverse=True)
    of_words, of_tokens = key[: p.n], key[p.n :]
    times = np.bincount(of_tokens, minlength=len(key) + 1)
    token_of = np.zeros(len(key) + 1, np.int64)
    token_of[of_tokens] = np.arange(len(of_tokens))
    able = np.flatnonzero((times[of_words] == 1) & (beside[: p.n] != 0))
    got, earliest = np.unique(token_of[of_words[able]], return_index=True)
    token, taken = np.full(p.n, -1), np.zeros(len(of_tokens), bool)
    token[able[earliest]], taken[got] = got, True
    return token, taken


def links(p: Numbered) -> tuple[np.ndarray, ...]:
    """For each word, among all tokens or -1: the token that the first pass gives it, its left and its right neighbour's and
    its page's last; and whether its page has its form."""
    got, page = first_choices(p)[0], p.page[: p.n]
    sides = []
    for step in (-1, 1):
        at = np.arange(p.n) + step
        inside = (at >= p.word_at[page]) & (at < p.word_at[page + 1])
        sides.append(np.where(inside, got[np.clip(at, 0, max(p.n - 1, 0))], -1))
    last = np.where(p.token_at[page + 1] > p.token_at[page], p.token_at[page + 1] - 1, -1)
    return got, *sides, last, np.bincount(p.form[p.n :], minlength=len(p.forms))[p.form[: p.n]] > 0


def between_sides(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The only token between the neighbours' tokens, or -1."""
    return np.where((left >= 0) & (right == left + 2), left + 1, -1)


def each_part(pages: DataFrame, schema: T.StructType, run: Callable[..., list]) -> DataFrame:
    """What ``run`` gives for some pages at a time: the page of each row, then the columns after doc_id."""
    kind = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            doc_id, words, norms, tokens, token_norms = batch.columns
            for p in numbered(norms, token_norms):
                of = lambda a, p=p: a.values.slice(a.offsets[p.first].as_py(), a.offsets[p.last].as_py() - a.offsets[p.first].as_py())
                page, *columns = run(p, of(words), of(norms), of(tokens), of(token_norms))
                columns = [doc_id.slice(p.first, p.pages).take(pa.array(page)), *columns]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return pages.select("doc_id", "words", "norms", "tokens", "token_norms").mapInArrow(batches, schema)


def fields(pages: DataFrame, side: str) -> list[T.StructField]:
    return list(pages.schema[side].dataType.elementType)


def picked(values: pa.Array, k: np.ndarray) -> pa.Array:
    """The values at ``k``, null where that is below 0."""
    return values.take(pa.array(k, pa.int64(), mask=k < 0))


def chosen(pages: DataFrame, gaps: bool = False) -> DataFrame:
    """Each word's columns and norm; of the token that the first pass over context gives it ``tok_seq`` and its other
    columns (``tok_word``); whether its page has its form; the neighbours' tokens and the page's last. With ``gaps``
    also ``gap_word``, the only token's word between the neighbours' tokens."""
    own, clean = fields(pages, "words"), fields(pages, "tokens")
    seq = pages.schema["tokens"].dataType.elementType["seq"].dataType
    schema = T.StructType([pages.schema["doc_id"], *(T.StructField(f.name, f.dataType) for f in own), T.StructField("norm", T.StringType()), *(T.StructField(f"tok_{f.name}", f.dataType) for f in clean), T.StructField("has_candidate", T.BooleanType())])
    for c in ("left_tok", "right_tok", "last_tok"):
        schema = schema.add(c, seq)
    if gaps:
        schema = schema.add("gap_word", T.StringType())

    def run(p: Numbered, words: pa.Array, norms: pa.Array, tokens: pa.Array, _: pa.Array) -> list:
        got, *sides, last, has = links(p)
        between = [picked(tokens.field("word"), between_sides(*sides))] if gaps else []
        return [p.page[: p.n], *words.flatten(), norms, *(picked(c, got) for c in tokens.flatten()), pa.array(has), *(picked(tokens.field("seq"), k) for k in (*sides, last)), *between]

    return each_part(pages, schema, run)


def untaken(pages: DataFrame) -> DataFrame:
    """(doc_id, the token's columns, norm) of the tokens that the first pass gives to no word."""

    def run(p: Numbered, _: pa.Array, __: pa.Array, tokens: pa.Array, norms: pa.Array) -> list:
        free = np.flatnonzero(~first_choices(p)[1])
        return [p.page[p.n :][free], *(picked(c, free) for c in tokens.flatten()), picked(norms, free)]

    schema = T.StructType([pages.schema["doc_id"], *(T.StructField(f.name, f.dataType) for f in fields(pages, "tokens")), T.StructField("norm", T.StringType())])
    return each_part(pages, schema, run)


def known(pages: DataFrame) -> DataFrame:
    """(doc_id, the word's columns, norm) of the words whose form a token of their page has."""

    def run(p: Numbered, words: pa.Array, norms: pa.Array, _: pa.Array, __: pa.Array) -> list:
        held = np.flatnonzero((np.bincount(p.form[p.n :], minlength=len(p.forms)) > 0)[p.form[: p.n]])
        return [p.page[: p.n][held], *(picked(c, held) for c in words.flatten()), picked(norms, held)]

    schema = T.StructType([pages.schema["doc_id"], *(T.StructField(f.name, f.dataType) for f in fields(pages, "words")), T.StructField("norm", T.StringType())])
    return each_part(pages, schema, run)


def shared_forms(pages: DataFrame) -> DataFrame:
    """(doc_id, norm, seqs, tok_seqs) of the forms that a page's words and tokens share."""

    def run(p: Numbered, words: pa.Array, _: pa.Array, tokens: pa.Array, __: pa.Array) -> list:
        sides = [p.form[: p.n], p.form[p.n :]]
        counts = [np.bincount(form, minlength=len(p.forms)) for form in sides]
        both = (counts[0] > 0) & (counts[1] > 0)
        columns = [p.forms[both] // p.base, p.dictionary.take(pa.array(p.forms[both] % p.base - 1))]
        for form, count, rows in zip(sides, counts, (words, tokens), strict=True):
            order = np.argsort(form, kind="stable")
            columns.append(lists(np.append(0, np.cumsum(count[both])), rows.field("seq").take(pa.array(order[both[form[order]]]))))
        return columns

    seqs = [T.StructField(name, T.ArrayType(pages.schema[side].dataType.elementType["seq"].dataType)) for name, side in (("seqs", "words"), ("tok_seqs", "tokens"))]
    return each_part(pages, T.StructType([pages.schema["doc_id"], T.StructField("norm", T.StringType()), *seqs]), run)
