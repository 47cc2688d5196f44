"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. Its features (shares of letters, capitals,
digits, signs, separators and exclamation marks, word lengths, repeated words,
repeated lines) and those of the lines before and after it, each cut into bins
at quantiles, give the emission scores; a table of transitions links
neighbours. Forward-backward gives each line's marginal; marginals weighted by
line length aggregate into the share of good text, which a logistic curve
calibrates to the probability of quality label 1.

Labels stand for whole documents, so lines are labelled in rounds: first all
lines as their document; then a bad document's lines that the model finds good
become good, except its worst one.

Learning uses at most ``SAMPLE`` labelled documents, the first by a hash of
doc_id, whole, as long as they have at most ``LINES`` lines together (one that
alone has more is left out). Scoring reads whole texts in one pass without a
shuffle; a long text is held in its task alone.

Defined results: null and empty texts are one empty line and get a score like
any other; repeated rows are scored each; of rows that share a labelled doc_id one
is learned from, the least by its features, and of several labels the largest
counts; without labels of both kinds every score is 0.5, and no document is
rejected; a score at the threshold is good; an empty table gives no rows; columns
of any name pass through, but for one named like the result, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sieve import numbered
from .storage import documents, lean, small_batches, written
from .words import BLOCK, BYTE_VALUES, mix, powers

SAMPLE = 6000
LINES = 300_000
BINS = 8
THRESHOLD = 0.7
NAMES = ("length", "words", "word_length", "capital", "digit", "sign", "separator", "loud", "repeated_word", "stop", "seen_line", "short_word")

SIGNS, SEPARATORS, STOPS = b"#$%&*+/<=>@\\^_`{}~", b"|", b".,;:"


def line_features(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, lines of each, features by line, line lengths), block by block."""
    first, part, size = 0, [], 0
    for text in texts:
        raw = (text or "").encode()
        part.append(raw)
        size += len(raw) + 1
        if size >= BLOCK:
            yield (first, len(part), *_features(part))
            first, part, size = first + len(part), [], 0
    if part:
        yield (first, len(part), *_features(part))


def _class(chars: bytes | range) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[list(chars)] = 1
    return table


CLASSES = np.stack([_class(range(65, 91)), _class(range(48, 58)), _class(SIGNS), _class(SEPARATORS), _class(b"!"), _class(STOPS)])


def _features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)
    feed = np.flatnonzero(data == 10)
    begin, end = feed[:-1] + 1, feed[1:]
    lines = np.array([r.count(b"\n") + 1 for r in raws], np.int64)
    n = len(begin)
    length = end - begin
    # words, and whether a word equals the one before it in its line
    blank = (data == 32) | (data == 10) | (data == 9) | (data == 13) | (data == 11) | (data == 12)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    wb, we = edge[0::2], edge[1::2]
    up, down = powers(len(data))
    sums = np.cumsum(BYTE_VALUES[data] * up[: len(data)])
    word = (sums[we - 1] - sums[wb - 1]) * down[wb]
    word_at = np.searchsorted(wb, begin)
    n_words = np.diff(np.append(word_at, len(wb)))
    line_of = np.repeat(np.arange(n), n_words)
    same = np.zeros(len(word), np.int64)
    same[1:] = (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])
    short = np.bincount(line_of, we - wb <= 3, n)
    repeated = np.bincount(line_of, same, n)
    letters = np.bincount(line_of, we - wb, n)
    # lines of over three words that their text had before
    doc_of = np.repeat(np.arange(len(raws)), lines)
    line = mix((sums[np.maximum(end - 1, 0)] - sums[begin - 1]) * down[begin]) ^ mix(doc_of.astype(np.uint64) + np.uint64(1))
    order = np.lexsort((np.arange(n), line))
    seen = np.zeros(n, bool)
    seen[order[1:]] = line[order[1:]] == line[order[:-1]]
    seen &= n_words > 3
    shares = [np.add.reduceat(c[data], np.append(begin, len(data) - 1))[:-1] * (length > 0) for c in CLASSES]
    capital, digit, sign, separator, loud, stop = (s / np.maximum(length, 1) for s in shares)
    per_word = np.maximum(n_words, 1)
    columns = [np.log1p(length), np.log1p(n_words), letters / per_word, capital, digit, sign, separator, loud, repeated / per_word, stop, seen, short / per_word]
    return lines, np.stack(columns, 1).astype(np.float32), length


def bin_edges(x: np.ndarray) -> np.ndarray:
    """Cut points by feature: quantiles of what isn't 0, so that 0 has a bin."""
    edges = np.full((x.shape[1], BINS - 1), np.inf, np.float32)
    for f in range(x.shape[1]):
        some = x[:, f][x[:, f] > 0]
        if len(some):
            cut = np.unique(np.append(1e-9, np.quantile(some, np.arange(1, BINS - 1) / (BINS - 1)))).astype(np.float32)
            edges[f, : len(cut)] = cut
    return edges


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Cell of each feature in the weight table: feature * BINS + bin."""
    return np.stack([np.searchsorted(edges[f], x[:, f], side="left") + f * BINS for f in range(x.shape[1])], 1)


class Chains:
    """Chains of lines in order of falling length, for steps over all at once."""

    def __init__(self, lines: np.ndarray):
        self.order = np.argsort(-lines, kind="stable")
        self.length = lines[self.order]
        self.start = (np.cumsum(lines) - lines)[self.order]
        self.n = int(lines.sum())
        steps = int(self.length[0]) if len(lines) else 0
        self.active = np.searchsorted(-self.length, -np.arange(steps), side="left")

    def marginals(self, emit: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability that a line is good, and expected counts of transitions.

        ``emit``: score of good against bad by line; ``link``: (2, 2) scores."""
        potential = np.exp(np.clip(np.stack([np.zeros(self.n), emit], 1), -30, 30))
        move = np.exp(link)
        forward, backward, scale = np.empty((self.n, 2)), np.ones((self.n, 2)), np.empty(self.n)
        for t, k in enumerate(self.active):
            at = self.start[:k] + t
            a = potential[at] if t == 0 else potential[at] * (forward[at - 1] @ move)
            scale[at] = a.sum(1)
            forward[at] = a / scale[at][:, None]
        pairs = np.zeros((2, 2))
        for t in range(len(self.active) - 1, 0, -1):
            at = self.start[: self.active[t]] + t
            onward = potential[at] * backward[at] / scale[at][:, None]
            backward[at - 1] = onward @ move.T
            pairs += forward[at - 1].T @ onward * move
        both = forward * backward
        return both[:, 1] / both.sum(1), pairs


def neighbours(cells: np.ndarray, lines: np.ndarray, width: int) -> np.ndarray:
    """Cells of the line, the line before and the line after; the chain's ends have cells of their own."""
    n = len(cells)
    first = np.cumsum(lines) - lines
    last = first + lines - 1
    before, after = np.roll(cells, 1, 0) + width, np.roll(cells, -1, 0) + 2 * width
    before[first], after[last] = 3 * width, 3 * width + 1
    return np.concatenate([cells, before, after], 1) if n else np.zeros((0, 3 * cells.shape[1]), np.int64)


def fit(x: np.ndarray, lines: np.ndarray, label: np.ndarray, rounds: int = 3, steps: int = 120) -> dict | None:
    """Weights from the lines of labelled texts."""
    if len(set(label.tolist())) < 2:
        return None
    edges = bin_edges(x)
    width = x.shape[1] * BINS
    cells = neighbours(binned(x, edges), lines, width)
    chains = Chains(lines)
    doc = np.repeat(np.arange(len(lines)), lines)
    y = label[doc].astype(np.float64)
    first = np.cumsum(lines) - lines
    inner = np.ones(len(y), bool)
    inner[first] = False
    weight = (1.0 / lines)[doc]  # each text weighs the same
    w, link = np.zeros(3 * width + 2), np.zeros((2, 2))
    for _ in range(rounds):
        m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
        pair = np.zeros((2, 2))
        np.add.at(pair, (y[:-1].astype(int)[inner[1:]], y[1:].astype(int)[inner[1:]]), 1)
        for step in range(1, steps + 1):
            p, pairs = chains.marginals(w[cells].sum(1), link)
            gap = weight * (y - p)
            grad = np.bincount(cells.ravel(), np.repeat(gap, cells.shape[1]), len(w)) - 0.02 * w
            both = np.append(grad, (pair - pairs).ravel() / max(1, inner.sum()) * len(lines) - 0.02 * link.ravel())
            m1, m2 = 0.9 * m1 + 0.1 * both, 0.99 * m2 + 0.01 * both**2
            change = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
            w, link = w + change[:-4], np.clip(link + change[-4:].reshape(2, 2), -3, 3)
        p, _ = chains.marginals(w[cells].sum(1), link)
        worst = np.minimum.reduceat(p, first)
        y = np.where((label[doc] == 0) & (p > 0.5) & (p > worst[doc]), 1.0, label[doc])
    model = {"edges": edges, "w": w, "link": link, "curve": (0.0, 1.0)}
    good = shares(model, x, lines, np.expm1(x[:, 0]))
    model["curve"] = calibrate(good, label)
    return model


def shares(model: dict, x: np.ndarray, lines: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Length-weighted share of good lines of each text, as log-odds."""
    cells = neighbours(binned(x, model["edges"]), lines, x.shape[1] * BINS)
    p, _ = Chains(lines).marginals(model["w"][cells].sum(1), model["link"])
    doc = np.repeat(np.arange(len(lines)), lines)
    weight = length + 1.0
    good = np.bincount(doc, p * weight, len(lines)) / np.bincount(doc, weight, len(lines))
    return np.log(good + 1e-3) - np.log(1 - good + 1e-3)


def calibrate(good: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """A logistic curve by Newton's method."""
    a, b = 0.0, 1.0
    design = np.stack([np.ones_like(good), good], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * good, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-2
        da, db = np.linalg.solve(hess, design.T @ (label - p) - 1e-2 * np.array([a, b - 1]))
        a, b = a + float(np.clip(da, -2, 2)), b + float(np.clip(db, -2, 2))
    return a, b


def probability(model: dict | None, x: np.ndarray, lines: np.ndarray, length: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(lines), 0.5)
    a, b = model["curve"]
    return 1 / (1 + np.exp(-np.clip(a + b * shares(model, x, lines, length), -30, 30)))


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for _, n, lines, x, _ in line_features(batch.column("text").to_pylist()):
            at = np.append(0, np.cumsum(lines))
            rows += [x[at[i] : at[i + 1]].tobytes() for i in range(n)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("quality"), pa.array(rows, pa.binary())], ["key", "quality", "lines"])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict | None:
    """A model from at most ``sample`` documents with labels that aren't held out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.xxhash64("doc_id").alias("key"), "text", "quality")  # `sample` ids at most
    lines = rows.mapInArrow(lean(sample_features), "key long, quality int, lines binary")
    lines = written(lines.groupBy("key").agg(F.min(F.struct("lines", "quality")).alias("x")).select("key", "x.*"), "quality-lines")
    width = 4 * len(NAMES)
    sizes = lines.select("key", (F.length("lines") / width).cast("long").alias("n")).where(F.col("n") <= LINES).orderBy("key").collect()  # a row a document
    total = np.cumsum([r.n for r in sizes])
    if not len(total) or not (total <= LINES).any():
        return None
    last = sizes[int((total <= LINES).sum()) - 1].key
    found = lines.where((F.col("key") <= last) & (F.length("lines") <= LINES * width)).orderBy("key").collect()
    x = [np.frombuffer(r.lines, np.float32).reshape(-1, len(NAMES)) for r in found]
    return fit(np.concatenate(x), np.array([len(a) for a in x]), np.array([r.quality for r in found]))


def score_texts(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = [probability(model, x, lines, length) for _, _, lines, x, length in line_features(batch.column(text).to_pylist())]
            score = np.round(np.concatenate(out), 6) if out else np.zeros(0)
            keep = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], [*keep, "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``score``, the probability of quality label 1."""
    keep = [c for c in keep if c != "score"]
    rows = numbered(docs.select(*keep, "text"))
    text = f"c{len(keep)}"
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != text)
    return rows.mapInArrow(lean(score_texts(shared, text)), f"{schema}score double").toDF(*keep, "score")


def line_marginals(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, line (from 0), good: the marginal probability of every line."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, n, lines, x, _ in line_features(batch.column("text").to_pylist()):
                if model is None:
                    p = np.full(len(x), 0.5)
                else:
                    cells = neighbours(binned(x, model["edges"]), lines, x.shape[1] * BINS)
                    p, _ = Chains(lines).marginals(model["w"][cells].sum(1), model["link"])
                ids = batch.column("doc_id").slice(first, n).take(pa.array(np.repeat(np.arange(n), lines)))
                number = np.arange(len(x)) - np.repeat(np.cumsum(lines) - lines, lines)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number), pa.array(p)], ["doc_id", "line", "good"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, line long, good double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those scored below the threshold; all, if there is no model."""
    model = learn(docs, labels)
    if model is None:
        return docs
    columns = docs.columns
    plain, text = numbered(docs), f"c{columns.index('text')}"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [probability(shared.value, x, lines, length) for _, _, lines, x, length in line_features(batch.column(text).to_pylist())]
            on = np.round(np.concatenate(out), 6) >= threshold if out else np.zeros(0, bool)
            yield batch.filter(pa.array(on))

    return plain.mapInArrow(lean(run), plain.schema).toDF(*columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = quality_scores(docs, documents(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
