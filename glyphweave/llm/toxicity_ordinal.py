"""Severity of toxicity by cumulative-link (proportional-odds) regression.

Features are words and their first four to six bytes (which hold the stems of
inflected words), hashed. P(grade <= k) = sigmoid(cut_k - w.x): one weight
vector serves all ordered thresholds, x holds log(1 + count) of the features.
The expected severity is the sum of the probabilities of reaching each grade.

Labels say toxic or not. Grades of toxic training documents come from their
indicative features (those that toxic documents hold far more often), summed as
the regression sees them: three grades of equal size above grade 0, and grade 1
for a toxic document that has none.

Learning uses at most ``SAMPLE`` labelled documents, the first by a hash of
doc_id, which are written once; features are chosen by a z test over that sample,
at most ``FEATURES`` of them, counted by key range. Scoring reads whole texts in
one pass without a shuffle; a long text is held in its task alone.

Defined results: null and empty texts have no features and get the severity
of the cuts alone; repeated rows are scored each; of rows that share a labelled
doc_id the one with the least text is learned from, and one toxic label makes it
toxic; of features equally far from chance those with the lesser hash are chosen;
without labels of both kinds the severity is 0; an empty table gives no rows;
columns of any name pass through, but for those named like the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sieve import numbered
from .storage import documents, lean, small_batches, written
from .suffix_tree_lm import PACKED, WORDS, by_part, word_part
from .words import Counter, Table, blocks, hashed_spans, pack, unpack

SAMPLE = 20_000
FEATURES = 4096
GRADES = 4
HEADS = (4, 5, 6)
LEAST_Z = 4.0
#: ASCII that isn't a letter or digit separates words.
ONLY_WORDS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def text_features(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, words of each, feature hashes, text of each feature), block by block.

    The first rows of the features are the words themselves, in order."""
    for first, n, buffer, starts in blocks(texts, table=ONLY_WORDS):
        words, begin, end, per_text, *heads = hashed_spans(buffer, starts, HEADS)
        of = np.repeat(np.arange(n), per_text)
        hashes, where = [words], [of]
        for size, head in zip(HEADS, heads, strict=True):
            longer = end - begin > size
            hashes.append(head[longer] ^ np.uint64(size))
            where.append(of[longer])
        yield first, n, per_text, np.concatenate(hashes), np.concatenate(where)


def count_features(n_parts: int):
    """Documents with each feature, toxic ones in the upper half of the count, by key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
            for first, n, _, hashes, where in text_features(batch.column("text").to_pylist()):
                order = np.lexsort((hashes, where))
                h, w = hashes[order], where[order]
                once = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])) if len(h) else np.zeros(0, bool)
                h, w = h[once], w[once]
                counter.add(h, np.where(toxic[first : first + n][w] == 1, 1 << 32, 1))
                if counter.full:
                    yield flush(counter)
        yield flush(counter)

    def flush(counter: Counter) -> pa.RecordBatch:
        keys, counts = counter.take()
        return by_part(WORDS, word_part(keys, n_parts), n_parts, 0, keys, counts)

    return run


def indicative(n_toxic: int, n_clean: int):
    """Of one key range's counts: features whose shares among toxic and clean documents differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                counter.add(*unpack(blob))
        keys, counts = counter.take()
        a, b = counts >> 32, counts & 0xFFFFFFFF
        share = (a + b) / (n_toxic + n_clean)
        with np.errstate(divide="ignore", invalid="ignore"):
            z = (a / n_toxic - b / n_clean) / np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
        on = np.flatnonzero((np.abs(z) >= LEAST_Z) & (a + b >= 5))
        yield pa.RecordBatch.from_arrays([pa.array(keys[on].view(np.int64)), pa.array(z[on]), pa.array((a[on] / n_toxic) / ((b[on] + 0.5) / n_clean))], ["key", "z", "ratio"])

    return run


def matrix_rows(table: Table, n_features: int, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, texts, words, text, feature, count) of the features that the model has."""
    for first, n, per_text, hashes, where in text_features(texts):
        found = table.get(hashes)
        on = found >= 0
        cell, count = np.unique(where[on] * n_features + found[on], return_counts=True)
        yield first, n, per_text, cell // n_features, cell % n_features, count


def fit(n: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts by gradient ascent on the likelihood.

    Cuts are a first cut and positive gaps, so that they keep their order."""
    w, theta = np.zeros(n_features), np.array([2.0] + [0.0] * (GRADES - 2))
    m1, m2 = np.zeros(n_features + GRADES - 1), np.zeros(n_features + GRADES - 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, steps + 1):
        cuts = theta[0] + np.append(0, np.cumsum(np.exp(theta[1:])))
        x = np.bincount(row, value * w[feature], n)
        below = np.concatenate([np.zeros((n, 1)), sigmoid(cuts - x[:, None]), np.ones((n, 1))], 1)
        upper, lower = below[np.arange(n), grade + 1], below[np.arange(n), grade]
        p = np.maximum(upper - lower, 1e-12)
        up, lo = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_x = lo - up
        by_cut = np.array([up[grade == k].sum() - lo[grade == k + 1].sum() for k in range(GRADES - 1)])
        gaps = np.exp(theta[1:])
        by_theta = np.append(by_cut.sum(), [by_cut[k + 1 :].sum() * gaps[k] for k in range(GRADES - 2)])
        grad = np.append((np.bincount(feature, value * by_x[row], n_features) - 1e-3 * n * w / n_features) / n, by_theta / n)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        change = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        w, theta = w + change[:n_features], theta + change[n_features:]
    return w, theta[0] + np.append(0, np.cumsum(np.exp(theta[1:])))


def reach(cuts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(grade > k) for each cut."""
    return 1 / (1 + np.exp(-np.clip(x[:, None] - cuts, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # `sample` ids at most
    rows = written(rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "toxicity-sample")
    sizes = {x.toxic: x["count"] for x in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.mapInArrow(lean(count_features(n_parts)), PACKED).repartition(n_parts, "part")
    chosen = counts.mapInArrow(lean(indicative(sizes[1], sizes[0])), "key long, z double, ratio double").orderBy(F.abs("z").desc(), "key").limit(FEATURES).collect()
    if not chosen:
        return None
    chosen.sort(key=lambda c: c.key)
    keys = np.array([c.key for c in chosen], np.int64).view(np.uint64)
    strong = np.array([c.z > 0 and c.ratio > 20 for c in chosen])
    n_features = len(keys)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(keys, np.arange(n_features))
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            out = []
            for first, n, _, row, feature, count in matrix_rows(table, n_features, batch.column("text").to_pylist()):
                cut = np.searchsorted(row, np.arange(n + 1))
                out += [(toxic[first + i], pack(feature[cut[i] : cut[i + 1]].astype(np.int32), count[cut[i] : cut[i + 1]].astype(np.int32))) for i in range(n)]
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], ["toxic", "blob"])

    found = rows.mapInArrow(lean(rows_of), "toxic int, blob binary").orderBy("toxic", "blob").collect()  # `sample` rows at most
    toxic = np.array([r.toxic for r in found])
    parts = [unpack(r.blob) for r in found]
    row = np.repeat(np.arange(len(found)), [len(p[0]) for p in parts])
    feature = np.concatenate([p[0] for p in parts]).astype(np.int64)
    count = np.concatenate([p[1] for p in parts]).astype(np.float64)
    grade = grades(toxic, np.bincount(row, np.log1p(count) * strong[feature], len(found)))
    w, cuts = fit(len(found), row, feature, np.log1p(count), grade, n_features)
    return {"keys": keys, "w": w, "cuts": cuts}


def grades(toxic: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """0 for clean documents; toxic ones with evidence in equal shares of 1 to GRADES - 1."""
    some = evidence[(toxic == 1) & (evidence > 0)]
    edges = np.quantile(some, np.arange(1, GRADES - 1) / (GRADES - 1)) if len(some) else np.full(GRADES - 2, np.inf)
    return np.where(toxic == 1, 1 + np.searchsorted(edges, evidence, side="left") * (evidence > 0), 0)


RESULT = "severity double, grade int, p_toxic double"


def score_texts(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = Table(model["keys"], np.arange(len(model["keys"]))) if model else None
        for batch in batches:
            texts = batch.column(text).to_pylist()
            over = [np.zeros((0, GRADES - 1))]
            if model is None:
                over = [np.zeros((len(texts), GRADES - 1))]
            else:
                for _, n, _, row, feature, count in matrix_rows(table, len(model["w"]), texts):
                    over.append(reach(model["cuts"], np.bincount(row, np.log1p(count) * model["w"][feature], n)))
            p = np.round(np.concatenate(over), 6)
            grade = (p >= 0.5).sum(1).astype(np.int32)
            keep = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.round(p.sum(1), 6)), pa.array(grade), pa.array(p[:, 0])], [*keep, *RESULTS])

    return run


RESULTS = [x.split()[0] for x in RESULT.split(", ")]


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``severity`` (expected grade, 0 to 3), ``grade`` (the
    median grade) and ``p_toxic`` (probability of grade 1 or more)."""
    keep = [c for c in keep if c not in RESULTS]
    rows = numbered(docs.select(*keep, "text"))
    text = f"c{len(keep)}"
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != text)
    return rows.mapInArrow(lean(score_texts(shared, text)), f"{schema}{RESULT}").toDF(*keep, *RESULTS)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity_scores(docs, documents(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "grade", "p_toxic", (F.col("grade") >= 1).alias("toxic"))
