"""Near-duplicates by ProbMinHash over weighted word shingles.

A text is the multiset of its five-word shingles (lower-cased words). Every
distinct shingle is a Poisson process whose rate is its count; its arrivals
fall into the registers of the signature at random, each register keeps the
earliest one, and a process ends as soon as its next arrival is later than the
latest register. Two registers agree with the probability Jaccard similarity
of the multisets. Bands of registers give candidates, whose similarity is then
computed exactly from the texts; classes are connected components of the pairs
at or above the threshold.

Scale: equal texts are one node from the start (by a 128-bit digest). In a
bucket every member is first held against the bucket's least member only, so a
family of copies gives a star, not all pairs. Where a bucket holds more than
one class after that, its members are held against the one nearest to the
bucket's commonest registers (an original among its copies), then against the
next such one for those far from it. What still differs is settled inside
tasks, in blocks of bounded size: members with a partner of another class
whose signature agrees get their texts, pairs are compared exactly in the
order of agreement, and a pair that a link has meanwhile put into one class is
skipped. Only links go out. Hot buckets span many blocks; labels, edges and
members stay distributed.

Defined results: null text is empty; equal texts share a class, empty ones
included; texts without words have no shingles and join no other class; one to
four words make one shingle; a null doc_id is a document like any other, but
names a class only if the class has no other id; repeated rows count each; of
rows that tie for a class's id the one with the least digest is kept; an empty
table gives none; a text is one row of any length, and few texts are in a task's
memory at once; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, extended
from .sieve import numbered, thinned, without
from .storage import documents, lean, small_batches, written
from .words import blocks, hashed_words, mix

WORDS_IN_SHINGLE = 5
THRESHOLD = 0.8
BANDS, IN_BAND = 25, 5
REGISTERS = BANDS * IN_BAND
AGREE = 0.66  # of byte-wide signatures, before an exact comparison: 3.9 sd below 0.8, the miss rate of the bands
BLOCK_ROWS, BLOCK_SHINGLES = 512, 200_000  # of a side of a block pair
STAR_ROWS, TURNS = 65536, 32
PAIRS_AT_ONCE = 32  # pairs of texts in a Python worker's memory
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, per_text: np.ndarray, k: int = WORDS_IN_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of consecutive texts, and the text of each."""
    ends = np.cumsum(per_text)
    starts = ends - per_text
    n = len(words)
    full = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        full = full * STEP + words[j : n - k + 1 + j] if len(full) else full
    number = np.where(per_text >= k, per_text - k + 1, 0)
    text = np.repeat(np.arange(len(per_text)), number)
    first = np.cumsum(number) - number
    at = np.arange(number.sum()) - np.repeat(first, number) + np.repeat(starts, number)
    hashes = mix(full[at]) if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((per_text > 0) & (per_text < k))
    if len(short):
        value = per_text[short].astype(np.uint64)
        for j in range(k - 1):
            more = per_text[short] > j
            value[more] = value[more] * STEP + words[starts[short[more]] + j]
        hashes, text = np.append(hashes, mix(value)), np.append(text, short)
    return hashes, text


def weighted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts."""
    key = mix(hashes ^ (text.astype(np.uint64) * STEP))
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return hashes[order[begin]], text[order[begin]], np.diff(np.append(begin, len(key)))


def signatures(hashes: np.ndarray, text: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(n, REGISTERS) elements of the earliest arrivals; 0 for texts without shingles."""
    earliest = np.full(n * REGISTERS, np.inf)
    winner = np.zeros(n * REGISTERS, np.uint64)
    now = np.zeros(len(hashes))
    step = 0
    with np.errstate(over="ignore"):
        while len(hashes):
            step += 1
            random = mix(hashes + np.uint64(step) * STEP)
            now = now - np.log1p(-(random >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight
            register = text * REGISTERS + (mix(random) % np.uint64(REGISTERS)).astype(np.int64)
            better = now < earliest[register]
            at, when, who = register[better], now[better], hashes[better]
            np.minimum.at(earliest, at, when)
            won = when == earliest[at]
            winner[at[won]] = who[won]
            on = now < earliest.reshape(n, REGISTERS).max(1)[text]
            hashes, text, weight, now = hashes[on], text[on], weight[on], now[on]
    return winner.reshape(n, REGISTERS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    key = np.zeros((len(signature), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    parts = signature.reshape(len(signature), BANDS, IN_BAND)
    for j in range(IN_BAND):
        key = mix(key * STEP + parts[:, :, j])
    return key.view(np.int64)


def probability_jaccard(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> float:
    """Exact similarity of two multisets: sorted distinct hashes and their counts."""
    if not len(x) or not len(y):
        return 0.0
    common, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = nx[ix].astype(np.float64), ny[iy].astype(np.float64)
    only_x, only_y = nx.sum() - a.sum(), ny.sum() - b.sum()
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    ratio = a / b
    at = np.searchsorted(ratio, ratio, side="left")  # before: y dominates; from here: x does
    sum_a, sum_b = np.append(0, np.cumsum(a)), np.append(0, np.cumsum(b))
    return float((1 / ((only_x + sum_a[-1] - sum_a[at]) / a + (only_y + sum_b[at]) / b)).sum())


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for first, n, buffer, starts in blocks(texts):
            words, per_text = hashed_words(buffer, starts)
            signature = signatures(*weighted(*shingles(words, per_text)), n)
            keys = band_keys(signature)
            narrow = (signature * STEP >> np.uint64(56)).astype(np.uint8)
            some = per_text > 0
            bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some * BANDS)).astype(np.int32)), pa.array(keys[some].ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest").slice(first, n), bands, pa.array([x.tobytes() for x in narrow], pa.binary()), pa.array(per_text)],
                ["digest", "bands", "signature", "length"],
            )


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarities of pairs of texts."""
    for batch in batches:
        sides = [batch.column(x).to_pylist() for x in ("a", "b", "text_a", "text_b")]
        texts = dict(zip(sides[0], sides[2], strict=True)) | dict(zip(sides[1], sides[3], strict=True))
        place = {x: i for i, x in enumerate(texts)}
        sets = multisets(list(texts.values()))
        similarity = [probability_jaccard(*sets[place[a]], *sets[place[b]]) for a, b in zip(sides[0], sides[1], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similarity, pa.float64())], ["a", "b", "similarity"])


def in_blocks(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """``make`` of the rows of each (band, i, j), which come sorted so."""
    held: list[pa.RecordBatch] = []
    now = None

    def table() -> pa.Table:
        return pa.Table.from_batches(held).combine_chunks()

    for batch in batches:
        keys = list(zip(*(batch.column(x).to_pylist() for x in ("band", "i", "j")), strict=True))
        cut = [0] + [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]] + [len(keys)]
        for a, b in zip(cut, cut[1:], strict=False):
            if b > a and keys[a] != now:
                if held:
                    yield from make(table())
                held, now = [], keys[a]
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield from make(table())


def columns_of(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Digests, signatures, labels of classes, and sides (0, 1, or 2: both)."""
    digests = table["digest"].to_pylist()
    signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(digests), REGISTERS)
    label = np.unique(table["component"].to_pylist(), return_inverse=True)[1]
    return digests, signature, label, np.array(table["side"].to_pylist())


def pair_rows(digests: list[bytes], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    found = [sorted((digests[i], digests[j])) for i, j in pairs]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], ["a", "b"])


def near_originals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row against the row nearest to the commonest registers of those left,
    ``TURNS`` times at most: this only saves comparisons that ``settle`` makes else."""

    def make(table: pa.Table) -> Iterator[pa.RecordBatch]:
        digests, signature, label, _ = columns_of(table)
        left = np.arange(len(signature))
        for _ in range(TURNS):
            if len(left) < 2:
                break
            rows = signature[left]
            common = np.array([np.bincount(rows[:, r], minlength=256).argmax() for r in range(REGISTERS)], np.uint8)
            center = left[int((rows == common).sum(1).argmax())]
            near = (rows == signature[center]).mean(1) >= AGREE
            yield pair_rows(digests, [(center, j) for j in left[near & (label[left] != label[center])]])
            left = left[~near & (left != center)]

    return in_blocks(batches, make)


def open_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of different classes whose signatures agree, and the
    agreement; each pair in the first band only that both rows share."""
    _, signature, label, side = columns_of(table)
    keys = np.array(table["bands"].to_pylist(), np.int64)
    own = int(np.flatnonzero(keys[0] == table["band"][0].as_py())[0])
    right = np.flatnonzero(side != 0)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i in np.flatnonzero(side != 1):
        others = right[(label[right] != label[i]) & (right > i if side[i] == 2 else True)]
        agree = (signature[others] == signature[i]).mean(1) if len(others) else np.zeros(0)
        others, agree = others[agree >= AGREE], agree[agree >= AGREE]
        first = (keys[others] == keys[i]).argmax(1) == own if len(others) else np.zeros(0, bool)
        out.append((np.full(int(first.sum()), i), others[first], agree[first]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that have an open pair in their block pair."""

    def make(table: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j, _ = open_pairs(table)
        yield from table.take(np.unique(np.append(i, j))).to_batches()

    return in_blocks(batches, make)


def settle(threshold: float):
    """Links between classes, by exact comparison of all open pairs that no
    other link has put into one class."""

    def make(table: pa.Table) -> Iterator[pa.RecordBatch]:
        digests, _, label, _ = columns_of(table)
        i, j, agree = open_pairs(table)
        sets = multisets(table["text"].to_pylist())
        root = list(range(int(label.max()) + 1))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = []
        for k in np.argsort(-agree, kind="stable"):
            a, b = find(label[i[k]]), find(label[j[k]])
            if a != b and probability_jaccard(*sets[i[k]], *sets[j[k]]) >= threshold:
                root[a] = b
                links.append((i[k], j[k]))
        yield pair_rows(digests, links)

    return lambda batches: in_blocks(batches, make)


def multisets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles and counts of each text."""
    sets: list[tuple[np.ndarray, np.ndarray]] = []
    for _, n, buffer, starts in blocks(texts):
        hashes, text = shingles(*hashed_words(buffer, starts))
        order = np.argsort(text, kind="stable")
        cut = np.searchsorted(text[order], np.arange(n + 1))
        sets += [np.unique(hashes[order[cut[i] : cut[i + 1]]], return_counts=True) for i in range(n)]
    return sets


def texts_of(wanted: DataFrame, texts: DataFrame, label: str) -> DataFrame:
    """One text for each wanted digest."""
    wanted = written(wanted.distinct(), f"{label}-wanted", narrow=True)
    # an inner join stays above the bitmap; a semi-join would be pushed below it
    return written(thinned(texts, "digest", wanted).join(wanted, "digest").dropDuplicates(["digest"]), f"{label}-texts")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, label: str) -> DataFrame:
    """``pairs`` (a, b) at or above the threshold; texts travel for the digests in pairs alone."""
    own = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("digest")), texts, label)
    sided = pairs.join(own.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
    sided = sided.join(own.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")
    small_batches(pairs.sparkSession, PAIRS_AT_ONCE)
    found = sided.select("a", "b", "text_a", "text_b").mapInArrow(lean(compare), "a binary, b binary, similarity double")
    edges = written(found.where(F.col("similarity") >= threshold).select("a", "b"), f"{label}-edges", narrow=True)
    small_batches(pairs.sparkSession)
    return edges


def open_blocks(shared: DataFrame, nodes: DataFrame, labels: DataFrame, rows: int, crossed: bool) -> DataFrame:
    """Members of the buckets that hold several classes, dealt to blocks of about
    ``rows``; ``crossed``: to pairs of blocks. Members of a bucket's largest class
    have blocks of their own, which meet those of the other members but not each
    other: a bucket of n copies and m strays costs about n + m n / ``rows``."""
    named = shared.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    groups = named.join(nodes.select("digest", "length"), "digest").groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("length").alias("length"))
    blocks = lambda n, length: F.greatest(F.ceil(n / rows), F.ceil(length / (rows / BLOCK_ROWS * BLOCK_SHINGLES))).cast("int")
    most = F.max(F.struct("n", "length", "component")).alias("most")
    sizes = groups.groupBy("band").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("length").alias("length"), most).where("classes > 1")
    large, n = blocks(F.col("most.n"), F.col("most.length")), blocks(F.col("n"), F.col("length"))
    others = F.greatest(F.lit(1), blocks(F.col("n") - F.col("most.n"), F.col("length") - F.col("most.length")))
    sizes = sizes.select("band", F.col("most.component").alias("largest"), (large if crossed else F.lit(0)).alias("large"), (large + others if crossed else n).alias("n_blocks"))
    members = named.join(sizes, "band").join(nodes, "digest").withColumn("is_large", F.col("component") == F.col("largest"))
    spread = F.xxhash64("digest")
    if crossed:
        own = F.when(F.col("is_large"), F.pmod(spread, F.col("large"))).otherwise(F.col("large") + F.pmod(spread, F.col("n_blocks") - F.col("large")))
        dealt = members.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.expr("sequence(if(is_large, large, 0), n_blocks - 1)")))
    else:
        dealt = members.withColumn("own", F.pmod(spread, F.col("n_blocks")).cast("int")).withColumn("other", F.col("own"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "digest", "component", *[c for c in nodes.columns if c != "digest"])
    return dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text): one row for each distinct text (``digest``,
    ``component``: the least digest of its class, ``class_id``: the least doc_id of its class, ``class_size`` in rows), and
    the links found (``a``, ``b``: digests)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = with_digest(docs).select("digest", F.coalesce("text", F.lit("")).alias("text"))
    signed = texts.mapInArrow(lean(sign), "digest binary, bands array<long>, signature binary, length long")
    nodes = written(signed.groupBy("digest").agg(F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.first("length").alias("length")), "minhash-nodes")

    members = nodes.select("digest", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(members.join(buckets, "band"), "minhash-buckets")
    centers = shared.groupBy("band").agg(F.min("digest").alias("a"))
    star = written(shared.join(centers, "band").where("digest != a").select("a", F.col("digest").alias("b")).distinct(), "minhash-star", narrow=True)
    edges = verified(star, texts, threshold, "star")
    labels = components(edges)

    near = open_blocks(shared, nodes.select("digest", "signature", "length"), labels, STAR_ROWS, crossed=False)
    near = near.mapInArrow(lean(near_originals), "a binary, b binary").distinct().join(star, ["a", "b"], "left_anti")
    near = verified(written(near, "minhash-near", narrow=True), texts, threshold, "near")
    edges = written(edges.unionByName(near), "minhash-edges", narrow=True)
    labels = extended(labels, near)

    dealt = open_blocks(shared, nodes, labels, BLOCK_ROWS, crossed=True)
    left = written(dealt.mapInArrow(lean(still_open), dealt.schema), "minhash-open")
    own = texts_of(left.select("digest"), texts, "open")
    met = left.join(own, "digest").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    small_batches(spark, PAIRS_AT_ONCE)
    links = written(met.mapInArrow(lean(settle(threshold)), "a binary, b binary"), "minhash-links", narrow=True)
    small_batches(spark)
    edges = edges.unionByName(links)
    labels = extended(labels, links)

    rows = with_digest(docs).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    rows = rows.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    classes = rows.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("rows").alias("class_size"))
    return rows.join(classes, "component").select("digest", "component", "class_id", "class_size"), edges


def with_digest(docs: DataFrame) -> DataFrame:
    return docs.withColumn("digest", digest_of(F.col("text")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs``: doc_id, class_id, class_size, n_links
    (of its text to other texts, as far as the search had to look) and
    is_kept, true for one row of each class."""
    ids = docs.select("doc_id", "text")
    classes, edges = duplicate_classes(ids, threshold)
    links = edges.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n_links"))
    rows = with_digest(ids).select("doc_id", "digest").join(classes, "digest").join(links, "digest", "left")
    # of several rows with the class's id one is kept
    copies = rows.groupBy("doc_id", "digest", "component", "class_id", "class_size", "n_links").agg(F.count("*").alias("copies"))
    own = F.when(F.col("doc_id").eqNullSafe(F.col("class_id")), F.col("digest"))
    chosen = copies.groupBy("component").agg(F.min(own).alias("chosen"))
    each = copies.join(chosen, "component").withColumn("nth", F.explode(F.expr("sequence(1L, copies)")))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("chosen")) & (F.col("nth") == 1)
    return each.select("doc_id", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), kept.alias("is_kept"))


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that another row of their class stands for."""
    columns = docs.columns
    classes, _ = duplicate_classes(docs.select("doc_id", "text"), threshold)
    rows = with_digest(docs.select("doc_id", "text")).groupBy("digest", "doc_id").agg(F.count("*").alias("n")).join(classes, "digest")
    # of a class's texts with its id the first one stays, an id may stand on several
    own = F.when(F.col("doc_id").eqNullSafe(F.col("class_id")), F.col("digest"))
    chosen = rows.groupBy("component").agg(F.min(own).alias("chosen"))
    fates = rows.join(chosen, "component").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("chosen")))
    # most rows have no entry here: those stand for their class and aren't repeated
    apart = written(fates.where("not stays or n > 1").select("digest", "doc_id", "stays"), "minhash-apart", narrow=True)
    plain = numbered(docs)
    doc_id, text = (f"c{columns.index(x)}" for x in ("doc_id", "text"))
    at = plain.withColumn("digest", digest_of(F.col(text)))
    once = without(at, ["digest", doc_id], apart.select("digest", "doc_id")).drop("digest")
    repeated = apart.where("stays").select(F.col("digest").alias("stays"), F.col("doc_id").alias("stays_id"))
    on = (F.col("digest") == F.col("stays")) & F.col(doc_id).eqNullSafe(F.col("stays_id"))
    several = thinned(at, "digest", repeated.select("stays")).join(repeated, on).dropDuplicates(["digest"]).select(*plain.columns)
    return once.unionByName(several).toDF(*columns)


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
