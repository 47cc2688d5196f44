"""Secret findings with a random forest that removes false positives.

A wide net proposes findings, which may overlap:

- blank-delimited tokens of ``SHORTEST`` bytes or more that hold a digit, without
  quotes, brackets, closing signs and a name before ``=`` or ``:``, unless one of
  the findings below lies inside;
- what is assigned to a name by ``=`` or ``:``, also inside tokens (objects, URL
  queries, connection strings): ``SHORTEST`` bytes with a digit, or ``SHORT`` bytes
  of any kind behind a telling name;
- passwords in URLs, and values of an issuer's format anywhere in a token.

Features are length and kinds of characters, the likelihood of their character
transitions under those of the corpus, how much of a finding and of the words
beside it the corpus's frequent words cover, and path and address signs. Trees
vote on each finding.

The forest learns from labelled findings (doc_id, start, end, secret). Where
no people have labelled any, ``rule_labels`` makes some from evidence that is
no feature: names and issuers' formats. What is assigned to a telling name or
has an issuer's format is a secret; addresses, numbers and paths, and what has no
name, are not; all else stays without a label, and is judged by its form alone.

Character transitions and word counts cover all documents. They are summed in
every task before they are shuffled. Learning uses at most ``SAMPLE`` labelled
findings, the first by a hash of their place.

Defined results: null and empty texts have no findings; repeated rows give
their findings each; a span that several generators propose is one finding;
without labels of both kinds every finding stays, with score 1; a score at the
threshold is a secret; ids keep their type; an empty table gives no rows; a long
text is held in its task alone; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import documents, lean, small_batches, written
from .suffix_tree_lm import PACKED, WORDS, by_part, count_of_counts, frequent_words, merge_counts, narrow, packed_batch
from .words import BLOCK, BYTE_VALUES, Counter, Table, blocks, hashed_spans, mix, pack, powers, unpack

SHORTEST, SHORT = 12, 6  # bytes
SAMPLE = 20_000
DICTIONARY = 50_000
PIECES = range(4, 11)  # bytes of dictionary words that are sought in a finding
TREES, DEPTH, LEAF = 40, 8, 5
THRESHOLD = 0.5
TRANSITIONS = 9

# Telling names, and issuers' prefixes.
NAMES = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "access_key", "secret_key", "auth", "credential", "bearer")
ISSUED = re.compile(r"(AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
ADDRESS = re.compile(r"[^@]+@[^@]+\.[^@]+|(\d+\.){3}\d+|[+(]?\d[\d().+ -]*|\w+://.*|(/[\w.-]+)+/?|[\w.-]+(/[\w.-]+)+")
NAMED = re.compile(r"([A-Za-z_][A-Za-z0-9_.-]*)\s*[=:]+")
SHELL = "\"'`()[]{}<>,;"
BEFORE_SIGN = re.compile(rb"([A-Za-z_][A-Za-z0-9_.-]*)[\"'`]?[ \t]*$")
ASSIGNED = re.compile(rb"[=:]+[ \t]*([\"'`]?)([^\s\"'`,;&|<>(){}\[\]]+)")
IN_URL = re.compile(rb"://[^\s/:@\"']*:([^\s/@\"']{4,})@")
REACH = 80  # bytes of a name

FEATURES = (
    "length", "digits", "upper", "lower", "signs", "distinct", "entropy", "hex", "transitions", "worst_transition", "runs", "covered", "longest_run", "at", "slashes", "dots", "dashes",
    "quoted", "before_covered", "before_length", "after_covered", "after_length", "after_capital",
)


def tokens(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, texts, buffer, token begins, ends, text of each, wide-net members) of raw texts."""
    first, part, size = 0, [], 0
    for text in texts:
        raw = (text or "").encode()
        part.append(raw)
        size += len(raw) + 1
        if size >= BLOCK:
            yield (first, len(part), *_tokens(part))
            first, part, size = first + len(part), [], 0
    if part:
        yield (first, len(part), *_tokens(part))


def _tokens(raws: list[bytes]):
    buffer = b"\n" + b"\n".join(raws) + b"\n"
    data = np.frombuffer(buffer, np.uint8)
    blank = (data == 32) | (data >= 9) & (data <= 13)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    starts = np.cumsum([1] + [len(r) + 1 for r in raws])[:-1]
    of = np.searchsorted(starts, begin, side="right") - 1
    digits = np.cumsum((data >= 48) & (data <= 57))
    wide = np.flatnonzero((end - begin >= SHORTEST) & (digits[end - 1] > digits[begin - 1]))
    return buffer, begin, end, of, wide, starts


def trimmed(token: str) -> tuple[int, int, str]:
    """Begin and end of the value in a token, and the name it is assigned to."""
    b, e = 0, len(token)
    name = ""
    if (m := NAMED.match(token)) and m.end() < e and not token[m.end() :].startswith("//"):
        name, b = m[1], m.end()
    while b < e and token[b] in SHELL:
        b += 1
    while e > b and not token[e - 1].isalnum() and token[e - 1] not in "=/+-_":
        e -= 1
    return b, e, name


def assigned(buffer: bytes) -> Iterator[tuple[int, int, str, bool]]:
    """(begin, end, name, quoted) of what stands behind names and signs, and of URLs' passwords."""
    urls = dict(m.span(1) for m in IN_URL.finditer(buffer)) if b"://" in buffer else {}
    yield from ((begin, end, "password", False) for begin, end in urls.items())
    data = np.frombuffer(buffer, np.uint8)
    sign = (data == 61) | (data == 58)
    for at in (np.flatnonzero(sign[1:] & ~sign[:-1]) + 1).tolist():
        name = BEFORE_SIGN.search(buffer, max(0, at - REACH), at)
        value = ASSIGNED.match(buffer, at) if name else None
        if not value or value[2].startswith(b"//"):
            continue
        begin, end = value.span(2)
        if begin in urls:
            continue
        while end > begin and not buffer[end - 1 : end].isalnum() and buffer[end - 1] < 128 and buffer[end - 1] not in b"=/+-_!":
            end -= 1
        yield begin, end, name[1].decode(), value[1] != b""


def telling(name: str) -> bool:
    return any(x in name.lower() for x in NAMES)


def findings(texts: list[str | None]) -> list[tuple]:
    """(text, start, end, value, name, word before, word after, quoted) of all findings."""
    out = []
    for first, _, buffer, begin, end, of, wide, starts in tokens(texts):
        inner: dict[tuple[int, int], tuple[str, bool]] = {}
        for b, e, name, quoted in assigned(buffer):
            if e - b >= SHORT and telling(name) or e - b >= SHORTEST and any(48 <= c <= 57 for c in buffer[b:e]):
                inner[b, e] = name, quoted
        for i in np.flatnonzero(end - begin >= SHORTEST + 2).tolist():
            token = buffer[begin[i] : end[i]]
            if (b"_" in token or any(x in token for x in (b"AKIA", b"ASIA", b"xox", b"AIza", b"eyJ"))) and (m := ISSUED.search(token.decode())):
                b = int(begin[i]) + len(token.decode()[: m.start()].encode())
                inner.setdefault((b, b + len(m[0].encode())), ("", False))
        spans = dict(inner)
        held = np.array(sorted(b for b, _ in inner), np.int64)
        for i in wide.tolist():
            token = buffer[begin[i] : end[i]].decode()
            b, e, name = trimmed(token)
            value = token[b:e]
            if len(value.encode()) < SHORTEST or not any(c.isdigit() for c in value):
                continue
            at = int(begin[i]) + len(token[:b].encode())
            to = at + len(value.encode())
            if (at, to) in spans or (k := np.searchsorted(held, begin[i])) < len(held) and held[k] < end[i]:
                continue
            before = buffer[begin[i - 1] : end[i - 1]].decode() if i and of[i - 1] == of[i] else ""
            if not name and before.endswith((":", "=")):
                name = before.strip(SHELL + ":=")
            spans[at, to] = name, b > 0 and token[b - 1] in "\"'`"
        if not spans:
            continue
        cont = np.cumsum((np.frombuffer(buffer, np.uint8) & 0xC0) != 0x80)
        word = lambda i, t: buffer[begin[i] : end[i]].decode() if 0 <= i < len(begin) and of[i] == t else ""  # noqa: B023, E731
        for (b, e), (name, quoted) in sorted(spans.items()):
            i = int(np.searchsorted(begin, b, side="right")) - 1
            t = int(of[i])
            before = word(i - 1, t)
            if before and not any(c.isalnum() for c in before):
                before = word(i - 2, t)
            start = int(cont[b - 1] - cont[starts[t] - 1])
            value = buffer[b:e].decode()
            out.append((first + t, start, start + len(value), value, name, before, word(int(np.searchsorted(end, e)) + 1, t), quoted))
    return out


def transitions_of(values: list[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and least log-likelihood of the character transitions of values."""
    mean, worst = np.zeros(len(values)), np.zeros(len(values))
    for i, v in enumerate(values):
        d = np.frombuffer(v.lower().encode(), np.uint8)
        if len(d) > 1:
            logs = model[d[:-1], d[1:]]
            mean[i], worst[i] = logs.mean(), logs.min()
    return mean, worst


def covered_by(values: list[str], dictionary: Table) -> np.ndarray:
    """Share of each value's bytes inside dictionary words."""
    raw = [v.lower().encode() for v in values]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    up, down = powers(len(data))
    sums = np.cumsum(BYTE_VALUES[data] * up[: len(data)])
    feeds = np.cumsum(data == 10)
    inside = np.zeros(len(data) + 1, np.int64)
    for size in PIECES:
        begin = np.arange(1, len(data) - size)
        begin = begin[feeds[begin + size - 1] == feeds[begin - 1]] if len(begin) else begin
        hit = begin[dictionary.get(mix((sums[begin + size - 1] - sums[begin - 1]) * down[begin])) >= 0]
        np.add.at(inside, hit, 1)
        np.add.at(inside, hit + size, -1)
    covered = np.append(0, np.cumsum(np.cumsum(inside[:-1]) > 0))
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts = ends - [len(r) for r in raw] if raw else ends
    return (covered[ends] - covered[starts]) / np.maximum(1, ends - starts) if raw else np.zeros(0)


def features(found: list[tuple], model: np.ndarray, dictionary: Table) -> np.ndarray:
    """Form and neighbourhood of findings; names and issuers' formats aren't among them, as labels come from these."""
    values = [f[3] for f in found]
    mean, worst = transitions_of(values, model)
    cover = covered_by(values, dictionary)
    cover_before, cover_after = (covered_by([f[k] or "-" for f in found], dictionary) for k in (5, 6))
    rows = np.zeros((len(found), len(FEATURES)), np.float32)
    for i, (_, _, _, v, _, before, after, quoted) in enumerate(found):
        n = len(v)
        counts = np.unique(list(v), return_counts=True)[1] / n
        kind = [("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s") for c in v]
        rows[i] = (
            n, kind.count("d") / n, kind.count("u") / n, kind.count("l") / n, kind.count("s") / n, len(counts) / n, -(counts * np.log2(counts)).sum(),
            sum(c in "0123456789abcdefABCDEF" for c in v) / n, mean[i], worst[i], sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / n, cover[i],
            max(map(len, re.findall("d+|u+|l+|s+", "".join(kind)))) / n, v.count("@"), v.count("/"), v.count("."), v.count("-") + v.count("_"),
            quoted, cover_before[i], len(before), cover_after[i], len(after), after[:1].isupper(),
        )
    return rows


def rule_label(value: str, name: str) -> int | None:
    """1 secret, 0 not, None unknown, by format alone."""
    if ISSUED.fullmatch(value):
        return 1
    if ADDRESS.fullmatch(value):
        return 0
    if telling(name):
        return 1
    if not name:
        return 0
    return None


class Forest:
    """Classification trees on bootstrap samples, split by Gini impurity among a
    random root of the features. Trees are arrays, so that rows go down them together."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        self.trees = []
        draw = np.random.default_rng(seed)
        for _ in range(TREES):
            rows = draw.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows], 0, nodes, draw)
            self.trees.append(np.array(nodes, np.float64))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, nodes: list, draw) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y.mean())])
        if depth == DEPTH or len(y) < 2 * LEAF or y.min() == y.max():
            return at
        best = (0.0, -1, 0.0)
        whole = 2 * y.mean() * (1 - y.mean())
        for f in draw.choice(x.shape[1], int(np.sqrt(x.shape[1])) + 1, replace=False):
            cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 18)[1:-1]))
            order = np.argsort(x[:, f], kind="stable")
            seen = np.append(0, np.cumsum(y[order]))
            left = np.searchsorted(x[order, f], cuts, side="right")
            ok = (left >= LEAF) & (len(y) - left >= LEAF)
            if not ok.any():
                continue
            left, cuts = left[ok], cuts[ok]
            p, q = seen[left] / left, (seen[-1] - seen[left]) / (len(y) - left)
            gain = whole - (left * 2 * p * (1 - p) + (len(y) - left) * 2 * q * (1 - q)) / len(y)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), int(f), float(cuts[k]))
        if best[1] < 0:
            return at
        side = x[:, best[1]] <= best[2]
        low = self._grow(x[side], y[side], depth + 1, nodes, draw)
        high = self._grow(x[~side], y[~side], depth + 1, nodes, draw)
        nodes[at][:4] = [best[1], best[2], low, high]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = tree[node, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                goes = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= tree[node, 1], tree[node, 2], tree[node, 3]).astype(np.int64)
                node = np.where(inner, goes, node)
            total += tree[node, 4]
        return total / max(1, len(self.trees))


def corpus_statistics(n_parts: int):
    """Character transitions (65,536 numbers a task) and counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, words = np.zeros(1 << 16, np.int64), Counter()

        def flush() -> pa.RecordBatch:
            keys, counts = words.take()
            return by_part(WORDS, (mix(keys) % np.uint64(n_parts)).astype(np.int64), n_parts, 0, keys, narrow(counts))

        for batch in batches:
            for _, _, buffer, starts in blocks(batch.column(0).to_pylist()):
                data = np.frombuffer(buffer, np.uint8)
                pairs += np.bincount(data[:-1].astype(np.int64) << 8 | data[1:], minlength=1 << 16)
                hashes, begin, end, _ = hashed_spans(buffer, starts)
                words.add(hashes[(end - begin >= PIECES.start) & (end - begin < PIECES.stop)])
                if words.full:
                    yield flush()
        yield flush()
        yield packed_batch([(TRANSITIONS, 0, 0, pack(pairs))])

    return run


def merge_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)

    def words() -> Iterator[pa.RecordBatch]:
        nonlocal total
        for batch in batches:
            own = np.asarray(batch.column(0)) == TRANSITIONS
            for blob in batch.filter(pa.array(own)).column(3).to_pylist():
                total = total + unpack(blob)[0]
            if not own.all():
                yield batch.filter(pa.array(~own))

    yield from merge_counts(words())
    if total.any():
        yield packed_batch([(TRANSITIONS, 0, 0, pack(total))])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def corpus_model(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of transitions (256 x 256), and the hashes of at most
    DICTIONARY frequent words, from all documents."""
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = docs.select("text").mapInArrow(lean(corpus_statistics(n_parts)), PACKED)
    dealt = counted.repartition(n_parts, "kind", "part").sortWithinPartitions("kind", "part")
    merged = written(dealt.mapInArrow(lean(merge_statistics), PACKED), "secret-statistics")
    pairs = np.ones(1 << 16, np.float64)
    for r in merged.where(F.col("kind") == TRANSITIONS).collect():  # a row a part at most
        pairs += unpack(r.blob)[0]
    pairs = pairs.reshape(256, 256)
    words = merged.where(F.col("kind") == WORDS)
    sizes = words.mapInArrow(lean(count_of_counts), "bits int, types long, tokens long").groupBy("bits").agg(F.sum("types").alias("types")).collect()
    floor, so_far = None, 0
    for x in sorted(sizes, key=lambda x: -x.bits):
        so_far += x.types
        if so_far > DICTIONARY:
            break
        floor = x.bits
    head = [unpack(x.blob)[0] for x in words.mapInArrow(lean(frequent_words(floor)), PACKED).collect()] if floor is not None else []  # DICTIONARY words at most
    return np.log(pairs / pairs.sum(1, keepdims=True)), np.concatenate(head) if head else np.zeros(0, np.uint64)


def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All findings of a table (doc_id, text)."""
    for batch in batches:
        found = findings(batch.column("text").to_pylist())
        cols = list(zip(*found, strict=True)) or [()] * 8
        ids = batch.column("doc_id").take(pa.array(cols[0], pa.int64()))
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], ["doc_id", *(x.split()[0] for x in PROPOSED.split(", "))])


PROPOSED = "start long, end long, value string, name string, before string, after string, quoted boolean"


def rule_labels(proposed: DataFrame) -> DataFrame:
    """Findings (doc_id, start, end, secret) that formats decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            secret = [rule_label(v, n) for v, n in zip(batch.column("value").to_pylist(), batch.column("name").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("end"), pa.array(secret, pa.int32())], ["doc_id", "start", "end", "secret"])
            yield out.filter(out.column("secret").is_valid())

    return proposed.mapInArrow(lean(run), f"doc_id {proposed.schema['doc_id'].dataType.simpleString()}, start long, end long, secret int")


def learn(proposed: DataFrame, labelled: DataFrame, transitions: np.ndarray, dictionary: np.ndarray, sample: int = SAMPLE) -> Forest | None:
    """A forest from at most ``sample`` labelled findings of documents that aren't held out."""
    place = ["doc_id", "start", "end"]
    known = labelled.where(~held_out(F.col("doc_id"))).groupBy(*place).agg(F.max("secret").alias("secret"))
    rows = proposed.join(known, place).orderBy(F.xxhash64(*place), *place, "value", "name").limit(sample).collect()
    y = np.array([r.secret for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    found = [(0, r.start, r.end, r.value, r.name, r.before, r.after, r.quoted) for r in rows]
    return Forest(features(found, transitions, Table(dictionary, np.arange(len(dictionary)))), y)


RESULT = "start long, end long, n_chars long, name string, score double, is_secret boolean"


def score_findings(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        dictionary = Table(model["dictionary"], np.arange(len(model["dictionary"])))
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in batch.schema.names]
            found = list(zip(range(batch.num_rows), *cols[1:], strict=True))
            if model["forest"] is None or not found:
                score = np.ones(len(found))
            else:
                score = np.round(model["forest"].predict(features(found, model["transitions"], dictionary)), 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("end"), pa.array([len(v) for v in cols[3]], pa.int64()), batch.column("name"), pa.array(score), pa.array(score >= THRESHOLD)],
                ["doc_id", *(x.split()[0] for x in RESULT.split(", "))],
            )

    return run


def secret_findings(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Every finding in ``docs`` (doc_id, text), with the forest's score;
    ``start`` and ``end`` count code points. Values themselves aren't returned."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    proposed = written(docs.select("doc_id", "text").mapInArrow(lean(propose), f"doc_id {id_type}, {PROPOSED}"), "secret-proposed")
    transitions, dictionary = corpus_model(docs)
    forest = learn(proposed, rule_labels(proposed) if labelled is None else labelled, transitions, dictionary)
    shared = spark.sparkContext.broadcast({"forest": forest, "transitions": transitions, "dictionary": dictionary})
    return proposed.mapInArrow(lean(score_findings(shared)), f"doc_id {id_type}, {RESULT}")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(documents(spark, sf_dir).select("doc_id", "text"))
