"""Language-model scores from a probabilistic suffix tree.

A text is the sequence of its lower-cased words, each followed by a space, and
an end symbol. The tree's states are suffixes of what precedes a symbol. Near
the root they are up to six bytes and predict the next byte; beyond them
stand ``PHRASE`` whole words, which predict the next word with its space.

A state is retained if it occurs often enough (``LEAST`` times for bytes,
``LEAST_PHRASE`` for words), whatever the corpus, and the likelihood gain of
its distribution over that of the suffix below it (count times Kullback-Leibler
divergence) exceeds ``DIVERGENCE`` for each symbol that follows it. For words
the share of the next word among all words, rounded up to a power of two,
stands for the suffix's probability. Byte distributions are smoothed by
absolute discounting towards their suffix's, down to add-one counts of single
bytes; word distributions keep the discounted counts of words that follow
twice or more, and give the rest of their mass to the byte states' probability
of the word. A position is scored in its longest retained suffix.

Scale: counts of seven-byte strings and of words are summed in every task
before they are shuffled, as sorted arrays, and merged by key range; one hot
key is one number from each task. The tree grows with the corpus. Texts are
packed into chunks once. Each chunk asks the parts that hold the counts, by
sorted distinct keys: fingerprints of its phrases, which are counted there in
the same step, its rare words, and, where the byte states outgrow a broadcast
(``ENTRIES``), its seven-byte strings. Answers stand in the order of the keys,
so keys travel one way only. A part holds one share of the keys, by
``spark.sql.shuffle.partitions``. Of the words' counts at most ``HEAD`` are
broadcast, the others are asked, so nothing is dropped.

Words are told apart by 64-bit hashes: among a billion distinct words about
one pair in a run of forty meets. The fingerprint of a phrase has eight bits
more than the corpus has tokens: one in some hundred meets another, and then
its count rises; a next word passes for another in one case of 4096.

Defined results: null and empty texts are one end symbol; a null doc_id counts
as the empty string where documents are held out, and ids keep their type;
repeated rows are scored (and counted) each; without training text every byte
has probability 1/256; an empty table gives no rows; other columns are not
read, whatever their names; a text is held whole in one task, however long;
equal counts have no order that matters.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import documents, lean, small_batches, written
from .words import MULTIPLIER, PAD, Counter, Table, blocks, counted, hashed_spans, hashed_words, mix, pack, unpack

DEPTH = 6  # bytes
PHRASE = 3  # words
LEAST, LEAST_PHRASE = 8, 2  # a state's least count
DISCOUNT = 0.75
DIVERGENCE = 3.0  # nats for each symbol seen after the state
HEAD = 500_000
ENTRIES = 4_000_000  # byte states and strings that are broadcast at most
CHUNK, BY_PART = 3_000_000, 1000  # bytes of text that are scored together: so many, or so many for each part if that is more
COUNTED = 2_000_000  # keys that a task counts before it passes their sums on
CONTEXT_BITS, WORD_BITS = 8, 12  # of a phrase's fingerprint: beyond the corpus's tokens, and for the next word
GRAMS, WORDS, TAIL, ASK, PHRASES, ROWS = range(6)
CLOSING = b" "
PACKED = "kind int, part int, pid long, blob binary"


def packed_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kind, part, pid, blob = zip(*rows, strict=True) if rows else ((), (), (), ())
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((kind, part, pid, blob), types, strict=True)], ["kind", "part", "pid", "blob"])


def dense(*arrays: np.ndarray) -> bytes:
    """``pack`` with all numbers byte by byte, compressed."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) for a in arrays]
    return pickle.dumps([(a.dtype.str, x.nbytes, pa.compress(x, "zstd", asbytes=True)) for a, x in zip(arrays, planes, strict=True)], protocol=5)


def undense(blob: bytes) -> tuple[np.ndarray, ...]:
    arrays = []
    for kind, size, data in pickle.loads(blob):
        dtype = np.dtype(kind)
        plane = np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True), np.uint8).reshape(dtype.itemsize, -1)
        arrays.append(np.ascontiguousarray(plane.T).view(dtype).ravel())
    return tuple(arrays)


def squeezed(keys: np.ndarray, *others: np.ndarray) -> bytes:
    """``dense`` for keys in order: their steps."""
    return dense(np.diff(keys, prepend=keys.dtype.type(0)), *others)


def unsqueezed(blob: bytes) -> tuple[np.ndarray, ...]:
    steps, *others = undense(blob)
    return np.cumsum(steps, dtype=steps.dtype), *others


def part_slices(part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries in the order of their parts, and where each part begins."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n + 1))


def by_part(kind: int, part: np.ndarray, n: int, pid: int, *arrays: np.ndarray, pack=pack) -> pa.RecordBatch:
    """One packed row for each part that has entries."""
    order, cut = part_slices(part, n)
    arrays = tuple(a[order] for a in arrays)
    return packed_batch([(kind, p, pid, pack(*(a[cut[p] : cut[p + 1]] for a in arrays))) for p in range(n) if cut[p] < cut[p + 1]])


def narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32) if not len(counts) or counts.max() < 1 << 32 else counts


def layout(buffer: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, and the positions that are scored."""
    data = np.frombuffer(buffer, np.uint8)
    scored = np.ones(len(data), bool)
    scored[0] = False
    scored[(starts[:, None] - np.arange(1, PAD + 1)).ravel()] = False
    return data, np.flatnonzero(scored)


def strings(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The symbol at each position, after it its context (nearest byte first), as one number."""
    words = np.zeros(len(data), np.uint64)  # eight bytes that begin DEPTH before a position
    for shift in range(8):
        own = data[shift : shift + (len(data) - shift) // 8 * 8].view("<u8")
        words[shift + DEPTH :: 8][: len(own)] = own
    for i in range(max(DEPTH, len(data) - 7 + DEPTH), len(data)):  # fewer than eight bytes are left
        words[i] = int.from_bytes(data[i - DEPTH : i + 1].tobytes(), "little")
    return words[at] & np.uint64((1 << 8 * (DEPTH + 1)) - 1)


def context_first(keys: np.ndarray) -> np.ndarray:
    """Strings with the symbol last, so that those of one context follow each other."""
    return keys << np.uint64(8) & np.uint64((1 << 8 * (DEPTH + 1)) - 1) | keys >> np.uint64(8 * DEPTH)


def string_part(context: np.ndarray, n_parts: int) -> np.ndarray:
    """Strings are dealt by their two nearest context bytes, so that a part holds whole subtrees."""
    return (mix(context >> np.uint64(8 * (DEPTH - 2))) % np.uint64(n_parts)).astype(np.int64)


def asked_part(keys: np.ndarray, n_parts: int) -> np.ndarray:
    return string_part(keys & np.uint64((1 << 8 * DEPTH) - 1), n_parts)


def word_part(words: np.ndarray, n_parts: int) -> np.ndarray:
    return (mix(words) % np.uint64(n_parts)).astype(np.int64)


def phrase_part(keys: np.ndarray, n_parts: int) -> np.ndarray:
    return word_part(keys >> np.uint64(WORD_BITS), n_parts)


def phrases(words: np.ndarray, per_text: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with ``PHRASE`` words before them in their text, and fingerprints of
    these words (``bits`` bits) and of the word itself (``WORD_BITS``)."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    at = np.flatnonzero(place >= PHRASE)
    context = np.zeros(len(at), np.uint64)
    for j in range(PHRASE, 0, -1):
        context = mix(context * np.uint64(MULTIPLIER) + words[at - j])
    return at, context >> np.uint64(64 - bits) << np.uint64(WORD_BITS) | mix(words[at]) >> np.uint64(64 - WORD_BITS)


def count_strings(n_parts: int, base: bool = False):
    """Of training texts: seven-byte strings (nearest context byte first, the
    next symbol last; none for the base alone) and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words, texts = Counter(COUNTED), Counter(COUNTED), 0
        for batch in batches:
            for _, n, buffer, starts in blocks(batch.column(0).to_pylist(), closing=CLOSING):
                texts += n
                if not base:
                    grams.add(context_first(strings(*layout(buffer, starts))))
                words.add(hashed_words(buffer, starts)[0])
                for kind, counter in ((GRAMS, grams), (WORDS, words)):
                    if counter.full:
                        yield flush(kind, counter)
        for kind, counter in ((GRAMS, grams), (WORDS, words)):
            yield flush(kind, counter)
        yield packed_batch([(ROWS, 0, 0, pack(np.array([texts])))])

    def flush(kind: int, counter: Counter) -> pa.RecordBatch:
        keys, counts = counter.take()
        part = string_part(keys >> np.uint64(8), n_parts) if kind == GRAMS else word_part(keys, n_parts)
        return by_part(kind, part, n_parts, 0, keys, narrow(counts), pack=squeezed if kind == GRAMS else pack)

    return run


def merge_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum packed counts that come sorted by (kind, part)."""
    now, counter = None, Counter(COUNTED)

    def done() -> pa.RecordBatch:
        keys, counts = counter.take()
        return packed_batch([(*now, 0, (squeezed if now[0] == GRAMS else pack)(keys, narrow(counts)))])

    for batch in batches:
        for kind, part, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (kind, part) != now:
                if now:
                    yield done()
                now = kind, part
            keys, counts = (unsqueezed if kind == GRAMS else unpack)(blob)
            counter.add(keys, counts.astype(np.int64))
    if now:
        yield done()


def two_byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = np.zeros(1 << 16, np.int64)
        for blob in batch.column("blob").to_pylist():
            keys, counts = unsqueezed(blob)
            pair = (keys >> np.uint64(8 * DEPTH) << np.uint64(8) | keys & np.uint64(255)).astype(np.int64)
            np.add.at(total, pair, counts.astype(np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


def estimates(count, total, types, low):
    return (np.maximum(count - DISCOUNT, 0) + DISCOUNT * types * low) / total


def first_orders(pairs: np.ndarray) -> np.ndarray:
    """The distribution after each single byte; where that isn't retained, of single bytes."""
    n = pairs.reshape(256, 256).astype(np.float64)
    root = (n.sum(0) + 1) / (n.sum() + 256)
    total, types = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(n > 0, n * np.log(n / total / root), 0).sum(1)
        keep = (total[:, 0] >= LEAST) & (gain > DIVERGENCE * types[:, 0])
        return np.where(keep[:, None], estimates(n, total, types, root), root)


def retained_levels(keys: np.ndarray, counts: np.ndarray, order1: np.ndarray) -> Iterator[tuple]:
    """For two to DEPTH bytes: the contexts that pass the tests, their back-off
    weights, and the strings of them and a symbol seen after them, with its probability."""
    counts = counts.astype(np.float64)
    below = None
    for d in range(2, DEPTH + 1):
        context = keys >> np.uint64(8 * (DEPTH - d + 1))
        both, n = counted(context << np.uint64(8) | keys & np.uint64(255), counts)
        context = both >> np.uint64(8)
        symbol = (both & np.uint64(255)).astype(np.int64)
        begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        types = np.diff(np.append(begin, len(both)))
        which = np.repeat(np.arange(len(begin)), types)
        total = np.add.reduceat(n, begin)
        nearer = context >> np.uint64(8)
        if below is None:
            low = order1[nearer.astype(np.int64), symbol]
        else:
            low = below[1][np.searchsorted(below[0], nearer << np.uint64(8) | symbol.astype(np.uint64))]
        gain = np.add.reduceat(n * np.log(n / total[which] / low), begin)
        keep = (total >= LEAST) & (gain > DIVERGENCE * types)
        p = np.where(keep[which], estimates(n, total[which], types[which], low), low)
        below = both, p
        if keep.any():
            seen = keep[which]
            yield d, context[begin][keep], (DISCOUNT * types[keep] / total[keep]).astype(np.float32), both[seen], p[seen].astype(np.float32)


def retained_contexts(order1: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                for d, *arrays in retained_levels(*unsqueezed(blob), order1):
                    yield packed_batch([(d, 0, 0, pack(*arrays))])

    return run


def number_of_entries(order1: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [sum(len(context) + len(both) for _, context, _, both, _ in retained_levels(*unsqueezed(blob), order1)) for blob in batch.column("blob").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

    return run


def joined_levels(parts: list[tuple[int, bytes]]) -> list[tuple]:
    """The contexts of all parts, by length and in order."""
    levels = []
    for d in range(2, DEPTH + 1):
        own = [unpack(blob) for depth, blob in parts if depth == d]
        if own:
            context, back, both, p = (np.concatenate(x) for x in zip(*own, strict=True))
            by_context, by_string = np.argsort(context), np.argsort(both)
            levels.append((d, context[by_context], back[by_context], both[by_string], p[by_string]))
    return levels


def string_logs(keys: np.ndarray, order1: np.ndarray, levels: list[tuple]) -> np.ndarray:
    """log10 probability of the first symbol of each string (in order), in its
    longest retained context. Strings that agree that far share a length's search."""
    heads = np.flatnonzero(np.append(True, keys[1:] >> np.uint64(8 * (DEPTH - 1)) != keys[:-1] >> np.uint64(8 * (DEPTH - 1))))
    pair = (keys[heads] >> np.uint64(8 * (DEPTH - 1))).astype(np.int64)
    p = order1[pair & 255, pair >> 8]
    for d, contexts, back, both, own in levels:
        beyond = np.uint64(8 * (DEPTH - d))
        short = keys >> beyond
        here = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
        p, heads = p[np.searchsorted(heads, here, side="right") - 1], here
        short = short[here]
        context, symbol = short & np.uint64((1 << 8 * d) - 1), short >> np.uint64(8 * d)
        at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        on = np.flatnonzero(contexts[at] == context)
        string = context[on] << np.uint64(8) | symbol[on]
        spot = np.minimum(np.searchsorted(both, string), len(both) - 1)
        p[on] = np.where(both[spot] == string, own[spot], back[at[on]] * p[on])
    return np.repeat(np.log10(p), np.diff(np.append(heads, len(keys)))) if len(keys) else np.zeros(0)


def phrase_states(keys: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all fingerprints in order, with their counts in training texts and the
    share of the next word among all words: the discounted probability of the word in
    the phrase's state, and the state's weight of what lies below (1: not retained)."""
    context = keys >> np.uint64(WORD_BITS)
    begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    which = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(keys))))
    n = n.astype(np.float64)
    total = np.add.reduceat(n, begin)
    own = np.where(n >= 2, n - DISCOUNT, 0) / np.maximum(total, 1)[which]
    back = 1 - np.add.reduceat(own, begin)
    gain = np.add.reduceat(n * np.log(own / share + back[which]), begin)
    keep = (total >= LEAST_PHRASE) & (gain > DIVERGENCE * np.add.reduceat((n > 0).astype(np.int64), begin))
    return np.where(keep[which], own, 0.0), np.where(keep, back, 1.0)[which]


def pack_texts(most: int):
    """Chunks of texts (text, id, held out), each with a number of its own."""

    def done(pid: int, ids: list, held: list, texts: list) -> pa.RecordBatch:
        return packed_batch([(ROWS, 0, pid, pickle.dumps((pa.concat_arrays(ids), np.concatenate(held), texts), protocol=5))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, size = TaskContext.get().partitionId() << 32, 0
        ids, held, texts = [], [], []
        for batch in batches:
            for first, n, buffer, starts in blocks(batch.column(0).to_pylist(), closing=CLOSING):
                ids.append(batch.column(1).slice(first, n))
                held.append(np.array(batch.column(2).slice(first, n).to_pylist(), bool))
                texts.append((pa.compress(buffer, "zstd", asbytes=True), len(buffer), starts))
                size += len(buffer)
                if size >= most:
                    yield done(pid, ids, held, texts)
                    pid, size, ids, held, texts = pid + 1, 0, [], [], []
        if texts:
            yield done(pid, ids, held, texts)

    return run


class Chunk:
    """The texts of a packed row, and the sorted distinct keys that they ask for."""

    def __init__(self, blob: bytes, bits: int | None, head: Table):
        self.ids, self.held, texts = pickle.loads(blob)
        self.buffers = [(pa.decompress(data, size, "zstd", asbytes=True), starts) for data, size, starts in texts]
        spans = [hashed_spans(*b) for b in self.buffers]
        self.words = np.concatenate([s[0] for s in spans])
        self.per_text = np.concatenate([s[3] for s in spans])
        self.spans = [s[1:3] for s in spans]
        self.count = head.get(self.words)
        self.rare = np.unique(self.words[self.count < 0])
        if bits is not None:  # None: the base alone
            self.at, keys = phrases(self.words, self.per_text, bits)
            self.phrases, self.phrase = np.unique(keys, return_inverse=True)

    def strings(self) -> np.ndarray:
        counter = Counter(2_000_000)
        for b in self.buffers:
            counter.add(strings(*layout(*b)))
        return counter.take()[0]

    def phrase_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """In training texts; and which power of two the frequent words' counts stay below (0: rare words)."""
        text = np.repeat(np.arange(len(self.per_text)), self.per_text)
        n = np.bincount(self.phrase, ~self.held[text[self.at]], len(self.phrases)).astype(np.int64)
        level = np.zeros(len(self.phrases), np.uint8)
        count = self.count[self.at]
        level[self.phrase] = np.where(count > 0, 1 + np.log2(np.maximum(count, 1)), 0).astype(np.uint8)
        return narrow(n), level


_heads: dict[str, Table] = {}


def head_of(model: dict) -> Table:
    """The frequent words' counts; a worker keeps the last model's table."""
    if model["id"] not in _heads:
        _heads.clear()
        _heads[model["id"]] = Table(*model["head"])
    return _heads[model["id"]]


def ask(shared, n_parts: int):
    """What the chunks ask: sorted distinct keys, by kind and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for pid, blob in zip(batch.column("pid").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                chunk = Chunk(blob, model["bits"], head_of(model))
                yield by_part(TAIL, word_part(chunk.rare, n_parts), n_parts, pid, chunk.rare, pack=squeezed)
                if model["bits"] is None:
                    continue
                yield by_part(PHRASES, phrase_part(chunk.phrases, n_parts), n_parts, pid, chunk.phrases, *chunk.phrase_counts(), pack=squeezed)
                if model["levels"] is None:
                    keys = chunk.strings()
                    yield by_part(ASK, asked_part(keys, n_parts), n_parts, pid, keys, pack=squeezed)

    return run


def answer(order1: np.ndarray | None, n_train: int, rare_share: float):
    """Asked keys meet the counts of their part, which come first; values go back
    in the order of the keys."""

    def of_phrases(part: int, asked: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        keys, n, level = (np.concatenate(x) for x in zip(*(unsqueezed(blob) for _, blob in asked), strict=True))
        order = np.argsort(keys)
        keys = keys[order]
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, n, level = keys[begin], np.add.reduceat(n[order], begin, dtype=np.int64), np.maximum.reduceat(level[order], begin)
        which = np.empty(len(order), np.int32)
        which[order] = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(np.append(begin, len(order))))
        del order, begin
        share = np.minimum(np.where(level > 0, np.exp2(level, dtype=np.float64) / max(1, n_train), rare_share), 1.0)
        own, back = phrase_states(keys, n, share)
        end = 0
        for pid, blob in asked:
            mine = which[end : (end := end + len(undense(blob)[0]))]
            on = np.flatnonzero(back[mine] < 1)
            yield packed_batch([(PHRASES, part, pid, squeezed(on.astype(np.uint32), own[mine[on]].astype(np.float32), back[mine[on]].astype(np.float32)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, levels, counts, asked = None, [], (np.zeros(0, np.uint64), np.zeros(0, np.int64)), []
        for batch in batches:
            for kind, part, pid, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part != now:
                    if asked:
                        yield from of_phrases(now, asked)
                    now, levels, counts, asked = part, [], (np.zeros(0, np.uint64), np.zeros(0, np.int64)), []
                if kind == GRAMS:
                    levels = list(retained_levels(*unsqueezed(blob), order1))
                elif kind == WORDS:
                    counts = unpack(blob)
                elif kind == PHRASES:
                    asked.append((pid, blob))
                elif kind == ASK:
                    (keys,) = unsqueezed(blob)
                    yield packed_batch([(ASK, part, pid, dense(string_logs(keys, order1, levels).astype(np.float32)))])
                else:
                    (words,) = unsqueezed(blob)
                    keys, n = counts
                    at = np.minimum(np.searchsorted(keys, words), max(0, len(keys) - 1))
                    found = np.where(keys[at] == words, n[at], 0) if len(keys) else np.zeros(len(words), np.int64)
                    yield packed_batch([(TAIL, part, pid, dense(narrow(found.astype(np.int64))))])
        if asked:
            yield from of_phrases(now, asked)

    return run


BASE = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double"
RESULT = f"{BASE}, score double, per_token double, n_in_phrase long"


def finish(shared, n_parts: int, ends: int, n_train: int, n_types: int):
    """Texts meet the answers to what their chunk asked; texts come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for kind, part, blob in zip(batch.column("kind").to_pylist(), batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if kind != ROWS:
                    answers.setdefault(kind, []).append((part, blob))
                    continue
                yield scored(shared.value, blob, answers)
                answers = {}

    def scored(model: dict, blob: bytes, answers: dict[int, list[tuple[int, bytes]]]) -> pa.RecordBatch:
        chunk = Chunk(blob, model["bits"], head_of(model))
        n_texts = len(chunk.per_text)
        of = np.repeat(np.arange(n_texts), chunk.per_text)

        rare = np.zeros(len(chunk.rare), np.int64)
        order, cut = part_slices(word_part(chunk.rare, n_parts), n_parts)
        for part, values in answers.get(TAIL, []):
            rare[order[cut[part] : cut[part + 1]]] = undense(values)[0]
        count = chunk.count
        unknown = count < 0
        count[unknown] = rare[np.searchsorted(chunk.rare, chunk.words[unknown])]

        tokens = chunk.per_text + 1
        base = np.bincount(of, np.log10(count + 1.0), n_texts) + np.log10(ends + 1.0) - tokens * np.log10(n_train + n_types + 1.0)
        known = np.bincount(of, count > 0, n_texts).astype(np.int64) + (ends > 0)
        columns = [pa.array(chunk.held), pa.array(tokens), pa.array(known), pa.array(np.full(n_texts, n_train)), pa.array(base)]
        if model["bits"] is None:
            return pa.RecordBatch.from_arrays([chunk.ids, *columns], ["doc_id", *(x.split()[0] for x in BASE.split(", "))])

        logs = byte_logs(model, chunk, answers.get(ASK, []))
        word_logs, end_logs = (np.concatenate(x) for x in zip(*logs, strict=True))
        own, back = np.zeros(len(chunk.phrases)), np.ones(len(chunk.phrases))
        order, cut = part_slices(phrase_part(chunk.phrases, n_parts), n_parts)
        for part, values in answers.get(PHRASES, []):
            on, a, b = unsqueezed(values)
            at = order[cut[part] : cut[part + 1]][on]
            own[at], back[at] = a, b
        own, back = own[chunk.phrase], back[chunk.phrase]
        on = np.flatnonzero(back < 1)
        at = chunk.at[on]
        word_logs[at] = np.log10(own[on] + back[on] * 10.0 ** word_logs[at])

        score = np.bincount(of, word_logs, n_texts) + end_logs
        columns += [pa.array(np.round(score, 6)), pa.array(np.round(score / tokens, 6)), pa.array(np.bincount(of[at], minlength=n_texts))]
        return pa.RecordBatch.from_arrays([chunk.ids, *columns], ["doc_id", *(x.split()[0] for x in RESULT.split(", "))])

    def byte_logs(model: dict, chunk: Chunk, asked: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """log10 probability of every word with its space, and of the texts' ends."""
        if model["levels"] is None:
            keys = chunk.strings()
            logs = np.zeros(len(keys))
            order, cut = part_slices(asked_part(keys, n_parts), n_parts)
            for part, values in asked:
                logs[order[cut[part] : cut[part + 1]]] = undense(values)[0]
        for (buffer, starts), (begin, end) in zip(chunk.buffers, chunk.spans, strict=True):
            data, at = layout(buffer, starts)
            own = strings(data, at)
            if model["levels"] is None:
                of_position = logs[np.searchsorted(keys, own)]
            else:
                distinct, which = np.unique(own, return_inverse=True)
                of_position = string_logs(distinct, model["order1"], model["levels"])[which]
            so_far = np.zeros(len(data) + 1)
            so_far[at + 1] = of_position
            feeds = np.append(starts[1:] - PAD, len(data))  # right behind the texts' ends
            of_end = so_far[feeds]
            np.cumsum(so_far, out=so_far)
            yield so_far[end + 1] - so_far[begin], of_end

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def byte_states(grams: DataFrame) -> tuple[np.ndarray, list[tuple] | None]:
    """The distributions after single bytes, and the retained contexts if they are few enough to be broadcast."""
    pairs = np.zeros(1 << 16, np.int64)
    for x in grams.mapInArrow(lean(two_byte_counts), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        pairs[x.pair] = x.n
    order1 = first_orders(pairs)
    entries = grams.mapInArrow(lean(number_of_entries(order1)), "n long").agg(F.sum("n")).first()[0] or 0
    if entries > ENTRIES:
        return order1, None
    return order1, joined_levels([(x.kind, x.blob) for x in grams.mapInArrow(lean(retained_contexts(order1)), PACKED).collect()])


def suffix_tree_scores(docs: DataFrame, base: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) → doc_id and the columns of ``RESULT``, learning
    from the documents that aren't held out. ``per_token`` is the score of a token
    on average, ``n_in_phrase`` the number of words that were scored after a
    retained phrase. With ``base`` only the columns of ``BASE``, by the same steps
    without the tree, which they don't depend on."""
    spark = docs.sparkSession
    small_batches(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("text", "doc_id", held_out(F.col("doc_id")).alias("held"))
    counts = texts.where("not held").select("text").mapInArrow(lean(count_strings(n_parts, base)), PACKED)
    dealt = counts.repartition(n_parts, "kind", "part").sortWithinPartitions("kind", "part")
    merged = written(dealt.mapInArrow(lean(merge_or_keep), PACKED), "suffix-counts")

    grams, words = merged.where(F.col("kind") == GRAMS), merged.where(F.col("kind") == WORDS)
    order1, levels = (None, []) if base else byte_states(grams)
    ends = sum(int(unpack(x.blob)[0].sum()) for x in merged.where(F.col("kind") == ROWS).collect())  # one row a part
    sizes = words.mapInArrow(lean(count_of_counts), "bits int, types long, tokens long").groupBy("bits").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect()  # 64 * 16 rows at most
    n_types = sum(x.types for x in sizes) + (ends > 0)
    n_train = sum(x.tokens for x in sizes) + ends
    floor, so_far = None, 0
    for x in sorted(sizes, key=lambda x: -x.bits):
        so_far += x.types
        if so_far > HEAD:
            break
        floor = x.bits
    head = [unpack(x.blob) for x in words.mapInArrow(lean(frequent_words(floor)), PACKED).collect()] if floor is not None else []  # HEAD words at most
    keys = np.concatenate([x[0] for x in head]) if head else np.zeros(0, np.uint64)
    values = np.concatenate([x[1] for x in head]).astype(np.int64) if head else np.zeros(0, np.int64)
    rarest = max((x.bits for x in sizes), default=0) + 1 if floor is None else floor  # rare words' counts stay below 2 ** (rarest / 16)
    bits = None if base else min(64 - WORD_BITS, max(32, n_train.bit_length() + CONTEXT_BITS))
    shared = spark.sparkContext.broadcast({"id": uuid.uuid4().hex, "bits": bits, "order1": order1, "levels": levels, "head": (keys, values)})

    chunks = written(texts.mapInArrow(lean(pack_texts(max(CHUNK, BY_PART * n_parts))), PACKED), "suffix-chunks")
    asked = chunks.mapInArrow(lean(ask(shared, n_parts)), PACKED)
    asked = asked.unionByName(words if levels is not None else words.unionByName(grams))
    met = asked.repartition(n_parts, "part").sortWithinPartitions("part", "kind", "pid")
    answers = met.mapInArrow(lean(answer(order1, n_train, 2.0 ** (rarest / 16) / max(1, n_train))), PACKED)
    rows = answers.unionByName(chunks).repartition(n_parts, "pid").sortWithinPartitions("pid", "kind")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(finish(shared, n_parts, ends, n_train, n_types)), f"doc_id {id_type}, {BASE if base else RESULT}")


def level_of(counts: np.ndarray) -> np.ndarray:
    """Sixteen steps for each doubling of a count."""
    return np.floor(16 * np.log2(counts.astype(np.float64))).astype(np.int64)


def count_of_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            _, counts = unpack(blob)
            bits, types = counted(level_of(counts))
            tokens = np.bincount(np.searchsorted(bits, level_of(counts)), counts.astype(np.float64), len(bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bits.astype(np.int32)), pa.array(types), pa.array(tokens)], ["bits", "types", "tokens"])


def frequent_words(floor: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                keys, counts = unpack(blob)
                on = level_of(counts) >= floor
                yield packed_batch([(WORDS, 0, 0, pack(keys[on], counts[on]))])

    return run


def merge_or_keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``merge_counts``, but for the numbers of texts, which are few and pass."""

    def grams_and_words() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.asarray(batch.column(0))
            if (kinds == ROWS).any():
                passed.append(batch.filter(pa.array(kinds == ROWS)))
            if (kinds != ROWS).any():
                yield batch.filter(pa.array(kinds != ROWS))

    passed: list[pa.RecordBatch] = []
    yield from merge_counts(grams_and_words())
    total = sum(int(unpack(blob)[0].sum()) for b in passed for blob in b.column("blob").to_pylist())
    if passed:
        yield packed_batch([(ROWS, 0, 0, pack(np.array([total])))])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(documents(spark, sf_dir).select("doc_id", "text"))


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(documents(spark, sf_dir).select("doc_id", "text"), base=True)
