"""Token counts under a unigram vocabulary, by dynamic programming over a trie.

A text is split at the six ASCII blanks; each word with the mark U+2581 in
front is a pre-token. Distinct pre-tokens of a block are sorted and form a
trie: the forward score of a node (the best segmentation of that prefix) is
computed once for all pre-tokens that share the prefix, level by level, and
the node where a pre-token ends holds its token count. Counts of words are
kept from block to block, so a word enters a trie once in a task.

Piece scores: the vocabulary's pieces in their order have Zipf's
log-probabilities, in whole micro-nats, so that sums are exact; among equal
scores the segmentation with fewest tokens counts. A character that is no
piece scores ten nats below the last piece and counts its UTF-8 bytes.

Scale: no shuffle. A task holds one block of text, its trie and a cache of
bounded size; the vocabulary is broadcast, whose size is the tokenizer's.

Words of a block are told apart by 64-bit hashes, as are the cached ones.

Defined results: null and blank texts have 0 words and 0 tokens; repeated rows
count each; words of over 63 characters are segmented one by one; of equally
likely segmentations the one with fewest tokens counts; an empty table gives no
rows; a long text is held in its task alone; columns of any name pass through, but
for those named like the results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .sieve import numbered
from .storage import documents, lean, small_batches
from .words import Table, blocks, hashed_spans, mix

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WIDE = 64
CACHE = 1_500_000
BELOW = 10_000_000  # micro-nats of an unknown character below the last piece
FACTOR = 0xD6E8FEB86659FD93
UP = np.cumprod(np.full(WIDE + 1, FACTOR, np.uint64))
DOWN = np.cumprod(np.full(WIDE + 1, pow(FACTOR, -1, 1 << 64), np.uint64))


def vocabulary_pieces(path: str = VOCABULARY) -> list[str]:
    """The ordinary pieces of a sentencepiece model, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


def piece_scores(n: int) -> np.ndarray:
    """Zipf's log-probabilities of n pieces, in micro-nats."""
    rank = np.arange(1, n + 1, dtype=np.float64)
    return np.round(-1e6 * np.log(rank * np.sum(1 / rank))).astype(np.int64)


def prefix_sums(points: np.ndarray) -> np.ndarray:
    """Column k: the polynomial of the first k code points."""
    terms = mix(points.astype(np.uint64) + np.uint64(1)) * UP[: points.shape[1]]
    return np.concatenate([np.zeros((len(points), 1), np.uint64), np.cumsum(terms, axis=1)], axis=1)


def matrix(words: Sequence[str]) -> np.ndarray:
    return np.array(words, dtype=f"<U{WIDE}").view(np.uint32).reshape(len(words), WIDE)


class Pieces:
    def __init__(self, pieces: Sequence[str]):
        short = [(p, s) for p, s in zip(pieces, piece_scores(len(pieces)).tolist(), strict=True) if 0 < len(p) <= WIDE]
        self.score = dict(reversed(short))
        self.longest = max((len(p) for p, _ in short), default=1)
        self.unknown = int(piece_scores(max(1, len(pieces))).min()) - BELOW
        texts = list(self.score)
        sums = prefix_sums(matrix(texts)) if texts else np.zeros((0, WIDE + 1), np.uint64)
        keys = sums[np.arange(len(texts)), [len(t) for t in texts]] * DOWN[0]
        self.table = Table(keys, -np.array([self.score[t] for t in texts], np.int64))

    def count_one(self, word: str) -> int:
        """The same for one word of any length."""
        best = [(0, 0)]
        for end in range(1, len(word) + 1):
            char = word[end - 1]
            choices = [] if char in self.score else [(best[end - 1][0] + self.unknown, best[end - 1][1] - len(char.encode()))]
            for begin in range(max(0, end - self.longest), end):
                s = self.score.get(word[begin:end])
                if s is not None:
                    choices.append((best[begin][0] + s, best[begin][1] - 1))
            best.append(max(choices))
        return -best[-1][1]

    def counts(self, words: Sequence[str]) -> np.ndarray:
        """Token counts of distinct pre-tokens, which must be sorted and shorter than WIDE."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int64)
        points = matrix(words)
        length = np.array([len(w) for w in words])
        deep = int(length.max())
        points = points[:, :deep]
        shared = np.zeros(n, np.int64)
        if n > 1:
            differ = points[1:] != points[:-1]
            shared[1:] = np.where(differ.any(1), differ.argmax(1), deep)
        column = np.arange(deep)
        new = (column >= shared[:, None]) & (column < length[:, None])
        node = np.cumsum(new, axis=0, dtype=np.int32) - 1  # among the nodes of its depth
        sums = prefix_sums(points)
        score, tokens = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for k in range(1, deep + 1):
            rows = np.flatnonzero(new[:, k - 1])
            last = points[rows, k - 1]
            best = np.full(len(rows), np.iinfo(np.int64).min)
            count = np.zeros(len(rows), np.int64)
            for size in range(1, min(k, self.longest) + 1):
                found = self.table.get((sums[rows, k] - sums[rows, k - size]) * DOWN[k - size])
                s = -found
                some = np.flatnonzero(found >= 0)
                more = np.ones(len(some), np.int64)
                if size == 1:
                    unknown = found < 0
                    s[unknown] = self.unknown
                    some = np.arange(len(rows))
                    width = 1 + (last > 0x7F) + (last > 0x7FF) + (last > 0xFFFF)
                    more = np.where(unknown, width, 1)
                if not len(some):
                    continue
                above = node[rows[some], k - size - 1] if k > size else np.zeros(len(some), np.int64)
                total, n_tokens = score[k - size][above] + s[some], tokens[k - size][above] + more
                better = (total > best[some]) | (total == best[some]) & (n_tokens < count[some])
                at = some[better]
                best[at], count[at] = total[better], n_tokens[better]
            score.append(best)
            tokens.append(count)
        out = np.zeros(n, np.int64)
        for k in range(1, deep + 1):
            at = np.flatnonzero(length == k)
            out[at] = tokens[k][node[at, k - 1]]
        return out


_pieces: dict[str, tuple[Pieces, dict[int, int]]] = {}


def count_tokens(shared, name: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _pieces:
            _pieces.clear()
            _pieces[name] = Pieces(shared.value), {}
        pieces, cache = _pieces[name]
        for batch in batches:
            words, tokens = [], []
            for _, n, buffer, starts in blocks(batch.column(text).to_pylist(), lower=False):
                hashes, begin, end, per_text = hashed_spans(buffer, starts)
                distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                known = np.array([cache.get(x, -1) for x in distinct.tolist()], np.int64)
                missing = np.flatnonzero(known < 0)
                if len(missing):
                    spans = zip(begin[first[missing]].tolist(), end[first[missing]].tolist(), missing.tolist(), strict=True)
                    texts = sorted((MARK + buffer[b:e].decode(), i) for b, e, i in spans)
                    usual = [x for x in texts if len(x[0]) < WIDE]
                    known[[i for _, i in usual]] = pieces.counts([w for w, _ in usual])
                    for word, i in texts:
                        if len(word) >= WIDE:
                            known[i] = pieces.count_one(word)
                    if len(cache) > CACHE:
                        cache.clear()
                    cache.update(zip(distinct[missing].tolist(), known[missing].tolist(), strict=True))
                words.append(per_text)
                tokens.append(np.bincount(np.repeat(np.arange(n), per_text), known[which], n).astype(np.int64))
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            keep = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), join(words), join(tokens)], [*keep, "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` with ``n_words`` and ``n_tokens`` of the column ``text``."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in keep if c not in ("n_words", "n_tokens")]
    rows = numbered(docs.select(*keep, text))
    inner = f"c{len(keep)}"
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != inner)
    shared = spark.sparkContext.broadcast(vocabulary_pieces(vocabulary))
    return rows.mapInArrow(lean(count_tokens(shared, vocabulary, inner)), f"{schema}n_words long, n_tokens long").toDF(*keep, "n_words", "n_tokens")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
