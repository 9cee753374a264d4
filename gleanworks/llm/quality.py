"""Quality of whole texts from supervised subword embeddings.

Words, their character n-grams and pairs of neighbouring words are hashed to learned vectors; a document is the mean of
the vectors of all these, and a softmax layer reads the mean. Vectors and layer are trained in numpy by stochastic
gradient descent on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.common import byte_view, ragged, slices, word_pieces, word_spans

BUCKETS = 1 << 17
DIMENSION = 8
NGRAMS = (2, 3, 4)
#: Labelled documents learned from at most.
TRAIN_DOCS = 3000
EPOCHS = 4
RATE = 4.0
#: Buckets of pairs of neighbouring words, after those of words and n-grams.
PAIRS = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return ((x ^ (x >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its n-grams (with a mark at both ends), and where each word's begin."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    sizes = np.diff(offsets) + 2
    starts = np.cumsum(sizes) - sizes
    marked = np.full(int(sizes.sum()), ord("<"), np.uint64)
    marked[ragged(starts + 1, sizes - 2)] = data
    marked[starts + sizes - 1] = ord(">")
    word = np.repeat(np.arange(len(words)), sizes)
    with np.errstate(over="ignore"):
        place = (np.arange(len(marked)) - starts[word]).astype(np.uint64)
        whole = np.add.reduceat((marked + np.uint64(1)) * (place * np.uint64(2) + np.uint64(1)) * (place + _MIX), starts) if len(words) else marked
        owners, found = [np.arange(len(words))], [_bucket(whole * np.uint64(8))]
        for n in NGRAMS:
            code = np.full(max(0, len(marked) - n + 1), n, np.uint64)
            for j in range(n):
                code = code * np.uint64(257) + marked[j:len(marked) - n + 1 + j]
            inside = word[:len(code)] == word[n - 1:] if len(code) else np.zeros(0, bool)
            owners.append(word[:len(code)][inside])
            found.append(_bucket(code[inside] * np.uint64(8) + np.uint64(n)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def word_codes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    place = ragged(np.zeros(len(words), np.int64), np.diff(offsets)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * ((place * np.uint64(2) + np.uint64(1)) * _MIX ^ (place << np.uint64(31))), offsets[:-1] - offsets[0]) if len(words) else np.zeros(0, np.uint64)


def pair_features(codes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word with the one before it in its text, and which words have one before them."""
    inner = np.ones(len(codes), bool)
    inner[before[:-1][before[:-1] < len(codes)]] = False
    second = np.flatnonzero(inner)
    with np.errstate(over="ignore"):
        x = codes[second - 1] * _MIX + codes[second]
        x = (x ^ (x >> np.uint64(31))) * _MIX
        return BUCKETS + ((x ^ (x >> np.uint64(29))) % np.uint64(PAIRS)).astype(np.int64), second


@dataclass
class Model:
    """``pull`` is what each bucket's vector adds to the score of label 1 over label 0; that is all scoring needs."""

    pull: np.ndarray
    shift: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text of a byte view."""
        begins, ends, before = word_spans(data, offsets)
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        if len(begins):
            coded = word_pieces(data, begins, ends).dictionary_encode()
            buckets, starts = word_features(coded.dictionary)
            sums = np.add.reduceat(self.pull[buckets], starts[:-1])
            codes = coded.indices.to_numpy()
            pulls, numbers = sums[codes], np.diff(starts)[codes]
            pairs, second = pair_features(word_codes(coded.dictionary)[codes], before)
            pulls[second] += self.pull[pairs]
            numbers[second] += 1
            running, number = (np.concatenate(([0], np.cumsum(x))) for x in (pulls, numbers))
            total, count = np.diff(running[before]), np.diff(number[before])
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.shift, -40, 40)))


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Bucket vectors and a two-way softmax layer, by stochastic gradient descent, one document at a time."""
    if len(texts) == 0:
        return Model(np.zeros(BUCKETS + PAIRS), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS + PAIRS, DIMENSION)).astype(np.float32)
    layer = rng.normal(0, 0.5, (DIMENSION, 2)).astype(np.float32)
    share = (labels.sum() + 1) / (len(labels) + 2)
    shift = np.log([1 - share, share]).astype(np.float32)
    bags = []
    for text in texts:
        data, offsets = byte_view(pa.array([text], pa.string()))
        begins, ends, before = word_spans(data, offsets)
        found = np.zeros(0, np.int64)
        if len(begins):
            words = word_pieces(data, begins, ends)
            found = np.concatenate([word_features(words)[0], pair_features(word_codes(words), before)[0]])
        buckets, n = np.unique(found, return_counts=True)
        bags.append((buckets.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    steps, turn = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            buckets, share_of = bags[k]
            rate = RATE * (1 - turn / steps)
            turn += 1
            mean = share_of @ vectors[buckets]
            logits = mean @ layer + shift
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[labels[k]] -= 1
            back = layer @ error
            layer -= 0.1 * rate * np.outer(mean, error)
            shift -= 0.02 * rate * error
            # a document's step is spread over its features by share, scaled so that its mean moves by the full step
            vectors[buckets] -= (rate * share_of / max(1e-6, float(share_of @ share_of)))[:, None] * 0.05 * back
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(shift[1] - shift[0]))


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most TRAIN_DOCS labelled rows that ``learn`` allows, drawn by a hash of the id."""
    drawn = (labels.where(learn & F.col("quality").isin(0, 1)).select("doc_id", "quality")
             .orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "quality").limit(TRAIN_DOCS))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").collect()  # at most TRAIN_DOCS of different id
    rows = sorted((r["doc_id"], r["text"] or "", r["quality"]) for r in rows)
    return [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, score (probability of label 1 from the text alone) and predicted (1 if score >= threshold) of every row.

    ``labels`` has doc_id and quality; rows that ``learn`` refuses, null labels and values other than 0 and 1 are not
    learned from. Null and empty texts get the score of no evidence. Without anything to learn from, every score is 0.5.
    Other columns are ignored; repeated rows each get a row; an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = train(*training_sample(docs, labels.select(F.col("doc_id").cast("long"), "quality"), learn), epochs=epochs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            score = model.scores(*byte_view(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             ["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")
