"""Language of whole texts by a byte convolutional network over fixed-length windows.

Filters of several widths slide over the bytes of a window, each is max-pooled over the window, and a softmax layer reads
the pooled values. The network is trained in numpy on a bounded sample of labelled windows; texts are then cut into
windows, batch by batch, and the window probabilities averaged by length.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.common import byte_view, ragged, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Labelled documents looked at per language, and windows taken from each: the bounds of the training sample.
DOCS_PER_LANGUAGE = 1500
WINDOWS_PER_DOC = 2
EPOCHS = 8
#: Steps at least: small samples are gone through more often.
STEPS = 400
_BATCH = 64
UNDETERMINED = "und"


@dataclass
class Network:
    """``taps[w][j]`` is what byte values add to each filter of width ``w`` at offset ``j``."""

    languages: list[str]
    taps: dict[int, np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    shift: np.ndarray

    @functools.cached_property
    def _pairs(self) -> dict[int, list[np.ndarray]]:
        """Per width the taps of two bytes at a time as one table (and a single byte left over)."""
        tables = {}
        for w, taps in self.taps.items():
            parts = [(taps[j][:, None] + taps[j + 1][None]).reshape(65536, -1) for j in range(0, w - 1, 2)]
            tables[w] = parts + ([np.ascontiguousarray(taps[w - 1])] if w % 2 else [])
        return tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """One row per window, one column per language."""
        pooled = np.empty((len(windows), len(self.bias)), np.float32)
        for k in range(0, len(windows), 512):
            part = windows[k:k + 512]
            pairs = part[:, :-1].astype(np.intp) * 256 + part[:, 1:]
            for n, (w, tables) in enumerate(self._pairs.items()):
                places = WINDOW - w + 1
                heard = tables[0].take(pairs[:, :places].ravel(), axis=0)
                for j, table in enumerate(tables[1:], 1):
                    index = (part if len(table) == 256 else pairs)[:, 2 * j:2 * j + places]
                    heard += table.take(index.ravel(), axis=0)
                pooled[k:k + 512, n * FILTERS:(n + 1) * FILTERS] = heard.reshape(len(part), places, FILTERS).max(axis=1)
        return softmax(np.maximum(pooled + self.bias, 0) @ self.weights + self.shift)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Stochastic gradient descent (Adam steps) on the cross entropy of labelled windows."""
    rng = np.random.default_rng(seed)
    n_filters, n_lang = FILTERS * len(WIDTHS), len(languages)
    state = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    net = Network(languages, state, np.zeros(n_filters, np.float32),
                  rng.normal(0, 0.2, (n_filters, n_lang)).astype(np.float32), np.zeros(n_lang, np.float32))
    params = [*state.values(), net.bias, net.weights, net.shift]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    epochs = max(epochs, -(-STEPS * _BATCH // max(1, len(windows))))
    turn, rate = 0, 0.01
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for k in range(0, len(order), _BATCH):
            part, want = windows[order[k:k + _BATCH]], labels[order[k:k + _BATCH]]
            rows = np.arange(len(part))
            best, where = [], []
            for w in WIDTHS:
                places = WINDOW - w + 1
                heard = state[w][0][part[:, :places]]
                for j in range(1, w):
                    heard += state[w][j][part[:, j:j + places]]
                at = heard.argmax(axis=1)
                where.append(at)
                best.append(np.take_along_axis(heard, at[:, None], axis=1)[:, 0])
            pooled = np.concatenate(best, axis=1) + net.bias
            active = np.maximum(pooled, 0)
            error = softmax(active @ net.weights + net.shift)
            error[rows, want] -= 1
            error /= len(part)
            back = (error @ net.weights.T) * (pooled > 0)
            grads = []
            for n, w in enumerate(WIDTHS):
                grad = np.zeros_like(state[w])
                mine = back[:, n * FILTERS:(n + 1) * FILTERS]
                for j in range(w):
                    np.add.at(grad[j], (part[rows[:, None], where[n] + j], np.arange(FILTERS)), mine)
                grads.append(grad)
            grads += [back.sum(axis=0), active.T @ error, error.sum(axis=0)]
            turn += 1
            step = rate * 0.5 ** (3 * epoch // epochs) * np.sqrt(1 - 0.999**turn) / (1 - 0.9**turn)
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= step * m / (np.sqrt(v) + 1e-8)
    return net


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (the last of each filled up with zero bytes), their text and their length."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    first = np.cumsum(n) - n
    flat = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    flat[ragged(first * WINDOW, sizes)] = data
    row = np.repeat(np.arange(len(sizes)), n)
    length = np.minimum(WINDOW, sizes[row] - (np.arange(len(row)) - first[row]) * WINDOW)
    return flat.reshape(-1, WINDOW), row, length


def training_sample(docs: DataFrame, learn: Column) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and languages of a bounded sample of the rows that ``learn`` allows.

    The documents are drawn by a hash of the id, at a rate that gives about DOCS_PER_LANGUAGE of each language; windows
    lie anywhere in the text.
    """
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in docs.where(learn & F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    rate = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, DOCS_PER_LANGUAGE / n))))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            windows, row, length = cut_windows(*byte_view(part.column("text")))
            spread = (np.arange(len(row)) * 2654435761 + row * 40503) % 4294967296  # which windows of a text are taken
            order = np.lexsort((spread, row))
            rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
            taken = order[rank < WINDOWS_PER_DOC]
            yield pa.RecordBatch.from_arrays(
                [part.column("lang").take(pa.array(row[taken])), pa.array([windows[k].tobytes() for k in taken], pa.binary())], ["lang", "window"])

    rows = sorted((r["lang"], bytes(r["window"])) for r in drawn.mapInArrow(run, "lang string, window binary").collect())
    languages = sorted({lang for lang, _ in rows})
    windows = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    return windows, np.array([languages.index(lang) for lang, _ in rows], np.int64), languages


def with_doubt(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The sample with one class more, ``und``: as many windows as an average language has, of the same bytes in random
    order, and half of them of random letters. A softmax over languages alone has to name one for any letters.
    """
    rng = np.random.default_rng(seed)
    chosen = windows[rng.permutation(len(windows))[:max(1, len(windows) // max(1, len(languages)))]]
    filled = chosen != 0
    shuffled = np.where(filled, np.take_along_axis(chosen, np.argsort(np.where(filled, rng.random(chosen.shape), 2.0), axis=1), axis=1), 0)
    letters = rng.integers(97, 123, chosen.shape).astype(np.uint8)
    spaces = np.isin(chosen, (0, 32))
    odd = np.arange(len(chosen)) % 2 == 1
    noise = np.where(odd[:, None], np.where(spaces, chosen, letters), shuffled).astype(np.uint8)
    return np.concatenate((windows, noise)), np.concatenate((labels, np.full(len(noise), len(languages), np.int64))), [*languages, UNDETERMINED]


def identify(docs: DataFrame, learn: Column, epochs: int = EPOCHS, doubt: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score, from the text alone.

    ``learn`` says which rows may be learned from (their ``text`` and ``lang``). lang_pred is a learned language; it is
    ``und`` with score 0 where the text is null, empty or has no letter, or where there is nothing to learn from. score
    is the mean probability of lang_pred over the windows of the whole text, weighted by their bytes. With ``doubt`` the
    network also learns a class of disordered letters, and a text that looks most like those is ``und``. Columns named like
    the results are replaced. Repeated rows each get a row; an empty table gives none.
    """
    sample = training_sample(docs, learn)
    if doubt and sample[2]:
        sample = with_doubt(*sample)
    net = train(*sample, epochs=epochs) if sample[2] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=4 << 20):
            n = len(part)
            lang, score = np.full(n, UNDETERMINED, object), np.zeros(n)
            letters = part.column("has_letter").to_numpy(zero_copy_only=False)
            if net is not None:
                windows, row, length = cut_windows(*byte_view(part.column("text")))
                if len(row):
                    heads = np.flatnonzero(np.diff(row, prepend=-1))
                    mean = np.add.reduceat(net.probabilities(windows).astype(np.float64) * length[:, None], heads, axis=0)
                    mean /= mean.sum(axis=1, keepdims=True)
                    lang[row[heads]] = np.array(net.languages, object)[mean.argmax(axis=1)]
                    score[row[heads]] = mean.max(axis=1)
            lang[~letters], score[~letters] = UNDETERMINED, 0.0
            keep = [c for c in part.schema.names if c != "has_letter"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    plain = docs.drop("lang_pred", "score", "has_letter")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.withColumn("has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(
        run, f"{schema}, lang_pred string, score double")


def fold(remainder: int, of: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder, F.lit(False))


def held_out_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents outside the held-out third."""
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    learn = F.col("doc_id").isNotNull() & ~fold(1, 3)
    return identify(chosen, learn).select("doc_id", fold(1, 3).alias("held_out"), "lang_pred", "score")
