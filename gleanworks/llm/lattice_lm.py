"""Language-model scores from a subword lattice.

A text's probability is the sum over all ways to write its words with the pieces of an existing vocabulary, each piece
weighted by a unigram score. The sum runs by forward recursion in log space over the bytes of each distinct word. The
scores start from the order of the vocabulary and are re-estimated from the expected piece counts (forward-backward) of
all training tokens, each distinct word once with its number of tokens. A training word is one more edge of its lattice, from its start to its end, with its share
of the tokens; the share of that edge is what predicts each training token best from all the others.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from gleanworks.llm.common import LOWER, byte_view, discard, ragged, slices, stored, word_pieces, word_spans

#: At most so many words, those with the most tokens, have their facts broadcast (about 8 MB); all others meet theirs in a join.
COMMON_WORDS = 1 << 17
#: Passes of re-estimation over all training words.
PASSES = 2
#: Added to each piece's expected count.
SMOOTH = 0.05
#: Bytes of distinct words that a lattice looks at together; a longer word is looked at alone.
LATTICE_BYTES = 1 << 18
_START = 0x20  # the byte that stands for a word's start; it occurs in no word
_NEVER = -1e30


class Vocabulary:
    """Pieces as bytes (with all single bytes, the fallback of the vocabulary) in a table to walk byte by byte."""

    def __init__(self, path: str) -> None:
        model = SentencePieceProcessor(model_file=path)
        found: dict[bytes, int] = {}
        for k in range(model.get_piece_size()):
            if model.is_control(k) or model.is_unknown(k) or model.is_byte(k):
                continue
            piece = model.id_to_piece(k).replace("▁", " ").encode()
            if b" " not in piece[1:] and piece.lower() == piece:
                found.setdefault(piece, len(found))
        self.ranked = len(found)
        for b in range(256):
            found.setdefault(bytes([b]), len(found))
        self.pieces = list(found)
        nodes: list[dict[int, int]] = [{}]
        piece_at = [-1]
        for piece, number in found.items():
            node = 0
            for b in piece:
                if b not in nodes[node]:
                    nodes[node][b] = len(nodes)
                    nodes.append({})
                    piece_at.append(-1)
                node = nodes[node][b]
            piece_at[node] = number
        used = np.zeros(256, np.int64)
        used[sorted({b for node in nodes[1:] for b in node})] = 1
        self.column = np.where(used > 0, np.cumsum(used), 0).astype(np.int32)  # bytes that only begin a piece share column 0
        self.first = np.zeros(256, np.int32)
        for b, node in nodes[0].items():
            self.first[b] = node
        self.next = np.zeros((len(nodes), int(used.sum()) + 1), np.int32)
        for node, children in enumerate(nodes[1:], 1):
            for b, child in children.items():
                self.next[node, self.column[b]] = child
        self.piece_at = np.array(piece_at, np.int32)

    def first_scores(self) -> np.ndarray:
        """Scores from the order of the vocabulary (Zipf's law); bytes of the fallback come last."""
        weight = 1.0 / (np.arange(len(self.pieces)) + 10.0)
        weight[self.ranked:] /= 100
        return np.log(weight / weight.sum())


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def word_groups(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes and byte matrix (start mark first) of words of equal length, in bounded groups."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(sizes[order])) + 1, [len(order)]))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if a == b:
            continue
        length = int(sizes[order[a]])
        step = max(1, LATTICE_BYTES // (length + 1))
        for k in range(a, b, step):
            mine = order[k:min(b, k + step)]
            matrix = np.full((len(mine), length + 1), _START, np.uint8)
            matrix[:, 1:] = data[ragged(offsets[mine], np.full(len(mine), length))].reshape(len(mine), length)
            yield mine, matrix


class Lattice:
    """All pieces that match inside the words of a byte matrix, and the sums over all paths."""

    def __init__(self, vocab: Vocabulary, matrix: np.ndarray) -> None:
        self.n, self.length = matrix.shape
        row, start = (x.ravel() for x in np.indices(matrix.shape))
        node, found = vocab.first[matrix].ravel(), []
        columns = vocab.column[matrix]
        size = 1
        while len(row):
            piece = vocab.piece_at[node]
            hit = piece >= 0
            found.append((size, row[hit], start[hit], piece[hit]))
            room = start + size < self.length
            row, start, node = row[room], start[room], node[room]
            node = vocab.next[node, columns[row, start + size]]
            alive = node > 0
            row, start, node = row[alive], start[alive], node[alive]
            size += 1
        self.edges = [e for e in found if len(e[1])]

    def forward(self, scores: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Log probability of reaching each position, and the edges' scores by (word, end), one matrix per piece length."""
        self.into = []
        for size, row, start, piece in self.edges:
            score = np.full((self.n, self.length + 1), _NEVER)
            score[row, start + size] = scores[piece]
            self.into.append(score)
        reach = np.full((self.n, self.length + 1), _NEVER)
        reach[:, 0] = 0.0
        for end in range(1, self.length + 1):
            ways = [reach[:, end - size] + into[:, end] for (size, *_), into in zip(self.edges, self.into, strict=True) if size <= end]
            top = functools.reduce(np.maximum, ways)
            reach[:, end] = top + np.log(sum(np.exp(w - top) for w in ways))
        return reach, self.into

    def expected(self, scores: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> None:
        """Add to ``counts`` how often each piece is used on average over all paths, times the words' weights."""
        reach, into = self.forward(scores)
        leave = np.full((self.n, self.length + 1), _NEVER)
        leave[:, self.length] = 0.0
        for at in range(self.length - 1, -1, -1):
            ways = [leave[:, at + size] + score[:, at + size] for (size, *_), score in zip(self.edges, into, strict=True) if at + size <= self.length]
            top = functools.reduce(np.maximum, ways)
            leave[:, at] = top + np.log(sum(np.exp(w - top) for w in ways))
        total = reach[:, self.length]
        for size, row, start, piece in self.edges:
            share = np.exp(reach[row, start] + scores[piece] + leave[row, start + size] - total[row]) * weight[row]
            counts += np.bincount(piece, share, len(counts))


def word_scores(words: pa.Array, vocab: Vocabulary, scores: np.ndarray) -> np.ndarray:
    """Log probability of each word, summed over all its segmentations."""
    out = np.zeros(len(words))
    for mine, matrix in word_groups(words):
        lattice = Lattice(vocab, matrix)
        out[mine] = lattice.forward(scores)[0][:, -1]
    return out


def _words(part: pa.RecordBatch) -> tuple[pa.DictionaryArray | None, np.ndarray]:
    """The lower-cased words of a batch as dictionary codes, and the number of words before each row."""
    data, offsets = byte_view(part.column("text"))
    begins, ends, before = word_spans(data, offsets)
    if not len(begins):
        return None, before
    return word_pieces(LOWER[data], begins, ends).dictionary_encode(), before


def count_words(docs: DataFrame) -> DataFrame:
    """word, c (its tokens in rows to learn from) and n (its tokens in all rows), over all whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            coded, before = _words(part)
            if coded is None:
                continue
            codes = coded.indices.to_numpy()
            learn = np.repeat(part.column("learn").to_numpy(zero_copy_only=False), np.diff(before))
            size = len(coded.dictionary)
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.cast(pa.binary()), pa.array(np.bincount(codes[learn], minlength=size)), pa.array(np.bincount(codes, minlength=size))],
                ["word", "c", "n"])

    return docs.select("text", "learn").mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def estimate(words: DataFrame, path: str, passes: int = PASSES) -> np.ndarray:
    """Log scores of the pieces, after passes of expected counts over all training tokens (each distinct word times its tokens).

    Each task adds up expected counts in one array of the vocabulary's size; the arrays are summed by piece.
    """
    vocab = vocabulary(path)
    scores, size = vocab.first_scores(), len(vocab.pieces)
    for _ in range(passes):
        sent = words.sparkSession.sparkContext.broadcast(scores)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            counts, table = np.zeros(size), vocabulary(path)
            for batch in batches:
                tokens = batch.column("c").to_numpy().astype(float)
                for mine, matrix in word_groups(batch.column("word").cast(pa.large_binary())):
                    Lattice(table, matrix).expected(sent.value, tokens[mine], counts)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["piece", "used"])

        counts = np.full(size, SMOOTH)
        for r in words.where("c > 0").select("word", "c").mapInArrow(expect, "piece int, used double").groupBy("piece").agg(F.sum("used").alias("used")).collect():
            counts[r["piece"]] += r["used"]  # as many rows as the vocabulary has pieces at most
        scores = np.log(counts / counts.sum())
    return scores


def whole_word_share(rated: DataFrame, tokens: int, turns: int = 5) -> float:
    """Share of the whole-word edge, by expectation steps in which each training token is left out of the counts."""
    share = 0.9
    for _ in range(turns if tokens > 1 else 0):
        whole = (F.col("c") - 1) / F.lit(float(tokens - 1)) * share
        used = rated.where("c > 0").agg(F.sum(F.col("c") * whole / (whole + (1 - share) * F.exp("lattice") + 1e-300))).first()[0]
        share = min(max((used or 0.0) / tokens, 1e-6), 1 - 1e-6)
    return share


def _bucket() -> Column:
    return F.floor(F.log2("n") * 8)


def common_bucket(words: DataFrame, most: int) -> int:
    """The lowest bucket of token counts (eight to a doubling) from which on there are at most ``most`` words."""
    held = sorted(((r["b"], r["k"]) for r in words.groupBy(_bucket().alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, bucket = 0, held[0][0] + 1 if held else 0
    for b, k in held:  # a few hundred buckets at most
        total += k
        if total > most:
            break
        bucket = b
    return int(bucket)


def score_texts(docs: DataFrame, learn: Column, path: str, passes: int = PASSES, common_words: int = COMMON_WORDS) -> DataFrame:
    """doc_id with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every whole text.

    Input: ``doc_id``, ``text`` and what ``learn`` reads; other columns are ignored. A-Z is lower-cased; tokens are the
    words and one end. base_score is the add-one word model; score is the lattice's, where each token is the end or a word.
    Null and empty texts have the end alone. Bytes outside all pieces cost single-byte pieces, so scores are finite.
    Repeated rows each get a row; an empty table gives none; with nothing to learn from, counts are zero.

    The facts of the words with most tokens are broadcast, a bounded number; every other word of a document meets its
    facts in a join on the word, after the common words (which would be hot keys) have gone.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(learn, F.lit(False)).alias("learn"))
    words = stored(count_words(chosen), "word-counts")
    ends = chosen.where("learn").count()
    inside = words.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    tokens, distinct = (inside[0] or 0) + ends, inside[1] + (ends > 0)
    scores = spark.sparkContext.broadcast(estimate(words, path, passes))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = word_scores(batch.column("word").cast(pa.large_binary()), vocabulary(path), scores.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("word", "c", "n")), pa.array(found)], ["word", "c", "n", "lattice"])

    rated = stored(words.mapInArrow(rate, "word binary, c long, n long, lattice double"), "word-scores")
    in_words = tokens - ends
    share = whole_word_share(rated, in_words) if in_words else 0.0
    end = (ends + SMOOTH) / (tokens + 2 * SMOOTH)
    floor = float(tokens + distinct + 1)
    spelled = F.col("lattice") + float(np.log(1 - share))
    total = F.when(F.col("c") == 0, spelled).otherwise(F.log(F.col("c") * F.lit(share / max(1, in_words)) + F.exp(spelled))) + float(np.log(1 - end))
    facts = rated.select("word", "n", F.log10((F.col("c") + 1) / F.lit(floor)).alias("b"), (total / float(np.log(10))).alias("l"),
                         (F.col("c") > 0).cast("double").alias("k"))
    common = facts.where(_bucket() >= common_bucket(rated, common_words)).toArrow()
    known = spark.sparkContext.broadcast((common.column("word").combine_chunks().cast(pa.large_binary()),
                                          *(common.column(c).to_numpy() for c in ("b", "l", "k"))))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, *facts_ = known.value
        for part in slices(batches):
            coded, before = _words(part)
            total = np.diff(before)
            sums = np.zeros((3, len(total)))
            rest = pa.array([[]] * len(total), pa.list_(pa.binary()))
            if coded is not None:
                at = pc.index_in(coded.dictionary, names).fill_null(-1).to_numpy()[coded.indices.to_numpy()]
                hit = at >= 0
                for k, fact in enumerate(facts_):
                    sums[k] = np.diff(np.concatenate(([0.0], np.cumsum(np.where(hit, fact[at] if len(fact) else 0.0, 0.0))))[before])
                missing = np.flatnonzero(~hit)
                bounds = np.searchsorted(missing, before).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(bounds), coded.dictionary.cast(pa.binary()).take(coded.indices.take(pa.array(missing))))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("learn"), pa.array(total), *(pa.array(s) for s in sums), rest],
                ["doc_id", "learn", "words", "base", "lattice", "known", "rest"])

    partial = stored(chosen.mapInArrow(
        first, "doc_id long, learn boolean, words long, base double, lattice double, known double, rest array<binary>").withColumn(
            "row", F.monotonically_increasing_id()), "word-sums")
    spread = partial.select("row", F.explode("rest").alias("word"))
    added = spread.join(facts.drop("n"), "word").groupBy("row").agg(F.sum("b").alias("b"), F.sum("l").alias("l"), F.sum("k").alias("k"))
    end_base = float(np.log10((ends + 1) / floor))
    got = partial.drop("rest").join(added, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0.0))
    return got.select(
        "doc_id", "learn", (F.col("words") + 1).alias("n_tokens"), (F.round(plus("known", "k")).cast("long") + (1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (plus("base", "b") + end_base).alias("base_score"),
        (plus("lattice", "l") + float(np.log10(end))).alias("score"))
