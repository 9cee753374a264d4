"""Token ids of whole texts with a ready-made tokenizer, each stand-alone piece of text encoded once per worker."""

from __future__ import annotations

import functools
import re

import numpy as np
from tokenizers import Tokenizer

from gleanworks.llm.common import LOWER, WHITE, pieces, ragged

#: Pieces of a generation. When the store is fuller than this, a new one begins, which takes over from the one before
#: what is met again; so a worker keeps at most two generations.
KEPT_PIECES = 250_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ",.!?;:|$%&*#"]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True  # lead bytes of two-byte characters; none of these is white space


def _byte_letters() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """Ids of a byte view of texts, equal to the tokenizer's own on each whole text.

    Both kinds of vocabulary split a text before white space that follows a visible character, between a letter and a
    mark, and after a single line feed before a letter, whatever stands around; so those pieces are encoded apart. Added
    tokens (``<|endoftext|>``) are found in the raw text first, as the tokenizer does, and are pieces of their own. A
    piece that is one word (after at most one space) goes to the model at once, all others through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        marks = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, marks)).encode()) if marks else None
        self.folds = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"
        self.known: dict[bytes, int] = {}
        self._next_generation()

    def _next_generation(self) -> None:
        self.before = (self.known, self.ids, self.starts, self.lengths) if self.known else None
        self.known = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _piece_ids(self, piece: bytes) -> list[int]:
        text = piece.decode("utf-8")
        word = text[1:] if text[:1] == " " else text
        shown = text
        if self.folds and word.isalpha():
            shown = word.lower() if word.isascii() else self.tokenizer.normalizer.normalize_str(word)
        if word.isalpha() and shown[shown[:1] == " ":].isalpha() and (word.isascii() or max(word) < "ɐ"):
            return [t.id for t in self.tokenizer.model.tokenize(shown.encode().decode("latin-1").translate(_BYTE_LETTERS))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, piece: bytes) -> int:
        at = len(self.known)
        if self.before and piece in self.before[0]:
            _, ids, starts, lengths = self.before
            old = self.before[0][piece]
            found = ids[starts[old]:starts[old] + lengths[old]]
        else:
            found = self._piece_ids(piece)
        while self.used + len(found) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        if at == len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used:self.used + len(found)] = found
        self.starts[at], self.lengths[at] = self.used, len(found)
        self.used += len(found)
        self.known[piece] = at
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (one more entry for the end)."""
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.known) > KEPT_PIECES:
            self._next_generation()
        spans = np.array([m.span() for m in self.marks.finditer(data.data)], np.int64).reshape(-1, 2) if self.marks else np.zeros((0, 2), np.int64)
        if len(spans):  # a match over the end of a text is none
            spans = spans[np.searchsorted(offsets, spans[:, 0], "right") == np.searchsorted(offsets, spans[:, 1] - 1, "right")]
        if self.folds:
            data = LOWER[data]
        white, letter = WHITE[data], _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # letters of Latin-1
        safe = _VISIBLE[data]
        safe[1:] |= _LEAD[data[:-1]]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (white[1:] & safe[:-1]) | (_MARK[data[1:]] & letter[:-1])
        feed = (data == 0x0A) & cut[:-1]
        cut[1:-1] |= feed[:-1] & letter[1:]
        for begin, end in spans.tolist():
            cut[begin:end + 1] = False
        cut[offsets] = cut[spans.ravel()] = True
        bounds = np.flatnonzero(cut)
        coded = pieces(data, bounds).dictionary_encode()
        known, learn = self.known, self._learn
        at = np.fromiter((known[p] if p in known else learn(p) for p in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        place = at[coded.indices.to_numpy()]
        lengths = self.lengths[place]
        before = np.concatenate(([0], np.cumsum(lengths)))
        return self.ids[ragged(self.starts[place], lengths)], before[np.searchsorted(bounds, offsets)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path)


def with_end(ids: np.ndarray, starts: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after each text."""
    n = len(starts) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(starts))] = ids
    return out, starts + np.arange(n + 1)
