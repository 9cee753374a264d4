import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanworks.llm import repeats


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for k, t in enumerate(texts):
        for x in range(len(t) - length + 1):
            seen.setdefault(t[x:x + length], []).append((k, x))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, x in places:
                gone[k][x:x + length] = True
    return sorted(((i, len(t), int(g.sum()), int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum()),
                    hashlib.sha256(bytes(b for b, x in zip(t, g, strict=True) if not x)).hexdigest()) for (i, _), t, g in zip(rows, texts, gone, strict=True)), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
def test_suffix_ranks_are_the_suffix_order(symbols):
    ranks = repeats.suffix_ranks(np.array(symbols, np.uint8), wanted=10**6)
    order = sorted(range(len(symbols)), key=lambda k: symbols[k:])
    assert [int(r) for r in ranks[order]] == list(range(len(symbols)))


@settings(max_examples=100, deadline=None)
@given(st.text("ab", min_size=1, max_size=120), st.sampled_from([3, 8, 12, 20]))
def test_repeated_starts(text, length):
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.arange(max(0, len(data) - length + 1))
    strings = [text[k:k + length] for k in starts]
    assert repeats.repeated_starts(data, starts, length).tolist() == [strings.count(s) > 1 for s in strings]


def test_anchors_own_every_string_once():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    offsets = np.array([0, 0, 30, 1000, 1040, 3000])
    owner, hashes, place, first, last = repeats.anchors(data, offsets, 40, 8)
    starts = [(int(o), x) for o, a, b in zip(owner, first, last, strict=True) for x in range(a, b + 1)]
    assert sorted(starts) == [(o, x) for o in range(5) for x in range(int(offsets[o + 1] - offsets[o]) - 39)] and len(set(starts)) == len(starts)
    assert all(a <= p <= a + 32 and b <= p <= b + 32 or a <= p and p <= b + 32 for p, a, b in zip(place, first, last, strict=True))
    plain = repeats.group_hashes(data, 8)
    assert all(plain[offsets[o] + p] == np.int64(h).astype(np.uint64) for o, p, h in zip(owner, place, hashes, strict=True))


def check(docs, length=400, **other):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = repeats.remove_repeats(docs, length, **other).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, length)
    assert all(r.n_kept == r.n_bytes - r.n_removed for r in got)


@pytest.mark.parametrize("sort_bytes", [1, 1 << 20])
def test_given_documents(spark, folder, sort_bytes):
    check(spark.read.parquet(f"{folder}/documents.parquet"), sort_bytes=sort_bytes)


def test_odd_rows(make_docs):
    long = "word " * 500
    check(make_docs((1, None), (2, ""), (3, "x" * 399), (4, "x" * 400), (5, "y" * 401), (6, long), (None, "é" * 250), (7, "é" * 250), (8, "q" + long),
                    (9, "".join(map(str, range(300)))), (9, "".join(map(str, range(300)))), (9, "other")))
    assert repeats.remove_repeats(make_docs((1, "x")).where("false")).count() == 0


def test_shared_passages_with_different_edges(make_docs):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefg ") for _ in range(90))
    texts = []
    for k in range(60):
        a, b = rng.randrange(0, 40), rng.randrange(50, 90)
        texts.append((k, "".join(rng.choice("xyz ") for _ in range(rng.randrange(30))) + passage[a:b] + rng.choice(["", passage[b:b + 3], "é"])))
    check(make_docs(*texts), length=24, anchor=6)


def test_planted_passages_go_and_clean_texts_stay(make_docs):
    """Passages of 400 bytes or more go from every text; shorter ones, of more than 50 words too, stay by definition."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    long, short = " ".join(word(8) for _ in range(55)), " ".join(word(5) for _ in range(60))
    assert len(long) >= 400 > len(short)
    clean = [(k, " ".join(word(6) for _ in range(120))) for k in range(30)]
    own = lambda: " ".join(word(7) for _ in range(40))
    held = [(100 + k, f"{own()}. {long}, {own()}") for k in range(25)] + [(200 + k, f"{own()}. {short}, {own()}") for k in range(25)]
    for how in ({}, {"shard_contexts": 3}):
        got = {r.doc_id: r for r in repeats.remove_repeats(make_docs(*clean, *held), **how).collect()}
        assert all(got[i].n_removed == 0 and got[i].n_kept == len(t) for i, t in clean + held[25:])
        assert all(len(long) <= got[i].n_removed <= len(long) + 16 and got[i].n_spans == 1 for i, _ in held[:25])


def test_kept_text_of_every_row(make_docs):
    """The text that is left stands in the result, of changed, whole, repeated, empty and null texts alike."""
    passage = "".join(map(str, range(60)))
    texts = [(1, f"a {passage} b"), (2, f"{passage}c"), (3, "whole"), (4, None), (4, None), (5, ""), (6, "é" * 30), (7, "ü" * 40 + passage[50:])]
    got = sorted((r.doc_id, r.kept_text) for r in repeats.remove_repeats(make_docs(*texts), 40, anchor=6).collect())
    assert got == [(1, "a  b"), (2, "c"), (3, "whole"), (4, ""), (4, ""), (5, ""), (6, ""), (7, "")]
    split = repeats.remove_repeats(make_docs((1, "ab" * 10 + "é"), (2, "ab" * 10 + "è")), 21, anchor=6).collect()
    assert [(r.n_kept, r.kept_text) for r in split] == [(1, "\ufffd"), (1, "\ufffd")]
    assert {r.kept_sha256 for r in split} == {hashlib.sha256(c.encode()[1:]).hexdigest() for c in "éè"}


@pytest.mark.parametrize("filter_bits", [6, 27])
def test_large_shards_are_trimmed(spark, make_docs, filter_bits):
    """Contexts around one line: what occurs once is cut off, whatever the map's bits share; equal strings all stay."""
    rng = random.Random(6)
    line = "the line of all texts"
    texts = ["".join(rng.choice("xyz ") for _ in range(20)) + line + "".join(rng.choice("xyz ") for _ in range(20)) for _ in range(80)]
    texts += [texts[k][10:-10] for k in range(0, 40, 4)]
    rows = [(str(k).encode(), 0, 20, 7, str(k).encode(), t.encode(), 1) for k, t in enumerate(texts)]
    trimmed = repeats.trim_contexts(spark.createDataFrame(rows, repeats._PARTS), 24, filter_bits).collect()
    strings = [t[k:k + 24] for t in texts for k in range(len(t) - 23)]
    again = {(k, x) for k, t in enumerate(texts) for x in range(len(t) - 23) if strings.count(t[x:x + 24]) > 1}
    left = set()
    for r in trimmed:
        assert texts[int(r.root)].encode()[r.shift:].startswith(bytes(r.context)) and r.ahead == 20 - r["shift"]
        left |= {(int(r.root), r["shift"] + x) for x in range(len(r.context) - 23)}
    assert again <= left and (filter_bits == 6 or left == again) and again


@pytest.mark.parametrize("how", [{}, {"filter_bits": 6}])
@pytest.mark.parametrize("most", [1, 4])
def test_crowded_shards_are_split(make_docs, most, how):
    """A line with other surroundings in every text."""
    rng = random.Random(2)
    line = "a line that stands in every text "
    texts = [(k, "".join(rng.choice("xyz ") for _ in range(20 + k % 3)) + line[k % 2:] + "".join(rng.choice("xyz ") for _ in range(20))) for k in range(30)]
    texts += [(100 + k, texts[k][1][5:-5]) for k in range(5)]
    check(make_docs(*texts), length=24, anchor=6, shard_contexts=most, **how)


def test_split_contexts_keep_equal_strings_together():
    rng = random.Random(3)
    contexts = ["".join(rng.choice("xy") for _ in range(12)) + "-middle-" + "".join(rng.choice("xy") for _ in range(12)) for _ in range(40)]
    parts = pa.RecordBatch.from_pydict({
        "root": [str(k).encode() for k in range(40)], "shift": [0] * 40, "ahead": [12] * 40, "shard": [7] * 40,
        "context": [c.encode() for c in contexts], "n": [1] * 40})
    width = 13
    while True:
        width = -(-width // 2)
        parts = pa.concat_batches(list(repeats.split_contexts(iter([parts]), 20, width)))
        homes, strings = {}, set()
        for r in parts.to_pylist():
            for k in range(len(r["context"]) - 19):
                string = r["context"][k:k + 20]
                assert contexts[int(r["root"])].encode()[r["shift"] + k:][:20] == string
                assert homes.setdefault((r["ahead"] - k, string), r["shard"]) == r["shard"]
                strings.add((r["root"], r["shift"] + k))
        assert len(strings) == 40 * 13 == sum(len(r["context"]) - 19 for r in parts.to_pylist())
        if width == 1:
            break
    held = {}
    for r in parts.to_pylist():
        held.setdefault(r["shard"], set()).add(r["context_key"])
    assert max(map(len, held.values())) == 1
