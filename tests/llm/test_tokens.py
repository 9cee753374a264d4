import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleanworks.llm import packing, token_files, tokens
from gleanworks.llm.common import byte_view

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PIECES = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "The", "Straße", "été", "é", ",", ".", "'s", "'ll", "!!", "|", "%%%", "12", "x9", " ", "́", " ",
          "\x1c", "\x85", "中文", "🙂", "İ", "Σ", "ς", "<|endoftext|>", "<|startoftext|>", "don't", "​", "_", "≠", "×", "÷", "ﬁ", "Ⅷ", "ª"]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = public_tokenizers.path(request.param)
    return tokens.Encoder(path), Tokenizer.from_file(path)


def same(pair, texts):
    own, plain = pair
    ids, starts = own.encode(*byte_view(pa.array(texts, pa.string())))
    for k, text in enumerate(texts):
        assert ids[starts[k]:starts[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join) | st.text(max_size=20), min_size=1, max_size=4))
def test_same_ids_as_whole_texts(pair, texts):
    same(pair, texts)


def test_added_tokens_in_a_text(pair):
    """Each added token of the vocabulary has its own id, as the library gives it, wherever it stands and however often."""
    own, plain = pair
    for mark, number in ((t.content, i) for i, t in plain.get_added_tokens_decoder().items()):
        texts = [f"a {mark} b", mark, mark * 3, f"end{mark}", f"{mark}Start", f" {mark} ", mark[:-1], mark.upper(), f"x{mark[:-2]}{mark}>", f"é{mark}\n{mark}é", mark[:5], mark[5:]]
        same(pair, texts)
        ids, starts = own.encode(*byte_view(pa.array(texts)))
        assert (ids[:starts[1]] == number).sum() == 1 and ids[starts[2]:starts[3]].tolist() == [number] * 3
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids in ([64, 220, 50256, 275], [320, 49407, 321])


def test_same_ids_over_generations(spark, folder, pair, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 50)
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(60).collect()]
    for k in range(0, 60, 6):
        same(pair, texts[k:k + 6])
    same(pair, texts)


def test_same_ids_on_given_documents(spark, folder, pair):
    same(pair, [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()] + [None, ""])


@settings(max_examples=200, deadline=None)
@given(n=st.integers(1, 1500), top=st.sampled_from([1, 2, 200, 256, 257, 50257, 2**16, 2**31, 2**32]), seed=st.integers(0, 99), spike=st.booleans())
def test_blocks_round_trip(n, top, seed, spike):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, top, n).astype(np.uint32)
    if spike:
        ids[rng.integers(0, n, 1 + n // 50)] = 2**32 - 1
    data, sizes = token_files.encode_blocks(ids)
    starts = np.cumsum(sizes) - sizes
    assert np.array_equal(token_files.decode_blocks(data, starts).ravel()[:n], ids)


def test_a_few_outliers_do_not_widen_a_block():
    ids = np.arange(256, dtype=np.uint32) % 4
    ids[7] = 40000
    data, _ = token_files.encode_blocks(ids)
    assert len(data) == 7 + 256 * 2 // 8 + 5


def test_random_access(tmp_path):
    ids = np.random.default_rng(1).integers(0, 50000, 5000).astype(np.uint32)
    writer = token_files.Writer(f"{tmp_path}/a.pfor")
    writer.add(pa.array([1, None]), ids[:3000], np.array([1000, 2000]))
    writer.add(pa.array([9]), ids[3000:], np.array([2000]))
    assert writer.close() == 5000
    reader = token_files.Reader(f"{tmp_path}/a.pfor")
    assert reader.docs.to_pylist() == [1, None, 9] and reader.counts.tolist() == [1000, 2000, 2000]
    for first, count in ((0, 0), (0, 5000), (255, 2), (4999, 1), (1000, 2000)):
        assert np.array_equal(reader.read(first, count), ids[first:first + count])


def test_token_files_beside_brute_force(odd_docs, folder, spark):
    path = public_tokenizers.path(FILES[0])
    plain = Tokenizer.from_file(path)
    for docs in (odd_docs, spark.read.parquet(f"{folder}/documents.parquet")):
        got = token_files.token_file_index(docs, path, file_bytes=100_000).collect()
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        want, start = [], 0
        for doc_id, text in rows:
            ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
            want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_files.token_file_index(odd_docs.where("false"), path).count() == 0


def test_packing_places_every_piece_once(odd_docs, folder, spark):
    path = public_tokenizers.path(FILES[1])
    plain = Tokenizer.from_file(path)
    for docs in (odd_docs, spark.read.parquet(f"{folder}/documents.parquet")):
        rows = packing.pack(docs, path).collect()
        want = []
        for r in docs.collect():
            ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
            want += [(r.doc_id, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
        filled = {}
        for r in rows:
            filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(filled) <= -(-sum(w[3] for w in want) // 2048) + 3
    assert packing.pack(odd_docs.where("false"), path).count() == 0


@settings(max_examples=150, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=40), capacity=st.just(60))
def test_plan_fits_and_is_not_worse_than_plain_best_fit(counts, capacity):
    plan = packing.make_plan(counts, capacity)
    filled, placed = {}, {s: set() for s in counts}
    rows = sorted(plan.rows)
    for k, (size, rank, first, per, offset) in enumerate(rows):
        end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == size else counts[size]
        for n in range(end - rank):
            placed[size].add(rank + n)
            filled.setdefault(first + n // per, []).append((offset + n % per * size, size))
    assert placed == {s: set(range(n)) for s, n in counts.items()} and set(filled) == set(range(plan.sequences))
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    plain = packing.Plan()
    packing._best_fit([(size, 0, n) for size, n in sorted(counts.items(), reverse=True)], defaultdict(list), capacity, plain)
    assert plan.sequences <= 1.05 * plain.sequences + 3
