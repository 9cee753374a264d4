import random

import numpy as np
import pytest
import xxhash

from gleanworks.llm import simhash


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]


def brute_print(text):
    words = words_of(text)
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows, prints):
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return [least.get(find(k)) for k in range(len(rows))]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [brute_print(t) for _, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute_components(rows, prints), strict=True)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()), key=str) == want


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_given_documents(spark, folder):
    check(spark.read.parquet(f"{folder}/documents.parquet"))


def test_near_copies(make_docs):
    rng = random.Random(5)
    base = [rng.choice("abcdefgh") * rng.randint(2, 6) + str(rng.randint(0, 99)) for _ in range(300)]
    texts = []
    for k in range(40):
        copy = list(base)
        copy[rng.randrange(300)] = f"changed{k}"
        texts.append((100 + k, "  ".join(copy)))
    check(make_docs(*texts, (7, " ".join(base)), (8, "something else entirely")))


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs((1, "x")).where("false")).count() == 0


@pytest.mark.parametrize("bands, depth", [(1, 3), (2, 3), (4, 4), (4, 0)])
def test_trees_lose_no_near_pair(bands, depth):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = values[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    full = np.unique(np.concatenate([values, near, np.arange(50, dtype=np.uint64)]))
    joined = np.arange(len(full))
    from gleanworks.llm.common import join_labels
    for band in range(bands):
        nodes = simhash._tree(simhash._band(full[::3], band, bands), depth)
        row, leaf, home = simhash._shards(simhash._band(full, band, bands), nodes, depth, 4 // bands)
        assert np.array_equal(np.sort(row[home]), np.arange(len(full)))
        for k in np.unique(leaf):
            here = np.sort(row[leaf == k])
            lives = np.isin(here, row[(leaf == k) & home])
            labels = simhash.joined_in_shard(full[here], lives, band, bands, 4)
            join_labels(joined, here, here[labels])
    a, b = np.nonzero(np.bitwise_count(full[:, None] ^ full) <= 4)
    want = np.arange(len(full))
    join_labels(want, a, b)
    assert np.array_equal(joined, want)
