import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gleanworks.llm import periods, queries


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if w[p:] == w[:len(w) - p])


def brute(w):
    """All maximal stretches, by comparing the words with themselves shifted by every period."""
    found, numbers = [], np.unique(np.array(w, dtype=object), return_inverse=True)[1] if w else np.zeros(0)
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate(([False], numbers[q:] == numbers[:-q], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + q >= max(6, 4 * q) and smallest_period(w[a:a + 2 * q]) == q:
                found.append((a, b - a + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(rng, n):
    """Words with runs of many periods, one within another and side by side."""
    w = []
    while len(w) < n:
        kind = rng.randrange(4)
        if kind == 0:
            w += [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 12))]
        else:
            unit = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 8, 17, 40]))]
            unit = unit * rng.randrange(1, 6) + ["z"] * (kind == 2)
            w += unit * rng.randrange(3, 8) + unit[:rng.randrange(len(unit))]
    return w[:n]


def texts(seed=1):
    rng = random.Random(seed)
    out = [" ".join(periodic(rng, rng.randrange(1, 900))) for _ in range(60)]
    out += ["same " * 700, "a b " * 300 + "a", " ".join(rng.choice("ab") for _ in range(500)), ("word\n" * 5).strip(), "w " * 6]
    out += [" ".join([f"u{k}" for k in range(150)] * 5 + ["end"] + [f"v{k}" for k in range(40)] * 9)]
    return out


@pytest.mark.parametrize("tile_words", [64, 128, 8192])
def test_beside_brute_force(make_docs, tile_words):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in periods.periodic_runs(make_docs(*rows).repartition(4), tile_words).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        w, want = words_of(text), brute(words_of(text))
        assert [tuple(r) for r in got[i].runs] == want
        assert got[i].n_words == len(w) and got[i].collapsed_text == collapsed(w, want)
    assert sum(len(r.runs) for r in got.values()) > 300


def test_odd_rows(make_docs, odd_docs):
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(None, "a " * 300), (None, "a " * 300), (9, "b c " * 200), (9, "b c " * 200), (9, "d " * 9)]
    for tile_words in (64, 8192):
        got = periods.periodic_runs(make_docs(*odd), tile_words).collect()
        want = [(i, len(words_of(t)), brute(words_of(t)) if len(words_of(t)) < 1000 else [(0, 60000, 1)]) for i, t in odd]
        assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in got), key=str) == sorted(want, key=str)
        assert periods.periodic_runs(make_docs(*odd).where("false"), tile_words).count() == 0


def test_clean_texts_have_no_runs(make_docs):
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(800))) for k in range(30)]
    got = periods.periodic_runs(make_docs(*rows)).collect()
    assert all(r.runs == [] and r.collapsed_text == rows[r.doc_id][1] for r in got)


def expected(i, text):
    w, h = words_of(text), zlib.crc32(str(i).encode())
    if h % 10 == 0 and w:
        a, old = h // 10 % len(w), w
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [old[k] if k < a else old[a + (k - a) % p] for k in range(len(w))]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)))


def test_query_over_a_table(spark, folder):
    got = sorted(tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, folder).collect())
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert got == sorted(expected(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 5


def test_query_over_odd_rows(make_docs, odd_docs):
    odd = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id != 6]
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0][:12]
    odd += [(k, " ".join(f"w{j}" for j in range(5 * n))) for n, k in enumerate(ids)] + [(ids[0], None)]
    got = periods.digests(periods.periodic_runs(periods.planted_periods(make_docs(*odd)))).collect()
    want = [expected(i, t) if i is not None else (None, *expected(1, t)[1:]) for i, t in odd]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
