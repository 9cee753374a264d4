import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gleanworks.llm import queries, windows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, size=13):
    held, out = {}, []
    place = lambda i: (i is None, i or 0)
    for i, text in rows:
        w = words_of(text)
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            held[key] = min(held.get(key, place(i)), place(i))
    for i, text in rows:
        w, gone = words_of(text), set()
        for k in range(len(w) - size + 1):
            if held[tuple(w[k:k + size])] < place(i):
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=str)


def run(docs, **how):
    return sorted((tuple(r) for r in windows.without_shared_windows(docs, **how).collect()), key=str)


def planted(seed=3):
    """Texts that share passages, lines and whole copies; a line in a third of them; few words in some, so that much repeats."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage, line = [[word() for _ in range(60)] for _ in range(6)], "a line that very many of the texts hold somewhere in their middle part it is".split()
    rows = []
    for i in range(240):
        w = [word() for _ in range(rng.randrange(5, 90))]
        if i % 3 == 0:
            w[len(w) // 2:len(w) // 2] = line
        if i % 7 == 0:
            w += passage[i % 6][i % 20:]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(1000 + i, rows[i][1]) for i in range(30)]
    rows += [(2000 + i, " ".join(rng.choice("ab") for _ in range(60))) for i in range(30)]
    rows += [(3000, "same " * 400), (3001, "same " * 300 + "x"), (3002, ("é" * 500 + " ") * 20), (3003, ("é" * 500 + " ") * 14 + "end")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [{}, {"crowded": 5, "filter_bits": 8}, {"sort_bytes": 2000, "group": 2}, {"crowded": 0}, {"window": 5, "group": 1}])
def test_beside_brute_force(make_docs, how):
    rows = planted()
    assert run(make_docs(*rows).repartition(5), **how) == brute(rows, how.get("window", 13))


def test_odd_rows(make_docs, odd_docs, spark):
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    long = " ".join(f"x{k}" for k in range(40))
    odd += [(None, long), (None, long), (9, long), (9, long), (-3, long + " more"), (10, None)]
    assert run(make_docs(*odd)) == brute(odd)
    assert run(make_docs(*odd), crowded=1) == brute(odd)
    assert run(make_docs(*odd).where("false")) == []
    alone = [(None, long), (None, long)]
    assert [r[2] for r in run(make_docs(*alone))] == [0, 0]


def test_planted_passages_go_and_clean_texts_stay(make_docs):
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(55))
    clean = [(i, " ".join(f"c{rng.randrange(10**6)}" for _ in range(100))) for i in range(40)]
    mixed = [(100 + i, f"{' '.join(f'm{rng.randrange(10**6)}' for _ in range(30))} {passage} tail{i}") for i in range(20)]
    got = {r[0]: r for r in run(make_docs(*clean, *mixed))}
    assert all(got[i][2] == 0 and got[i][3] == text for i, text in clean)
    assert got[100][2] == 0 and all(got[100 + i][2] == 55 and passage not in got[100 + i][3] and got[100 + i][3].endswith(f"tail{i}") for i in range(1, 20))


def test_super_k_mers_cover_each_window_once():
    texts = [t for _, t in planted()]
    t = windows.Texts(pa.array(texts), 13, 4, 7)
    assert t.sizes.sum() == len(t.starts) and t.sizes.max() <= 7
    strings = t.packed(t.starts[t.heads], t.sizes + 12).to_pylist()
    flat = [tuple(w.split()[k:k + 13]) for w in strings for k in range(len(w.split()) - 12)]
    short = lambda w: w if len(w.encode()) <= 64 else "\0" + hashlib.sha256(w.encode()).hexdigest()
    assert flat == [tuple(map(short, words_of(x)[k:k + 13])) for x in texts for k in range(len(words_of(x)) - 12)]
    by_window = {}
    for key, window in zip(t.keys.tolist(), flat, strict=True):  # equal windows have equal minimisers
        assert by_window.setdefault(window, key) == key


def test_names_are_exact():
    strings = ["a b c d e f", "b c d e f a", "a b c d e g"]
    names, owner, counts = windows.window_names(pa.array(strings), 5)
    flat = [tuple(s.split()[k:k + 5]) for s in strings for k in range(2)]
    assert [[a == b for b in flat] for a in flat] == (names[:, None] == names[None, :]).tolist()
    assert owner.tolist() == [0, 0, 1, 1, 2, 2] and counts.tolist() == [2, 2, 2]
    assert len(np.unique(windows.named(*np.random.default_rng(1).integers(0, 1 << 20, (7, 500))))) == 500


def test_query(spark, folder):
    got = queries.QUERIES["op11_shared_windows"](spark, folder).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(docs)]
    assert sorted(tuple(r)[:4] for r in got) == sorted(want) and sum(r.n_removed for r in got) > 0
