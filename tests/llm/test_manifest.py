import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gleanworks.llm import manifest, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels_of(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k:k + arity])) for k in range(0, len(levels[-1]), arity)])
    return levels


def siblings(levels, at, arity):
    for nodes in levels[:-1]:
        begin = at - at % arity
        yield nodes[begin:at], nodes[at + 1:begin + arity]
        at //= arity


def brute(rows, arity=2):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    full = []
    for i, text, lang, source, n in rows:
        leaf = leaf_of(i, source, lang, n, text)
        wrong = zlib.crc32(str(i).encode()) % 7 == 0 if i is not None else False
        full.append((lang, i, leaf, leaf_of(i, source, lang, None if n is None else n + 1, text) if wrong else leaf))
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    trees = sorted({f[0] for f in full}, key=order)
    members = {t: sorted((f for f in full if f[0] == t), key=lambda f: (order(f[1]), f[2])) for t in trees}
    levels = {t: levels_of([f[2] for f in members[t]], arity) for t in trees}
    top = levels_of([levels[t][-1][0] for t in trees], arity)
    out = []
    for k, t in enumerate(trees):
        for at, (_, i, leaf, shown) in enumerate(members[t]):
            path = [*siblings(levels[t], at, arity), *siblings(top, k, arity)]
            folded = shown
            for left, right in path:
                folded = sha("".join([*left, folded, *right]))
            out.append((i, leaf, levels[t][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf int, number string")

    return make


def run(docs, **how):
    return sorted((tuple(r) for r in manifest.manifest(docs, shown=manifest.tampered_leaf(), **how).collect()), key=str)


def ids(kind, n, rng):
    return {"dense": list(range(n)), "sparse": [rng.randrange(-2**63, 2**63) for _ in range(n)], "wide": [k * 40_000 - 10**6 for k in range(n)],
            "repeated": [rng.randrange(20) for _ in range(n)], "null": [None if k % 3 else k for k in range(n)]}[kind]


@pytest.mark.parametrize("kind", ["dense", "sparse", "wide", "repeated", "null"])
@pytest.mark.parametrize("how", [{"levels": 3}, {}, {"arity": 3, "levels": 2}])
def test_beside_brute_force(table, kind, how):
    if kind != "dense" and how:
        how = {"levels": 4} if how == {"levels": 3} else how
    rng = random.Random(len(kind))
    rows = [(i, f"text {rng.randrange(200)} é", rng.choice(["en", "de", None, "ßx", "z"]) if k % 9 else "rare" + str(k % 4), None if k % 11 == 0 else "s", None if k % 5 == 0 else k)
            for k, i in enumerate(ids(kind, 130, rng))]
    rng.shuffle(rows)
    got = run(table(rows).repartition(3), **how)
    assert got == brute(rows, how.get("arity", 2))
    assert not all(r[6] for r in got)


@pytest.mark.parametrize("rows", [
    [], [(5, None, None, None, None)], [(14, "a", "en", "s", 1)], [(k, "t", f"lang{k}", "s", 1) for k in range(30)],
    [(None, None, None, None, None)] * 5, [(1, "same", "en", "s", 4)] * 9 + [(2, "", "en", "", 0)]])
def test_small_and_odd_tables(table, rows):
    for how in ({"levels": 1}, {"levels": 3}):
        assert run(table(rows), **how) == brute(rows)


def test_places_in_several_containers(spark):
    rng = random.Random(9)
    chosen = rng.sample(range(-70_000, 200_000), 3000) + [2**62, -2**62, 2**63 - 1, -2**63]
    rows = spark.createDataFrame([("t", i, "x") for i in chosen], "tree string, id long, leaf string")
    got = {r.id: (r.place, r.leaves) for r in manifest.leaf_places(rows, ["leaf"]).collect()}
    assert got == {i: (k, len(chosen)) for k, i in enumerate(sorted(chosen))}


def test_a_changed_field_is_noticed_and_nothing_else(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = queries.QUERIES["op13_merkle_manifest"](spark, folder).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()])
    assert {r.doc_id for r in got if not r.verified} == {r.doc_id for r in docs.where(F.crc32(F.col("doc_id").cast("string")) % 7 == 0).collect()}
