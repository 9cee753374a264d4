import random
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_exact import brute as brute_exact  # noqa: E402
from test_mixing import brute_targets  # noqa: E402
from test_simhash import brute_components, brute_print, words_of  # noqa: E402

from gleanworks.llm import language_id, similar  # noqa: E402
from gleanworks.llm.common import stored  # noqa: E402


def shingles(text, size=5):
    w = words_of(text)
    return {tuple(x.lower() for x in w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute_similar(rows, least=0.8):
    """Smallest ids of the groups of texts linked by similar shingle sets."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i in sets:
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
    for i, j in {(a, b) for held in holders.values() for a in held for b in held if a < b}:
        if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return sorted(i for i in root if top(i) == i)


def test_every_stage_beside_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").union(spark.createDataFrame(
        [(100_000, "12 34 !!", "en", "src1", 8), (100_001, None, "en", "src1", 0), (100_002, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = stored(stage(spark, docs, folder), name.replace(" ", "-"))
        rows = after.collect()
        if number < 4:
            assert after.columns == docs.columns
        if name == "language":
            told = {r.doc_id: r for r in language_id.identify(docs, F.col("doc_id").isNotNull(), doubt=True).collect()}
            assert {r.doc_id for r in rows} == {i for i, r in told.items() if r.lang_pred != "und" and r.score >= 0.5}
            assert {100_000, 100_001, 100_002}.isdisjoint(r.doc_id for r in rows) and len(rows) > 0.97 * len(before)
        if name == "exact dedup":
            assert sorted(r.doc_id for r in rows) == sorted(i for i, _, _, kept, _ in brute_exact(before) if kept)
        if name == "near dedup":
            firsts = set(brute_components(before, [brute_print(t) for _, t in before]))
            assert sorted(r.doc_id for r in rows) == brute_similar([(i, t) for i, t in before if i in firsts])
        if name == "source mix":
            sizes, taken = Counter(), Counter()
            for r in docs.collect():
                sizes[r.source] += len(words_of(r.text))
            for r in rows:
                taken[r.source] += len(words_of(r.text))
            target = brute_targets(dict(sizes))
            assert max(Counter(r.doc_id for r in rows).values()) <= 2
            assert all(abs(taken[s] - target[s]) <= max(40, 0.03 * target[s]) for s in sizes)
        if name == "packing":
            plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            lengths = Counter()
            for _, text in before:
                n = len(plain.encode(text, add_special_tokens=False).ids) + 1
                lengths.update([2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0))
            assert Counter(r.length for r in rows) == lengths
            used = Counter()
            for r in rows:
                used[r.sequence_id] += r.length
            assert max(used.values()) <= 2048
            assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
        docs = after


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_planted_similar_texts_go(spark, make_docs):
    rng = random.Random(4)
    rows, sets = [], []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((k, " ".join(words)))
        for at in rng.sample(range(200), 1 + k % 7):  # changed words: similarities of about 0.7 to 0.95
            words[at] = f"new{rng.randrange(5000)}"
        rows.append((100 + k, " ".join(words)))
    for _, text in rows:
        words = text.split()
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)})
    like = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 80, 2)]
    want = {r[0] for r in rows[::2]} | {rows[2 * k + 1][0] for k in range(40) if like[k] < 0.8}
    assert 40 < len(want) < 60
    assert sorted(r.doc_id for r in similar.without_similar(make_docs(*rows)).collect()) == sorted(want)
    left = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near dedup"](spark, make_docs(*rows), "").collect()}
    assert left <= want and {r[0] for r in rows[::2]} <= left  # close fingerprints may link pairs a little below the limit too


def test_dense_bands_are_compared_in_blocks(spark):
    """Texts of one template with pairs above and below the limit: same groups as brute force, block by block."""
    rng = random.Random(6)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 7)):
            words[at] = f"n{rng.randrange(4)}"
        rows.append((k, " ".join(words)))
    rows += [(500, None), (501, ""), (502, " "), (503, "one two"), (504, "one two"), (505, "one two three")]
    texts = spark.createDataFrame(rows, "node long, text string")
    want = brute_similar(rows)
    assert 20 < len(want) < 150
    for block in (8, 64, 1000):
        groups = {r.node: r.root for r in similar.similar_groups(texts, block=block).collect()}
        assert sorted(i for i, _ in rows if groups.get(i, i) == i) == want


def test_planted_junk_goes_and_clean_texts_stay(spark, folder):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(corpus_pipeline.COLUMNS)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 10)))
    junk = spark.createDataFrame([(10**6 + k, " ".join(word() for _ in range(120)), None, "junk", 1) for k in range(60)], docs.schema)
    left = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(junk), "").collect()}
    clean = {r.doc_id for r in docs.collect()}
    assert len(clean & left) > 0.97 * len(clean) and len(left - clean) <= 2


def test_rows_with_shared_and_missing_ids(spark, tmp_path):
    """k rows of one id or of none are k rows: one per text after exact dedup, at most two copies each after the mix."""
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    texts = [text(60) for _ in range(10)]
    rows = [(None, t, "en", "a", 1) for t in texts[:5]] + [(4, t, "en", "b", 1) for t in texts[5:9]] + [(9, texts[9], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    mixed = Counter(r.text for r in stages["source mix"](spark, docs, "").collect())
    assert set(mixed) <= set(texts) and max(mixed.values()) <= 2 and sum(mixed.values()) <= 20
    for name in ("exact dedup", "near dedup"):
        assert sorted(r.text for r in stages[name](spark, docs, "").collect()) == sorted(texts)
        assert sorted(r.text for r in stages[name](spark, docs.union(docs), "").collect()) == sorted(texts)
    packed = stages["packing"](spark, docs, "").collect()
    assert len(packed) == 10 and sum(r.doc_id is None for r in packed) == 5
    docs.union(docs).withColumn("text", F.concat(F.lit("the house of the family and the people were with them in the morning "), "text")).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 20
