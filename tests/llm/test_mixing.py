import numpy as np

from gleanworks.llm import mixing


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, total, target = set(order), 1.5 * sum(sizes.values()), {}
    while left:
        level = total / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in left}
        for s in over:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
        left -= over
    return target


def check(docs, near):
    rows = mixing.mix(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    target = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - target[s]) <= 1e-6 * max(1, target[s]) for r in mine)
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(near, 0.03 * target[s])
        # the rates solve the bounded dual: an exponential tilt in size that meets the target
        words = np.array([r["size"] for r in mine], float)
        rates = np.array([r.rate for r in mine])
        assert abs((words * rates).sum() - target[s]) <= 1e-6 * max(1, target[s])
        inside = (rates > 0) & (rates < 2) & (words > 0)
        if inside.sum() > 1:
            tilt = np.log(rates[inside]) / words[inside]
            assert np.allclose(tilt, tilt[0], rtol=1e-6, atol=1e-12)
    return sorted(((r.doc_id, r.taken) for r in rows), key=str)


def test_given_documents_and_reruns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert check(docs, near=40) == check(docs.repartition(5), near=40)


def test_odd_rows(odd_docs):
    check(odd_docs, near=60000)
    sizes = {r.doc_id: r["size"] for r in mixing.mix(odd_docs).collect()}
    assert sizes[1] == sizes[2] == sizes[3] == 0 and sizes[6] == 60000 and len(sizes) == 8


def test_hot_source_and_one_size(make_docs):
    check(make_docs(*[(k, "a b c d", "en", "s1" if k % 3 else f"s{k % 9}") for k in range(400)]), near=4)


def test_empty_table(make_docs):
    assert mixing.mix(make_docs((1, "x")).where("false")).count() == 0
    assert mixing.mix(make_docs((1, None))).first().taken == 0
