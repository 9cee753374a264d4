import numpy as np
import pytest

from gleanworks.llm import vectors


def brute(rows, cosine=0.9):
    units = []
    for _, v in rows:
        a = np.array([np.nan if x is None else x for x in v], float) if v else np.zeros(0)
        n = np.linalg.norm(a) if len(a) else 0.0
        units.append(a / n if np.isfinite(n) and n > 0 else None)
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, links[k], least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")


@pytest.mark.parametrize("cell_rows", [15, 60, 4096])
def test_same_as_brute_force(spark, cell_rows):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    rows = [(k, (base[k % 40] * rng.uniform(1, 5) + rng.normal(size=8) * 0.25).tolist()) for k in range(200)]
    rows += [(300 + k, base[0].tolist()) for k in range(30)] + [(400, (base[0] * 2).tolist())]
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [1.0, None] + [0.0] * 6), (504, [float("nan")] * 8), (505, [float("inf")] + [1.0] * 7),
             (506, [0.0] * 8), (507, [1.0, 1.0]), (508, [2.0, 2.0]), (509, [1.0]), (510, base[0].tolist()), (510, base[0].tolist())]
    got = vectors.near_vectors(frame(spark, rows), cell_rows=cell_rows)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_null_id_and_empty_table(spark):
    got = vectors.near_vectors(frame(spark, [(None, [1.0, 0.0]), (3, [1.0, 0.1])])).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 1, 3, False), (3, 1, 3, True)], key=str)
    assert vectors.near_vectors(frame(spark, [(1, [1.0])]).where("false")).count() == 0


def test_given_embeddings(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table.collect()]
    assert sorted(map(tuple, vectors.near_vectors(table, cell_rows=100).collect())) == brute(rows)
