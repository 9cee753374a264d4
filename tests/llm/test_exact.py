import hashlib
import re

import compare

from gleanworks.llm import exact


def brute(rows):
    norm = [(i, re.sub(r"[ \t-\r]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, least[t], len(groups[t]), i == least[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=str)


def test_same_as_brute_force_with_odd_rows(odd_docs):
    got = exact.exact_duplicates(odd_docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_frequent_texts_are_split_off_and_counted(make_docs):
    docs = make_docs(*[(k, "hot\ttext" if k % 3 == 0 else f"text {k % 200}") for k in range(900)])
    frequent = {r.group_size for r in exact.frequent_digests(
        docs.selectExpr("doc_id", "unhex(sha2(regexp_replace(text, '\\\\s+', ' '), 256)) as digest"), counters=16).collect()}
    assert 300 in frequent
    assert sorted(map(tuple, exact.exact_duplicates(docs, counters=16).collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(make_docs):
    assert exact.exact_duplicates(make_docs((1, "x")).where("false")).count() == 0


def test_query_beside_sql(spark, folder):
    assert compare.compare(spark, compare.duck(folder), "op10_exact_dedup", folder)[0] == "same"
