from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gleanworks import schemas
from gleanworks.operators import joins, paging, predicates, protection
from gleanworks.plans import extensions, flows
from gleanworks.session import new_location
from gleanworks.sources import files, tables

NOW = "2024-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def test_create_refuses_an_existing_table(spark, tmp_path):
    fields = [{"name": "id", "type": "INTEGER", "mode": "REQUIRED"}, {"name": "name", "type": "STRING"}]
    schema = tables.create(spark, str(tmp_path / "t"), fields)
    assert [f.dataType.simpleString() for f in schema] == ["bigint", "string"]
    with pytest.raises(AnalysisException):
        tables.create(spark, str(tmp_path / "t"), fields)
    tables.append(spark.range(2000).select("id", F.lit("n").alias("name")), str(tmp_path / "t"), schema)
    assert spark.read.schema(schema).parquet(str(tmp_path / "t")).count() == 2000


def test_upsert_last_write_wins(spark):
    base = spark.createDataFrame([("k", 1, 1), ("old", 1, 9), ("same", 1, 5)], "k string, v int, t int")
    changes = spark.createDataFrame([("k", 2, 2), ("k", 3, 1), ("old", 2, 3), ("new", 7, 1), ("new", 8, 2), ("same", 2, 5)], "k string, v int, t int")
    assert {r.k: r.v for r in tables.upsert(base, changes, "k", ["t"]).collect()} == {"k": 2, "old": 1, "new": 8, "same": 2}


@pytest.mark.parametrize("age, action", [(89, "ACTIVE"), (90, "ARCHIVE"), (364, "ARCHIVE"), (365, "DELETE")])
def test_retention(spark, age, action):
    df = spark.range(1).select(F.lit("raw").alias("kind"), F.timestamp_add("DAY", F.lit(-age), now()).alias("ts"))
    assert tables.retention_actions(df, "kind", "ts", now()).first().action == action


def test_lifecycle_by_newer_versions(spark):
    df = spark.createDataFrame([("a", datetime(2024, 2, 22), i) for i in range(5)], "name string, ts timestamp_ntz, i int")
    acted = tables.lifecycle_actions(df, ["name"], ["ts", "i"], now())
    assert {r.i: (r.newer_versions, r.action) for r in acted.collect()} == {
        4: (0, "KEEP"), 3: (1, "KEEP"), 2: (2, "KEEP"), 1: (3, "DELETE"), 0: (4, "DELETE")}


def test_delete_flag_archive(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    keys = spark.createDataFrame([(2,), (9,)], "id int")
    assert [r.id for r in tables.delete_keys({"t": df}, keys, "id")["t"].orderBy("id").collect()] == [1, 3]
    assert {r.id: r.archived for r in tables.flag_archived(df, keys, "id", now()).collect()} == {1: False, 2: True, 3: False}
    archived, rest = tables.move_to_archive(df, F.col("id") == 2, now(), 10)
    assert archived.first().retention_expiry == datetime(2024, 6, 11) and rest.count() == 2


def test_status_update(spark):
    log = spark.createDataFrame([("a", "PENDING", 1, 0), ("a", "RUNNING", 2, 1), ("b", "COMPLETED", 3, 1)], "job string, status string, version int, at int")
    updates = spark.createDataFrame([("a", "COMPLETED", 2), ("b", "RUNNING", 2), ("c", "RUNNING", 2)], "job string, status string, at int")
    accepted, rejected = tables.status_update(log, updates, "job", "at")
    assert [(r.job, r.status, r.version) for r in accepted.collect()] == [("a", "COMPLETED", 3)]
    assert {r.job for r in rejected.collect()} == {"b", "c"}


def test_status_updates_of_one_job_apply_in_order(spark):
    log = spark.createDataFrame([("a", "PENDING", 1, 0)], "job string, status string, version int, at int")
    updates = spark.createDataFrame([("a", s, k) for k, s in enumerate(["RUNNING", "RUNNING", "FAILED", "COMPLETED", "RETRYING"])], "job string, status string, at int")
    accepted, rejected = tables.status_update(log, updates, "job", "at")
    assert sorted((r.at, r.status, r.version) for r in accepted.collect()) == [(0, "RUNNING", 2), (2, "FAILED", 3), (4, "RETRYING", 4)]
    assert sorted((r.at, r.previous) for r in rejected.collect()) == [(1, "RUNNING"), (3, "FAILED")]


@pytest.mark.parametrize("pairs, strict, bad", [
    ([("PENDING", "RUNNING"), ("RUNNING", "COMPLETED")], True, 0), ([("COMPLETED", "RUNNING")], True, 1), ([("FAILED", "RETRYING")], True, 0),
    ([("RUNNING", "CANCELLED")], True, 1), ([("RUNNING", "CANCELLED")], False, 0), ([(None, "PENDING")], True, 0),
])
def test_transitions(spark, pairs, strict, bad):
    df = spark.createDataFrame(pairs, "previous string, status string")
    assert joins.invalid_transitions(df, spark, strict).count() == bad


def test_salted_join_equals_plain_join(spark):
    facts = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("i"))
    lookup = spark.range(0, 1000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted, plain = joins.salted_join(facts, lookup, ["k"], F.col("i"), 8, how), facts.join(lookup, "k", how)
        assert sorted(map(str, salted.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_children_equal_a_left_join(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, p string")
    children = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (3, 30), (9, 90)], "k int, c int")
    got, want = joins.with_children(parents, children, "k"), parents.join(children, "k", "left")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert [r.k for r in joins.having(parents, children, "k").orderBy("k").collect()] == [1, 3]
    assert [r.k for r in joins.orphans(parents, children, "k").collect()] == [2]


def test_only_small_rule_tables_are_marked_for_broadcast(spark, capsys):
    for rows, hint in ((10, True), (10_001, False)):
        table = joins.rule_table(spark, [(str(k),) for k in range(rows)], "a string")
        assert table.count() == rows
        table.explain(True)
        assert ("ResolvedHint" in capsys.readouterr().out) == hint


def test_queries_are_checked():
    for wrong in ({"page": 0}, {"page_size": 101}, {"order": "up"}, {"classification": ("SECRET",)}):
        with pytest.raises(ValueError):
            paging.DataQuery(**wrong)
    with pytest.raises(ValueError):
        paging.sort_keys("password", "asc", "id")
    with pytest.raises(ValueError):
        predicates.text_search(None, "a;b")
    with pytest.raises(ValueError):
        predicates.between_dates(None, "2024-02-01", "2024-01-01")


def test_query_and_keyset_pages(spark):
    df = spark.range(55).select("id", (F.col("id") % 7).alias("status"), F.lit("PUBLIC").alias("classification"), F.lit("m").alias("metadata"))
    page = paging.run(df, paging.DataQuery(page=6, page_size=10, sort_field="status", include_metadata=False), "id", classification="classification")
    rows = page.collect()
    assert len(rows) == 5 and rows[0].total == 55 and not rows[0].has_next and "metadata" not in page.columns
    seen, cursor = [], None
    while True:
        rows = paging.after_cursor(df, "status", "id", cursor, 10).collect()
        seen += [r.id for r in rows]
        cursor = paging.next_cursor(rows)
        if cursor is None:
            break
    assert seen == [r.id for r in df.orderBy("status", "id").collect()]


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_keyset_walks_over_nulls(spark, order):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 1), (5, 5), (6, None)], "id int, v int")
    seen, cursor = [], None
    while True:
        rows = paging.after_cursor(df, "v", "id", cursor, 2, order).collect()
        seen += [r.id for r in rows]
        cursor = paging.next_cursor(rows)
        if cursor is None:
            break
    assert seen == ([4, 2, 5] if order == "asc" else [2, 5, 4]) + [1, 3, 6]


def test_clearance(spark):
    df = spark.createDataFrame([("PUBLIC", "RESTRICTED"), ("RESTRICTED", "INTERNAL"), ("OTHER", "RESTRICTED")], "r string, c string")
    assert [x.ok for x in df.select(predicates.cleared_for(F.col("r"), F.col("c")).alias("ok")).collect()] == [True, False, False]


KEYS = {1: b"1" * 32, 2: b"2" * 32}


def test_encryption_round_trip_and_guards(spark):
    df = spark.createDataFrame([(1, "secret"), (2, None), (3, "ü" * 99)], "id int, v string")
    sealed = protection.encrypt(df, "v", KEYS, 1, F.col("id")).persist()
    opened = {r.id: r.o for r in sealed.select("id", protection.decrypted("v", KEYS, F.col("id")).alias("o")).collect()}
    assert opened == {1: "secret", 2: None, 3: "ü" * 99}
    assert {r.o for r in sealed.select(protection.decrypted("v", KEYS, F.col("id") + 1).alias("o")).collect()} == {None}
    assert {r.o for r in sealed.select(protection.decrypted("v", {1: KEYS[2]}, F.col("id")).alias("o")).collect()} == {None}
    rotated = protection.rotate(sealed, "v", KEYS, 2, F.col("id")).persist()
    assert {(r.key_version, r.rotated) for r in rotated.collect()} == {(2, True)}
    assert {r.id: r.o for r in rotated.select("id", protection.decrypted("v", KEYS, F.col("id")).alias("o")).collect()} == opened
    with pytest.raises(ValueError):
        protection.encrypt(df, "v", {1: b"short"}, 1, F.col("id"))


def test_stored_records(spark):
    rows = [(i, level, "x" * i, "US") for i, level in enumerate(["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED", "RESTRICTED"], 1)]
    df = spark.createDataFrame(rows, "id int, classification string, content string, place string").withColumn("checksum", F.sha2("content", 256))
    df = df.withColumn("checksum", F.when(F.col("id") == 5, "0" * 64).otherwise(F.col("checksum")))
    stored, refused = flows.store_records(df, "id", "content", "classification", {"place": F.col("place") == "US"}, KEYS, 1, "records")
    got = {r.id: (r.location, r.encrypted, r.opened) for r in stored.select(
        "id", "location", "encrypted", flows.opened_content("content", KEYS, F.col("id")).alias("opened")).collect()}
    assert got == {
        1: ("standard/public", False, "x"), 2: ("standard/internal", False, "xx"), 3: ("secure/confidential", True, "xxx"), 4: ("secure/restricted", True, "xxxx")}
    assert [(r.id, r.violations) for r in refused.collect()] == [(5, ["checksum"])]


def test_random_vectors(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same")], "id int, v string")
    assert protection.encrypt(df, "v", KEYS, 1, F.col("id")).select("v").distinct().count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.TXT").write_text("text")
    listed = {r.name: (r.size, r.content_type) for r in files.list_files(spark, str(tmp_path)).collect()}
    assert listed == {"a.pdf": (6, "application/pdf"), "b.TXT": (4, "text/plain")}
    row = files.read_files(spark, str(tmp_path), "a.*").first()
    assert bytes(row.content) == b"%PDF-1" and len(row.checksum) == 64


def test_malformed_json_is_kept(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"jobId":"1"}\nnot json\n')
    rows = files.read_json(spark, str(tmp_path), schemas.SCRAPING_CONFIG).select("jobId", "_corrupt").collect()
    assert {(r.jobId, r._corrupt) for r in rows} == {("1", None), (None, "not json")}


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, {"b": 'say "x", y', "c": None}, [1, 2])], "a int, s struct<b:string,c:int>, l array<int>")
    files.export_csv(df, str(tmp_path / "out"))
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first()
    assert (row.a, row.s_b, row.s_c, row.l) == ("1", 'say "x", y', None, "[1,2]")


def test_history_append(spark):
    df = spark.createDataFrame([(1, datetime(2024, 5, 31, 23, 59))], "id int, timestamp timestamp_ntz")
    row = flows.with_history(flows.with_history(df, "EXTRACT", now(), F.lit(False)), "LOAD", now(), F.lit(True), "E1").first()
    assert [(s.operation, s.status, s.duration) for s in row.history] == [("EXTRACT", "SUCCESS", 60000), ("LOAD", "FAILURE", 60000)]
    assert row.history[1].error.code == "E1" and row.history[0].error is None


def test_collectors(spark):
    known = extensions.Collectors()
    known.register("A", lambda df: df.where("id > 1"))
    assert known.run("A", spark.range(4)).count() == 2
    with pytest.raises(ValueError):
        known.register("A", lambda df: df)
    with pytest.raises(KeyError):
        known.run("B", spark.range(1))


def test_locations_are_never_reused(spark):
    assert new_location(spark, "x") != new_location(spark, "x")


def test_shared_folder_setting_wins():
    class Settings(dict):
        master, applicationId = "yarn", "app"

    class Session:
        def __init__(self, **settings):
            self.conf = self.sparkContext = Settings(settings)

    assert new_location(Session(**{"spark.checkpoint.dir": "hdfs:///shared"}), "x").startswith("hdfs:///shared/x-")
    with pytest.raises(ValueError):
        new_location(Session(), "x")


def test_keys_are_not_in_plans(spark, capsys):
    keys = {1: bytes(range(32)), 2: bytes(range(32, 64))}
    df = spark.createDataFrame([(1, "secret")], "id int, v string")
    sealed = protection.encrypt(df, "v", keys, 1, F.col("id"))
    turned = protection.rotate(sealed, "v", keys, 2, F.col("id"))
    opened = turned.select(protection.decrypted("v", keys, F.col("id")).alias("v"))
    assert opened.first().v == "secret"
    for frame in (sealed, turned, opened):
        frame.explain(True)
        frame.explain("codegen")
    shown = capsys.readouterr().out.lower().replace(" ", "").replace(",", "")
    assert all(k.hex()[:16] not in shown and "".join(map(str, k))[:20] not in shown for k in keys.values())
