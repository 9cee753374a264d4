from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleanworks import schemas
from gleanworks.operators import validation as v


def test_engine(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, "", 5), (3, None, None)], "k int, s string, n int")
    rules = {"filled": v.filled(F.col("s")), "small": F.col("n") < 6}
    checked = {r.k: r.violations for r in v.check(df, rules).collect()}
    assert checked == {1: [], 2: ["filled"], 3: ["filled", "small"]}
    report = {r.rule_id: (r.checked, r.failed) for r in v.report(df, rules).collect()}
    assert report == {"filled": (3, 2), "small": (3, 1)}
    assert v.verdicts(df, "k", rules).where("not ok").count() == 3
    budget = v.within_error_budget(df, rules).first()
    assert (budget.bad_rows, budget.within_budget) == (2, False)


def test_stages(spark):
    df = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, True)], "k int, a boolean, b boolean")
    stages = {"schema": F.col("a"), "storage": F.col("b")}
    got = {r.k: (r.f, r.c) for r in df.select("k", v.first_failure(stages).alias("f"), v.completed_stages(stages).alias("c")).collect()}
    assert got == {1: (None, ["schema", "storage"]), 2: ("storage", ["schema"]), 3: ("schema", [])}


@pytest.mark.parametrize("start, end, bad", [
    ("2023-01-01 09:00:00", "2024-01-01 09:00:00", []),
    ("2023-01-01 09:00:00", "2024-01-02 09:00:00", ["length"]),
    ("2023-01-01 08:59:00", "2023-01-01 10:00:00", ["start_hours"]),
    ("2023-01-01 09:00:00", "2023-01-01 17:00:00", []),
    ("2023-01-01 09:05:00", "2023-01-02 17:01:00", ["end_hours"]),
    ("2023-01-02 10:00:00", "2023-01-01 10:00:00", ["ordered"]),
])
def test_date_range(spark, start, end, bad):
    df = spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("a"), F.lit(end).cast("timestamp_ntz").alias("b"))
    assert v.check(df, v.date_range(F.col("a"), F.col("b"))).first()["violations"] == bad


def result(**changes):
    file = {"name": "raw.json", "bucket": "b", "size": 1024}
    base = {
        "id": "1b9d6bcd-bbfd-4b2d-9b5d-ab8dfbbd4bed", "jobId": "j", "sourceType": "WEBSITE", "sourceUrl": "https://x.org",
        "timestamp": datetime(2024, 1, 1),
        "storage": {"rawFile": file, "processedFile": {**file, "size": 512}, "bigQueryTable": "t", "version": "1.0.0", "compressionType": "GZIP", "encryptionKey": "k"},
        "metadata": {"size": 1024, "itemCount": 1, "format": "json", "contentType": "application/json", "checksum": "c", "validationStatus": "VALID",
                     "qualityMetrics": {"completeness": 1.0, "accuracy": 1.0, "consistency": 1.0, "freshness": 1.0}},
    }
    for path, new in changes.items():
        target, *rest = path.split("__")
        if rest:
            inner = base[target]
            for part in rest[:-1]:
                inner[part] = dict(inner[part])
                inner = inner[part]
            inner[rest[-1]] = new
        else:
            base[target] = new
    return base


@pytest.mark.parametrize("changes, stage", [
    ({}, None), ({"sourceUrl": ""}, "schema"), ({"id": "nope"}, "schema"), ({"metadata__itemCount": 0}, "metadata"),
    ({"metadata__qualityMetrics__completeness": 0.9}, "metadata"), ({"storage__rawFile__size": 0}, "storage"), ({"storage__version": None}, "storage"),
])
def test_result_stages(spark, changes, stage):
    df = spark.createDataFrame([result(**changes)], schemas.SCRAPING_RESULT)
    assert df.select(v.first_failure(v.result_stages()).alias("f")).first()["f"] == stage


def test_stored_result_uses_percent_scale(spark):
    df = spark.createDataFrame([result(metadata__qualityMetrics__completeness=100.0), result(metadata__qualityMetrics__accuracy=101.0)], schemas.SCRAPING_RESULT)
    assert [r.violations for r in v.check(df, v.stored_result()).collect()] == [[], ["accuracy"]]


def test_job_rules(spark):
    def job(**c):
        details = {"startTime": datetime(2024, 1, 1), "endTime": datetime(2024, 1, 2), "attempts": 1, "metrics": {"successRate": 1.0}}
        details.update(c)
        return {"id": "1b9d6bcd-bbfd-4b2d-9b5d-ab8dfbbd4bed", "status": "RUNNING", "executionDetails": details}

    df = spark.createDataFrame([job(), job(attempts=4), job(endTime=datetime(2023, 1, 1)), job(endTime=None), job(metrics={"successRate": 0.9})], schemas.SCRAPING_JOB)
    assert [r.violations for r in v.check(df, v.job()).collect()] == [[], ["attempts"], ["times_ordered"], [], ["success_rate"]]


def test_document_metadata(spark):
    def doc(**c):
        meta = {"fileName": "test.pdf", "mimeType": "application/pdf", "size": 1024, "uploadedAt": datetime(2024, 1, 1), "complianceFlags": []}
        return {"documentId": "d", "metadata": {**meta, **c}}

    rows = [doc(), doc(fileName="te$t.pdf"), doc(size=0), doc(mimeType="text/plain"), doc(fileName="test.png"), doc(uploadedAt=datetime(2030, 1, 1)), doc(size=60 * 2**20)]
    df = spark.createDataFrame(rows, schemas.DOCUMENT)
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    assert [r.violations for r in v.check(df, v.document_metadata(now)).collect()] == [
        [], ["file_name"], ["size"], ["mime", "extension"], ["extension"], ["uploaded_at"], ["size"]]


def test_duplicate_page_numbers(spark):
    def ocr(pages):
        return {"documentId": "1b9d6bcd-bbfd-4b2d-9b5d-ab8dfbbd4bed", "text": "t", "confidence": 0.9, "processedAt": datetime(2024, 1, 1),
                "pageResults": [{"pageNumber": p, "text": "t", "confidence": 0.9} for p in pages]}

    df = spark.createDataFrame([ocr([1, 2]), ocr([1, 1]), ocr([])], schemas.OCR_RESULT)
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    assert [r.violations for r in v.check(df, v.processing_result(now)).collect()] == [[], ["unique_pages"], ["has_pages"]]


def test_metric_points_and_approval(spark):
    df = spark.createDataFrame([("a", 1.0, {}), ("", 1.0, None), ("b", float("nan"), {str(i): "x" for i in range(11)})], "n string, v double, l map<string,string>")
    got = [r.violations for r in v.check(df, v.metric_point(F.col("n"), F.col("v"), F.col("l"))).collect()]
    assert got == [[], ["name"], ["value", "labels"]]
    rows = spark.createDataFrame([("RESTRICTED", ["APPROVED"]), ("RESTRICTED", []), ("PUBLIC", [])], "c string, f array<string>")
    assert [r.ok for r in rows.select(v.restricted_approved(F.col("c"), F.col("f")).alias("ok")).collect()] == [True, False, True]


def test_custom_rules_must_be_columns():
    with pytest.raises(TypeError):
        v.custom({"bad": True})
