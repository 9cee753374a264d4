from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanworks.functions import privacy, scores, shapes, text as tx, times, urls


@pytest.mark.parametrize("text, expected", [
    ("a b c d. e f", 0.15), ("", 0.0), ("...", 1.0), (" . ", 0.025), ("one two﻿three", 0.15), ("word " * 50, 1.0),
])
def test_completeness(value, text, expected):
    assert value(scores.text_completeness, text=text) == pytest.approx(expected)


@pytest.mark.parametrize("text, expected", [("aa\naaaa", 2 / 3), ("one line", 1.0), ("", 0.0), ("\n\n", 1.0), ("a\n" + "b" * 99, 0.02)])
def test_consistency(value, text, expected):
    assert value(scores.text_consistency, text=text) == pytest.approx(expected)


def test_null_text_scores_zero(value):
    assert value(lambda t: scores.text_completeness(t.cast("string")), t=None) == 0.0
    assert value(lambda t: scores.text_consistency(t.cast("string")), t=None) == 0.0


@pytest.mark.parametrize("metrics, status", [
    ((0.5, 0.6, 0.4, 0.3), "INVALID"), ((0.56,) * 4, "PARTIAL"), ((0.8,) * 4, "VALID"), ((0.5599,) * 4, "INVALID"),
])
def test_quality_status(value, metrics, status):
    names = dict(zip("abcd", metrics))
    assert value(lambda *m: scores.quality_status(scores.quality_average(*m)), **names) == status


def test_field_completeness(value):
    assert value(lambda a, b: scores.field_completeness([a, b.cast("string")]), a="x", b=None) == 0.5
    assert value(lambda: scores.field_completeness([])) == 1.0


@pytest.mark.parametrize("entities, classes, expected", [
    ([0.95, 0.90], [0.92], 0.9225), ([], [0.95], 0.475), ([], [], 0.0), ([0.8], [], 0.4),
])
def test_combined_confidence(value, entities, classes, expected):
    def build(_):
        as_array = lambda xs: F.array(*map(F.lit, xs)).cast("array<double>")
        return scores.combined_confidence(as_array(entities), as_array(classes))

    assert value(build, x=1) == pytest.approx(expected)


@pytest.mark.parametrize("length, expected", [(18, 0.72), (19, 0.76), (20, 0.80), (40, 0.80)])
def test_entity_confidence(value, length, expected):
    assert value(lambda e: scores.entity_confidence(e), e="x" * length) == pytest.approx(expected)


@pytest.mark.parametrize("n, delay", [(1, 1000), (3, 4000), (7, 30000)])
def test_backoff(value, n, delay):
    assert value(lambda k: times.backoff_ms(k, 1000, 2, 30000), k=n) == delay


def test_eta_and_stage(value):
    assert value(times.eta_seconds, elapsed=20.0, progress=20) == 80.0
    assert value(times.eta_seconds, elapsed=20.0, progress=0) is None
    assert [value(times.progress_stage, p=p) for p in (19, 20, 90)] == ["PREPROCESSING", "RECOGNITION", "POSTPROCESSING"]


@pytest.mark.parametrize("literal, seconds", [("300s", 300), ("90d", 7776000), ("7y", 220752000), ("5w", None), ("", None)])
def test_durations(value, literal, seconds):
    assert value(times.parse_duration_seconds, d=literal) == seconds


@pytest.mark.parametrize("raw, masked", [
    ("a@b.co", "[REDACTED email]"), ("call 5551234567", "[REDACTED phone]"), ("4111 1111 1111 1111", "[REDACTED creditCard]"),
    ("123-45-6789", "[REDACTED ssn]"), ("plain", "plain"), ("", ""),
])
def test_mask_value(value, raw, masked):
    assert value(privacy.mask_value, v=raw) == masked


def test_span_redaction_keeps_the_rest(value):
    assert value(privacy.redact_spans, v="to a@b.co or 123-45-6789.") == "to [REDACTED email] or [REDACTED ssn]."


@pytest.mark.parametrize("text, expected", [
    ("Patient email: test@example.com, SSN: 123-45-6789", True), ("ssn 123-45-6789", True), ("call 555-123-4567", True),
    ("TEST@EXAMPLE.COM", True), ("nothing here 12", False), ("é555-123-4567é", True), ("x555-123-4567", False),
])
def test_pii_detection(value, text, expected):
    assert value(privacy.has_pii, t=text) is expected


def test_nested_redaction(value):
    kind = StructType.fromDDL("user string, password string, list array<struct<apiKey:string,n:int>>, m map<string,string>")
    body = '{"user":"u","password":"p","list":[{"apiKey":"k","n":1}],"m":{"Token":"t","x":"y"}}'
    assert value(lambda t: privacy.redact_json(t, kind), t=body) == (
        '{"user":"u","password":"[REDACTED]","list":[{"apiKey":"[REDACTED]","n":1}],"m":{"Token":"[REDACTED]","x":"y"}}')


@pytest.mark.parametrize("href, expected", [
    ("/x", "https://h.org/x"), ("y", "https://h.org/a/y"), ("//k.org/z", "https://k.org/z"), ("#f", "https://h.org/a/b#f"),
    ("?q=1", "https://h.org/a/b?q=1"), ("../up", "https://h.org/up"), ("./s", "https://h.org/a/s"), ("http://o.org", "http://o.org/"),
    ("../../../deep", "https://h.org/deep"), ("mailto:q@h.org", "mailto:q@h.org"), ("..", "https://h.org/"),
])
def test_resolve(value, href, expected):
    assert value(lambda h: urls.resolve(h, F.lit("https://h.org/a/b")), h=href) == expected


@pytest.mark.parametrize("url, allowed", [
    ("http://10.0.0.1", False), ("http://172.20.1.1", False), ("http://172.32.1.1", True), ("ftp://x.org", False),
    ("https://x.org", True), ("http://localhost:80/", False), ("http://127.0.0.1", False), ("http://user@192.168.0.9/", False), ("nonsense", False),
])
def test_url_policy(value, url, allowed):
    assert value(urls.is_allowed, u=url) is allowed


@pytest.mark.parametrize("name, ext", [("a.PDF", ".pdf"), ("a.tar.gz", ".gz"), (".hidden", ""), ("none", ""), ("d.x/file", "")])
def test_extension(value, name, ext):
    assert value(urls.extension, n=name) == ext


def test_space_collapse(value):
    assert value(tx.collapse_space, t=" a​ b \n\tc﻿ ") == "a b c"


def test_empty_elements(value):
    assert value(tx.strip_empty_elements, t="<p> </p><b>x</b><i></i>") == "<b>x</b>"


def test_context_window(value):
    text = "x" * 60 + "HIT" + "y" * 60
    assert value(lambda t: tx.context_window(t, F.lit(60), F.lit(63)), t=text) == "x" * 50 + "HIT" + "y" * 50
    assert value(lambda t: tx.context_window(t, F.lit(0), F.lit(2)), t="ab") == "ab"


@pytest.mark.parametrize("length, sizes", [(0, [0]), (5, [5]), (10, [10]), (11, [10, 1])])
def test_chunks(value, length, sizes):
    assert [len(c) for c in value(lambda t: tx.chunks(t, 10), t="z" * length)] == sizes


@pytest.mark.parametrize("head, mime, ok", [
    ("25504446AA", "application/pdf", True), ("FFD8FF00", "image/jpeg", True), ("89504E47", "image/png", True),
    ("49492A00", "image/tiff", True), ("89504E47", "application/pdf", False), ("00", "text/plain", True),
])
def test_signatures(value, head, mime, ok):
    assert value(lambda h, m: shapes.signature_matches(F.unhex(h), m), h=head, m=mime) is ok


def test_maps_and_coercion(value):
    merged = value(lambda _: shapes.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(9))), x=1)
    assert merged == {"a": 1, "b": 9}
    assert value(lambda v: shapes.number_or_text(v)[1], v=" 12.5 ") == 12.5
    assert value(lambda v: shapes.number_or_text(v)[1], v="abc") is None
    assert value(lambda v: shapes.json_value(v, "a.b"), v='{"a":{"b":3}}') == "3"


def test_long_base64_stays_on_one_line(value):
    assert value(shapes.base64_text, t="a" * 90) == "YWFh" * 30


def test_dates(value):
    at = datetime(2024, 2, 28, 5, 6, 7)
    assert value(lambda t: times.date_path(t.cast("timestamp_ntz")), t=at) == "2024/02/28"
    assert value(lambda t: times.stamp(times.plus_days(t.cast("timestamp_ntz"), F.lit(2))), t=at) == "2024-03-01 05:06:07"


def test_measured_quality(value):
    rules = lambda *flags: {str(k): F.lit(f).cast("boolean") for k, f in enumerate(flags)}
    assert value(lambda: scores.rule_accuracy(rules(True, False, None, True))) == 0.5
    assert value(lambda: scores.rule_accuracy({})) == 1.0
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    for at, want in (("2024-01-01 12:00:00", 1.0), ("2024-01-01 11:45:00", 1.0), ("2024-01-01 11:30:00", 0.5), ("2024-01-01 13:00:00", 1.0), (None, 0.0)):
        assert value(lambda at=at: scores.freshness(F.lit(at).cast("timestamp"), now)) == want
