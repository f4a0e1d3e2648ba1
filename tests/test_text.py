import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions import checks, udf
from veilspark.functions.text import scan_text, scrub_text
from veilspark.plans.text import SAMPLES


def _texts(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")


def scans(spark, texts):
    return [r.h if r.h is None else [(h.id, h.match, h.idx) for h in r.h] for r in _texts(spark, texts).orderBy("i").select(scan_text(F.col("t")).alias("h")).collect()]


def test_native_scanner_equals_python_scanner(spark):
    texts = [*SAMPLES, "é9876543210 x", "x9876543210", "_123-45-6789", "a@b.co,c@d.org", "+91 9876543210 +91-9876543210", "1.2.3.4 256.1.1.1 01.002.3.4", "4111-1111-1111-1111", "Ａ@b.co", "7412 8536 0906 7412-8536-1907"]
    assert scans(spark, texts) == [[(k, m, i) for i, _, k, m, _ in udf.scan(t)] for t in texts]
    assert scans(spark, [None, ""]) == [None, []]


def test_seed_outcomes(spark):
    found = scans(spark, SAMPLES[:21])
    assert all(found[:13]) and not any(found[13:])


@pytest.mark.parametrize(
    "text, clean",
    [
        ("mail me at a@b.com ok", "mail me at [REDACTED:EMAIL] ok"), ("a@b.com and c@d.org", "[REDACTED:EMAIL] and [REDACTED:EMAIL]"), ("+91 9876543210", "[REDACTED:PHONE-IN]"),
        ("ABCDE1234F@longcompany.com", "[REDACTED:EMAIL]"), ("1.2.3.4.bob@secretdomain.com tail", "[REDACTED:EMAIL] tail"), ("no pii", "no pii"), ("", ""), (None, None),
    ],
)
def test_scrub(spark, text, clean):
    assert _texts(spark, [text]).select(scrub_text(F.col("t"))["text"]).first()[0] == clean
    if text is not None:
        assert udf.scrub(text)[0] == clean


def test_fixpoint_uncovers_runs(spark):
    one, two = _texts(spark, ["id 4111 1111 1111 1111 9876543210"]).select(scrub_text(F.col("t"))["text"], scrub_text(F.col("t"), passes=2)["text"]).first()
    assert "9876543210" in one and "9876543210" not in two


def test_long_text(spark):
    text = "x" * 200_000 + " a@b.com " + "9" * 50_000
    assert scans(spark, [text]) == [[("email", "a@b.com", 200_001)]]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="0123456789 -+@.abcAB", max_size=60))
def test_scrubbing_leaves_nothing(text):
    for _ in range(3):
        text, _ = udf.scrub(text)
    assert udf.scan(text) == []


def test_check_digits(spark):
    rows = [("4111111111111111",), ("741285360906",), ("741285360907",), ("",), (None,), ("12345678901x",)]
    got = spark.createDataFrame(rows, "d STRING").select(checks.luhn_valid(F.col("d")), checks.verhoeff_valid(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False), (False, False), (False, False), (False, False)]


def test_scrub_json(spark):
    deep = {"a": [{"value": "hunter2", "__sensitive": True, "b": ["x a@b.com"]}, 3, None, {"value": "keep"}]}
    rows = [(json.dumps(deep),), ("{",), (None,), (json.dumps("c@d.org"),)]
    out = [r[0] for r in spark.createDataFrame(rows, "b STRING").select(udf.scrub_json("b").alias("s")).collect()]
    assert json.loads(out[0].json) == {"a": [{"value": "[REDACTED:FIELD]", "__sensitive": True, "b": ["x [REDACTED:EMAIL]"]}, 3, None, {"value": "keep"}]}
    assert out[0].by_kind == {"field": 1, "email": 1} and out[1].json is None and out[2].json is None and json.loads(out[3].json) == "[REDACTED:EMAIL]"


def test_sql_names(spark):
    udf.register_sql(spark)
    assert spark.sql("SELECT r.kind FROM VALUES ('a@b.com'), (null) AS t(x), LATERAL scan_text_rows(t.x) r").collect()[0][0] == "email"
    assert spark.sql("SELECT scrub_text('a@b.com x')").first()[0] == "[REDACTED:EMAIL] x"
