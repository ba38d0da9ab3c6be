import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.functions.providers import Config


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "day"), [("Tue, 05 Mar 2024 23:11:12 -0500", "2024-03-06"), ("2024-03-05T10:00:00+00:00", "2024-03-05"), ("2024-03-05T10:00+1100", "2024-03-04"), ("Tue, 5 Mar 2024 23:11:12 GMT", "2024-03-05"), ("2024-03-05", "2024-03-05"), ("", "2024-03-31"), ("garbage", "2024-03-31"), (None, "2024-03-31"), ("2024-02-31", "2024-03-31")])
def test_utc_day(spark, text, day):
    assert one(spark, S.utc_day(F.lit(text).cast("string"), "2024-03-31")) == day


@pytest.mark.parametrize(("day", "before"), [("2024-03-31", "2024-03-02"), ("2023-03-29", "2023-03-01"), ("2024-01-15", "2023-12-15"), ("2024-03-15", "2024-02-15")])
def test_month_before(spark, day, before):
    assert str(one(spark, S.month_before(F.lit(day).cast("date")))) == before


@pytest.mark.parametrize(
    ("completion", "entries"),
    [
        ('{"matched_jobs":[{"jobId":"a","matchScore":"9"}]}', [("a", "9")]),
        ('[{"jobId":"a","matchScore":7},{"jobId":"a","matchScore":7}]', [("a", "7"), ("a", "7")]),
        ('{"matched_jobs":[]}', []),
        ('{"x":1}', []),
        ("null", []),
        ("", []),
        (None, []),
        ('```json\n{"matched_jobs":[]}\n```', []),
        ("garbage", []),
    ],
)
def test_ranked_entries(spark, completion, entries):
    got = one(spark, S.ranked_entries(F.lit(completion).cast("string")))
    assert [(r["jobId"], r["matchScore"]) for r in got] == entries


@pytest.mark.parametrize(("a", "b", "score"), [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0)])
def test_cosine(spark, a, b, score):
    arr = lambda v: F.array(*[F.lit(x) for x in v])
    assert one(spark, S.cosine(arr(a), arr(b))) == pytest.approx(score)


def test_cosine_refuses_other_widths(spark):
    with pytest.raises(Exception, match="different width"):
        one(spark, S.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))


def test_texts(spark):
    assert one(spark, S.trim(F.lit("  \n　a b﻿\t"))) == "a b"
    assert one(spark, S.split_keeping(F.lit(""))) == [""]
    assert one(spark, S.split_keeping(F.lit("a  b"))) == ["a", "", "b"]
    assert one(spark, S.split_keeping(F.lit("a.b"), ".")) == ["a", "b"]
    assert one(spark, S.day_part(F.lit(None).cast("string"))) == ""
    assert one(spark, S.replace_first(F.lit("x{a}y{a}"), "{a}", F.lit("$&{a}"))) == "x$&{a}y{a}"
    assert one(spark, S.replace_first(F.lit("none"), "{a}", F.lit("v"))) == "none"
    assert one(spark, S.person_name(F.lit("Ada"), F.lit(None).cast("string"))) == "Ada"
    assert one(spark, S.blank_to(F.lit(""), "d")) == "d"
    assert one(spark, S.tags_of(F.lit("oops"))) == []
    assert one(spark, S.tags_of(F.lit('["a",""]'))) == ["a", ""]
    assert one(spark, S.tags_json(F.array(F.lit("a")))) == '["a"]'


@pytest.mark.parametrize(("n", "pages"), [(0, 1), (10, 1), (11, 2)])
def test_pages(spark, n, pages):
    assert one(spark, S.page_count(F.lit(n))) == pages


@pytest.mark.parametrize(("page", "action", "leads_to"), [(0, "next", 1), (3, "previous", 2), (0, "previous", None), (1, "label", None), (1, None, None)])
def test_navigation(spark, page, action, leads_to):
    assert one(spark, S.next_page(F.lit(page), F.lit(action).cast("string"))) == leads_to


def test_indented_json(spark):
    rows = spark.createDataFrame([(2, "b", 'say "x"\n'), (1, "a", None)], "r int, id string, t string")
    text = rows.agg(S.indented_array(F.col("r"), S.indented_json({"id": F.col("id"), "t": F.col("t")})).alias("x")).first()[0]
    assert text == json.dumps([{"id": "a", "t": None}, {"id": "b", "t": 'say "x"\n'}], indent=2)


def test_config_takes_empty_for_absent():
    assert Config.of({"MILLRACE_TOP_K": ""}).top_k == 30
    assert Config.of({"MILLRACE_TOP_K": "5"}).top_k == 5
