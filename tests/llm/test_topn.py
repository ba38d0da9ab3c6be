import random

import pytest
from pyspark.sql import functions as F

from millrace.llm.topn import readable_score, top_per_group

SCHEMA = "user_id string, job_id string, match_score string, update_time string, rank_no int"


@pytest.mark.parametrize(
    ("text", "score"),
    [("9", 9), (" 8.5 ", 8.5), ("8,5", 8.5), ("78%", 7.8), ("100 %", 10), ("8.5/10", 8.5), ("9 / 10", 9), ("4/5", 8), ("7 out of 10", 7), ("10,0", 10), ("0", 0), (".5", 0.5), ("n/a", None), ("", None), (None, None), ("high", None), ("-1", None), ("11", None), ("5/0", None), ("120%", None), ("1e1", None), ("8f", None), ("NaN", None)],
)
def test_scores(spark, text, score):
    got = spark.createDataFrame([(text,)], "s string").select(readable_score(F.col("s"))).first()[0]
    assert got == score


def top(df, **kw):
    return top_per_group(df, "user_id", "job_id", readable_score(F.col("match_score")), F.col("update_time").try_cast("timestamp"), **kw)


def brute(data, n):
    best = {}
    for u, j, s, t in data:
        if u is not None and j is not None and s.isdigit():
            key = (-int(s), t is None, "" if t is None else "".join(chr(0x10FFFF - ord(c)) for c in t), j)
            best[u, j] = min(best.get((u, j), key), key)
    out = []
    for u in {u for u, _ in best}:
        out += [(u, j, i) for i, (_, j) in enumerate(sorted((k, j) for (v, j), k in best.items() if v == u)[:n], 1)]
    return out


def test_against_sorting(spark, rows):
    rng = random.Random(4)
    times = [None, *[f"2026-01-0{d}T00:00:00.000Z" for d in range(1, 6)]]
    data = [(rng.choice(["hot", "hot", "b", "c", None]), rng.choice([None, *[f"j{i:02}" for i in range(40)]]), rng.choice(["1", "2", "9", "n/a"]), rng.choice(times)) for _ in range(1500)]
    df = spark.createDataFrame([(*r, 0) for r in data], SCHEMA).repartition(6)
    assert rows(top(df)) == sorted(brute(data, 10), key=repr)
    assert rows(top(df, together=50)) == sorted(brute(data, 10), key=repr)  # every group in subgroups
    assert rows(top(df, n=3, together=400)) == sorted(brute(data, 3), key=repr)


def test_edges(spark, rows):
    df = spark.createDataFrame([("u", "b", "9", None, 0), ("u", "a", "9", None, 0), ("u", "a", "9", None, 0), ("u", "c", "9", "2026-01-01T00:00:00.000Z", 0), ("u", "d", None, None, 0), ("v", "a", "high", None, 0)], SCHEMA)
    assert rows(top(df)) == [("u", "a", 2), ("u", "b", 3), ("u", "c", 1)]
    assert rows(top(df.limit(0))) == []

