import random

from millrace.llm.groups import group_of, grouped_records


def union_find(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return sorted(((x, root(x)) for x in up), key=repr)


def test_against_union_find(spark, rows):
    rng = random.Random(6)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(200)]
    pairs = [(a, b) for a, b in pairs if a != b]
    df = spark.createDataFrame([*pairs, (5, 5), (None, 3), pairs[0]], "id_a bigint, id_b bigint").repartition(5)
    assert rows(group_of(df, "id_a", "id_b")) == union_find(pairs)


def test_records(spark, rows):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "id_a string, id_b string")
    records = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1), ("d", 1), (None, 1)], "id string, group_id int")
    assert rows(grouped_records(records, "id", pairs, "id_a", "id_b")) == [("a", "a", 1), ("b", "a", 2), ("c", "a", 1), ("d", "d", 0)]
    assert rows(grouped_records(records, "id", pairs.limit(0), "id_a", "id_b"), "id", "group_id") == [(x, x) for x in "abcd"]
    assert rows(grouped_records(records.limit(0), "id", pairs.limit(0), "id_a", "id_b")) == []
