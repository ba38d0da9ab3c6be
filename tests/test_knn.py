import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.scalars import cosine
from millrace.operators import knn

SCHEMA = "id bigint, embedding array<float>"


def by_pairs(queries, vectors, k):
    """Brute force: every query with every vector."""
    pairs = queries.toDF("query_id", "a").crossJoin(vectors.toDF("id", "b")).select("query_id", "id", cosine(F.col("a"), F.col("b")).alias("score"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def in_blocks(queries, vectors, k=30):
    return knn.top_similar(queries, vectors, k, most_broadcast=0)


@pytest.mark.parametrize("operator", [knn.top_similar, in_blocks])
def test_small(spark, operator):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (None, [1.0, 1.0]), (6, None)], SCHEMA)
    queries = spark.createDataFrame([(9, [5.0, 0.0]), (8, [0.0, 0.0]), (None, [1.0, 0.0])], SCHEMA)
    got = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 6)) for r in operator(queries, vectors, 3).collect()}
    assert got == {(9, 1): (1, 1.0), (9, 2): (2, 1.0), (9, 3): (3, 0.0), (8, 1): (1, 0.0), (8, 2): (2, 0.0), (8, 3): (3, 0.0)}
    assert operator(queries, vectors.limit(0)).count() == 0
    assert operator(queries.limit(0), vectors).count() == 0
    assert operator(queries, vectors, 30).where("query_id = 9").count() == 5


@pytest.mark.parametrize("operator", [knn.top_similar, in_blocks])
def test_blocks_agree_with_brute_force(spark, monkeypatch, operator):
    monkeypatch.setattr(knn, "BLOCK", 7)
    monkeypatch.setattr(knn, "STEP", 5)
    monkeypatch.setattr(knn, "MEET", 11)
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)]  # many ties
    vectors = spark.createDataFrame(data, SCHEMA).repartition(5)
    queries = vectors.where("id % 6 = 0")
    key = lambda df: sorted((r["query_id"], r["rank"], round(r["score"], 9)) for r in df.collect())
    assert key(operator(queries, vectors, 9)) == key(by_pairs(queries, vectors, 9))


def test_vectors_are_read_once(spark, tmp_path):
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], SCHEMA).write.parquet(str(tmp_path / "v"))
    vectors = spark.read.parquet(str(tmp_path / "v"))
    plan = knn.top_similar(vectors, vectors, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_list_index(spark, monkeypatch):
    monkeypatch.setattr(knn, "MEET", 20)  # lists are cut into parts
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16))
    data = [(i, [float(x) for x in centres[i % 8 if i > 200 else 0] + rng.normal(size=16) / 8]) for i in range(400)]  # half of them in one list
    vectors = spark.createDataFrame([*data, (None, [1.0] * 16), (900, None)], SCHEMA)
    queries = vectors.where("id % 50 = 0")
    index = knn.ListIndex(vectors, probes=3, lists=8)
    assert index.recall(queries, 10) >= 0.9
    assert index.query(queries, 10).where("rank <= 10").count() == 80
    assert sorted(r["id"] for r in index.get(spark.createDataFrame([(3,), (3,), (777,)], "id bigint")).collect()) == [3]
    assert knn.ListIndex(vectors, probes=8, lists=8).recall(queries, 10) == 1.0
    empty = vectors.limit(0)
    assert knn.ListIndex(empty).query(queries, 3).count() == 0


@pytest.mark.parametrize("operator", [knn.top_similar, in_blocks])
def test_scores_equal_to_nine_digits_are_in_the_order_of_ids(spark, operator):
    rng = np.random.default_rng(3)
    way = rng.normal(size=16)
    data = [(i, [float(x) for x in way * s]) for i, s in enumerate(rng.uniform(0.1, 9, 300))]  # one direction, so all scores are 1 but for float rounding
    vectors = spark.createDataFrame(data, "id bigint, embedding array<double>").repartition(5)
    got = operator(vectors.where("id in (7, 8)"), vectors, 20)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got.collect()) == [(q, i + 1, i) for q in (7, 8) for i in range(20)]


def test_equal_vectors_leave_no_more_than_k(spark):
    import pyarrow as pa

    unit = knn._unit(np.random.default_rng(4).normal(size=(50, 8)))
    best = knn._Best(np.arange(50).astype(object), unit, 3)
    best.meet(np.array([f"{i:04}" for i in range(4000)], object), np.repeat(unit[:2], 2000, axis=0))
    found = pa.Table.from_batches(best.batches(pa.schema([("q", pa.int64()), ("id", pa.string()), ("s", pa.float64())]))).to_pylist()
    assert len(found) == 150 and {r["id"] for r in found if r["q"] == 0} == {"0000", "0001", "0002"} and {r["id"] for r in found if r["q"] == 1} == {"2000", "2001", "2002"}


@pytest.mark.parametrize("most", [0, knn.MOST_BROADCAST])
def test_equal_queries_are_searched_once(spark, most):
    data = [(i, [float(i % 3), 1.0]) for i in range(60)]
    vectors = spark.createDataFrame(data, SCHEMA)
    found, members = knn.shared_similar(vectors, vectors, 4, most)
    assert found.count() == 12 and members.count() == 60
    got = knn.top_similar(vectors, vectors, 4, most).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got) == [(q, n + 1, q % 3 + 3 * n) for q in range(60) for n in range(4)]
    # An id with several vectors has one result from all of them.
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], SCHEMA)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in knn.top_similar(twice, vectors, 3, most).collect()) == [(1, 1, 0), (1, 2, 3), (1, 3, 6), (2, 1, 2), (2, 2, 5), (2, 3, 8)]
