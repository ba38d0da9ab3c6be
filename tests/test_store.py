import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import store as K
from millrace.schemas import USER

ITEM = "link string, pos int, v string"


def items(spark, data):
    return spark.createDataFrame(data, ITEM)


def test_insert_if_absent(spark, rows):
    store = items(spark, [("a", 0, "old"), ("", 0, "old")])
    batch = items(spark, [("a", 1, "x"), ("b", 2, "first"), ("b", 3, "second"), ("", 4, "x"), (None, 5, "n1"), (None, 6, "n2")])
    new = K.insert_if_absent(store, batch, ["link"], [F.asc("pos")])
    assert rows(new) == sorted([("b", 2, "first"), (None, 5, "n1"), (None, 6, "n2")], key=repr)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", ""]), st.integers(0, 99)), min_size=1, max_size=12))
def test_insert_again_adds_nothing(spark, data):
    batch = items(spark, [(k, n, str(i)) for i, (k, n) in enumerate(data)])
    empty = batch.limit(0)
    once = K.insert_if_absent(empty, batch, ["link"], [F.asc("pos"), F.asc("v")]).cache()
    assert once.count() == len({k for k, _ in data})
    assert K.insert_if_absent(once, batch, ["link"], [F.asc("pos")]).count() == 0


def test_known_keys(spark, rows):
    got = K.known_keys(items(spark, [("a", 1, ""), ("b", 1, ""), (None, 1, "")]), items(spark, [("a", 9, ""), ("a", 8, "")]), ["link"])
    assert rows(got, "link", "known") == sorted([("a", True), ("b", False), (None, False)], key=repr)


def test_upsert_users(spark, rows):
    store = spark.createDataFrame([("1", "Old", "o@x.example", "t1", "cv", "e", "1"), ("2", "Keep", None, None, "cv", None, None)], USER)
    batch = spark.createDataFrame([("9", "New", None, "t1", None, None, None), ("3", "Add", None, "t3", None, None, None)], USER)
    assert rows(K.upsert_users(store, batch)) == sorted([("1", "New", None, "t1", None, None, "1"), ("2", "Keep", None, None, "cv", None, None), ("3", "Add", None, "t3", None, None, None)], key=repr)


def test_updates(spark, rows):
    store = items(spark, [("a", 1, "x"), ("b", 2, "y")])
    assert rows(K.update_by_key(store, spark.createDataFrame([("a", None), ("z", "n")], "link string, v string"), "link")) == [("a", 1, None), ("b", 2, "y")]
    assert rows(K.update_where(store, F.col("pos") > 1, v=F.lit("w"))) == [("a", 1, "x"), ("b", 2, "w")]
    assert rows(K.insert_or_replace(store, spark.createDataFrame([("a", 7)], "link string, pos int"), ["link"])) == [("a", 7, None), ("b", 2, "y")]
    assert rows(K.delete_by_key(store, spark.createDataFrame([("a",)], "link string"), "link")) == [("b", 2, "y")]


def test_vectors_keep_the_last_and_their_width(spark, rows):
    store = spark.createDataFrame([("a", [0.0, 0.0])], "id string, embedding array<float>")
    batch = spark.createDataFrame([("a", [1.0, 0.0], 1), ("a", [2.0, 0.0], 2), ("b", [3.0, 0.0], 1)], "id string, embedding array<float>, pos int")
    assert rows(K.upsert_vectors(store, batch, [F.desc("pos")], 2)) == [("a", [2.0, 0.0]), ("b", [3.0, 0.0])]
    with pytest.raises(Exception, match="expected width 3"):
        K.upsert_vectors(store, batch, [F.desc("pos")], 3).collect()


def users(spark, *ids, name="A"):
    return spark.createDataFrame([(i, name, None, None, None, None, None) for i in ids], USER)


def test_snapshots(spark, rows, tmp_path):
    s = K.SnapshotStore(spark, str(tmp_path))
    assert rows(s.read("user_info")) == [] and s.version("user_info") == 0
    assert s.write("user_info", users(spark, "1")) == 1
    opened = s.read("user_info")
    assert s.write("user_info", opened.unionByName(users(spark, "2"))) == 2
    assert [r[0] for r in rows(opened)] == ["1"]
    assert [r[0] for r in rows(s.read("user_info"))] == ["1", "2"]


def test_appending_and_changing_leave_other_parts_alone(spark, rows, tmp_path):
    s = K.SnapshotStore(spark, str(tmp_path))
    s.write("user_info", users(spark, *"abc"))
    first = s.parts("user_info")
    s.append("user_info", users(spark, *"de"))
    assert s.parts("user_info")[0] == first[0] and len(s.parts("user_info")) == 2
    s.update("user_info", spark.createDataFrame([("e", "B"), ("zz", "no")], "id string, name string"), "id")
    assert first[0] in s.parts("user_info")
    assert [r[:2] for r in rows(s.read("user_info"))] == [(i, "B" if i == "e" else "A") for i in "abcde"]
    s.replace("user_info", users(spark, "a", "f", name="C"), ["id"])
    assert {r[0]: r[1] for r in rows(s.read("user_info"))} == {"a": "C", "b": "A", "c": "A", "d": "A", "e": "B", "f": "C"}
    version = s.version("user_info")
    s.update("user_info", spark.createDataFrame([("zz", "no")], "id string, name string"), "id")
    assert s.version("user_info") == version  # nothing to change, nothing written
    s.compact("user_info")
    assert len(s.parts("user_info")) == 1 and s.read("user_info").count() == 6


def test_a_commit_is_never_replaced(spark, tmp_path):
    s = K.SnapshotStore(spark, str(tmp_path))
    s.write("user_info", users(spark, "1"))
    with pytest.raises(K.CommitConflict):
        s._commit("user_info", 0, [])
    (tmp_path / "user_info" / "commits" / "2.json").write_text("")  # a writer that died
    assert s.version("user_info") == 1 and s.read("user_info").count() == 1
    assert s.append("user_info", users(spark, "2")) == 3
