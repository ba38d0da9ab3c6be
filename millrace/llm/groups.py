"""Groups of records that are linked, directly or through others.

Alternating large and small stars: every node points its larger neighbours, then
its smaller ones, at the least node it knows, until nothing changes. Groups of
any size are only ever aggregated by node, never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage, release

#: Rounds after which something must be wrong: they grow as the square of the
#: logarithm of the longest chain.
MOST_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """The least of each node's neighbours and itself."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.toDF("u", "v")).where("u <> v").distinct()


def group_of(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, group_id)`` for every id in ``pairs``; the group is its least id.

    Pairs with a null are left out; pairs of one id with itself and repeated
    pairs change nothing; no pairs give no rows.
    """
    edges = cut_lineage(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct())
    for _ in range(MOST_ROUNDS):
        after = cut_lineage(_small_star(_large_star(edges)))
        mark = lambda e: e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        same = mark(edges) == mark(after)
        release(edges)
        edges = after
        if same:
            break
    else:
        raise RuntimeError("the groups don't settle")
    return edges.toDF("id", "group_id").union(edges.select("v", "v")).distinct()


def grouped_records(records: DataFrame, key: str, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``(key, group_id, links)``: one row a distinct key; one without partner is
    its own group with no links. Null keys are left out."""
    ids = records.select(F.col(key).alias("id")).where("id is not null").distinct()
    pairs = cut_lineage(pairs)
    links = pairs.select(F.col(a).alias("id")).union(pairs.select(F.col(b))).groupBy("id").agg(F.count("*").alias("links"))
    groups = group_of(pairs, a, b)
    return ids.join(groups, "id", "left").join(links, "id", "left").select(F.col("id").alias(key), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
