"""The N best items of every group, when single groups hold millions of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage

#: Rows of a group that are ranked in one place, about; larger groups are hashed into subgroups.
TOGETHER = 100_000


def readable_score(score: Column) -> Column:
    """A written score as a number from 0 to 10, null where it can't be read.

    Understood are plain numbers, a decimal point or comma, ``x/10`` and other
    denominators, and percentages (the share of 10).
    """
    text = F.translate(F.lower(score), ", \t\n\r\u00a0", ".")
    text = F.replace(F.replace(text, F.lit("outof"), F.lit("/")), F.lit("of"), F.lit("/"))
    readable = text.rlike(r"^(?:\d+\.?\d*|\.\d+)(?:%|/\d+\.?\d*)?$")
    number = F.substring_index(F.substring_index(text, "%", 1), "/", 1).try_cast("double")
    whole = F.when(F.endswith(text, F.lit("%")), F.lit(100.0)).otherwise(F.coalesce(F.nullif(F.split_part(text, F.lit("/"), F.lit(2)), F.lit("")), F.lit("10")).try_cast("double"))
    value = F.round(number * 10 / F.nullif(whole, F.lit(0.0)), 6)
    return F.when(readable, F.when(value.between(0, 10), value))


def top_per_group(df: DataFrame, group: str, item: str, score: Column, time: Column, n: int = 10, together: int = TOGETHER) -> DataFrame:
    """``(group, item, rank_no)``: the ``n`` best items of each group.

    Order: higher score, later time (null last), smaller item. An item counts
    once in its group, by its best row. Rows with a null group, item or score
    are left out. An empty input gives no row; equal rows count once.

    Two stages: a group is hashed by item into as many subgroups as it has times
    ``together`` rows, so a group of any size is spread over tasks of that size;
    an item's rows meet in one subgroup, where its best row is found and all but
    ``n`` items are dropped. The second stage ranks the survivors of a group. A
    group of one subgroup has its ranks after the first stage, so its rows are
    moved once. The sizes are counted first, from the column ``group`` alone.
    """
    named = df.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    sizes = named.groupBy(F.col(group).alias("_large_group")).count().where(F.col("count") > together)
    large = cut_lineage(sizes.select("_large_group", F.ceil(F.col("count") / together).cast("int").alias("_large_subgroups")))
    is_large = F.col(group) == F.col("_large_group")
    # Scores are read after the groups are told apart, so each is read once.
    wanted = [F.col(group).alias("g"), F.col(item).alias("i"), score.alias("s"), time.alias("t")]
    order = [F.desc("s"), F.desc_nulls_last("t"), F.asc("i")]

    def best(part: DataFrame, *by: str) -> DataFrame:
        # The score is tested after the aggregation: tested before, it would be parsed twice a row.
        items = part.repartition(*by).groupBy(*by, "i").agg(F.max(F.struct("s", "t")).alias("b")).select(*by, "i", "b.s", "b.t").where("s is not null")
        return ranked(items, *by)

    def ranked(items: DataFrame, *by: str) -> DataFrame:
        return items.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= n)

    salt = F.pmod(F.xxhash64(F.col(item)), F.col("_large_subgroups")).cast("int").alias("salt")
    of_large = ranked(best(named.join(large, is_large).select(*wanted, salt), "g", "salt").drop("r", "salt"), "g")
    of_others = best(named.join(large, is_large, "left_anti").select(*wanted), "g")
    return of_others.unionByName(of_large).select(F.col("g").alias(group), F.col("i").alias(item), F.col("r").cast("bigint").alias("rank_no"))
