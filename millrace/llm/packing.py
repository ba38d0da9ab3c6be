"""Items of varying length packed into containers of fixed capacity.

Hierarchical residual packing. Items are spread by hash, so that every partition
has a like mixture of sizes; it packs them by best fit, largest first, and emits
the containers that are nearly full. The others go up
a level as items of their own, several partitions to one, and are packed again.
Once a partition holds as many as a task packs together, further rounds mix the
underfull containers of all partitions anew, until they fit in one task or a
round saves next to nothing. A container carries its members (at most
``capacity`` of them, as no item is empty), so no level joins back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from millrace.session import cut_lineage

CAPACITY = 2048
#: Share of the capacity from which a container is closed before the last level.
NEARLY_FULL = 0.998
#: Partitions packed together at the next level.
FAN_IN = 8
#: Items and members of items that a task packs together, about. It bounds the
#: memory of a task, not what is packed: further items are a further block, and
#: what either leaves open meets again.
TOGETHER, MEMBERS = 50_000, 500_000
#: Rounds at one number of partitions end when one saves a smaller share of the containers.
LEAST_GAIN = 0.001

_BINS = "container string, fill int, open boolean, members array<struct<k:{0},part:int,start:bigint,n:int>>"


def best_fit(items: Iterable[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Containers ``(fill, members)`` of items ``(size, members)``, in order of
    size: each goes where it leaves the least space, or opens a container.

    Residuals are whole numbers up to the capacity, so the containers stand in
    one stack per residual and a bit set tells which stacks aren't empty.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled: list[list] = []
    fills: list[int] = []
    bits = 0
    for size, members in items:
        fitting = bits >> size
        if fitting:
            residual = size + ((fitting & -fitting).bit_length() - 1)
            b = stacks[residual].pop()
            if not stacks[residual]:
                bits &= ~(1 << residual)
        else:
            residual, b = capacity, len(filled)
            filled.append([])
            fills.append(0)
        filled[b].extend(members)
        fills[b] += size
        left = residual - size
        if left:
            stacks[left].append(b)
            bits |= 1 << left
    return list(zip(fills, filled))


def _pack_block(batches: list[pa.RecordBatch], arrow: pa.Schema, name: str, capacity: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).combine_chunks()
    fills, members = table.column("fill").to_numpy(), table.column("members").combine_chunks().cast(arrow.field("members").type)
    first = members.values.take(members.offsets[:-1])
    keys = np.array([xxhash.xxh3_64_intdigest(str(k)) for k in first.field("k").to_pylist()], np.uint64)
    # A fixed order makes a repeated task give the same containers.
    order = np.lexsort((first.field("part").to_numpy(), keys, -fills))
    packed = best_fit(((fill, [i]) for fill, i in zip(fills[order].tolist(), order.tolist())), capacity)
    for at in range(0, len(packed), 5000):
        part = packed[at : at + 5000]
        taken = members.take(pa.array([i for _, items in part for i in items]))
        ends = taken.offsets.to_numpy()[np.cumsum([0, *(len(items) for _, items in part)])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{name}-{at + i}" for i in range(len(part))]),
                pa.array([f for f, _ in part], pa.int32()),
                pa.array([f < capacity * NEARLY_FULL for f, _ in part]),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken.flatten(), type=arrow.field("members").type),
            ],
            schema=arrow,
        )


def _level(bins: DataFrame, schema: str, level: int, capacity: int, together: int) -> DataFrame:
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        items = members = 0
        for batch in (b.slice(at, together) for b in batches for at in range(0, b.num_rows, together)):
            size = len(batch.column("members").flatten())
            if held and (items + batch.num_rows > together or members + size > MEMBERS):
                yield from _pack_block(held, arrow, f"{level}-{split}-{block}", capacity)
                held, block, items, members = [], block + 1, 0, 0
            held.append(batch)
            items, members = items + batch.num_rows, members + size
        if held:
            yield from _pack_block(held, arrow, f"{level}-{split}-{block}", capacity)

    return bins.select("fill", "members").mapInArrow(run, schema)


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, together: int = TOGETHER) -> DataFrame:
    """``(container, key, part, start_at, n_tokens)``: where every unit of every item lies.

    An item larger than ``capacity`` is cut: its full parts fill containers of
    their own and only the rest (``part`` counts from 0, ``start_at`` is the
    first unit of the part) is packed like an item. Items with a null, zero or
    negative size take no space and have one row with a null container. Keys
    may be null or repeated: each row is an item of its own.
    """
    kind = sizes.schema[key].dataType.simpleString()
    schema = _BINS.format(kind)
    items = sizes.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    items = cut_lineage(items)
    pieces = items.where("n > 0").select("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {capacity}"))).alias("part"), "n")
    pieces = pieces.select("k", F.col("part").cast("int").alias("part"), (F.col("part") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("int").alias("n"))
    level0 = pieces.select(F.col("n").alias("fill"), F.array(F.struct("k", "part", "start", "n")).alias("members"))
    done, level, partitions = [], 0, max(1, -(-level0.count() // together))
    # Items are spread by hash: sizes that lie together in the input would be packed with their like.
    spread_out = level0.repartition(partitions, F.xxhash64("members"))
    bins, before = cut_lineage(_level(spread_out, schema, level, capacity, together)), None
    while True:
        containers, left, blocks = bins.agg(F.count("*"), F.coalesce(F.count_if(F.col("open")), F.lit(0)), F.count_distinct(F.regexp_extract("container", r"^(\d+-\d+-\d+)-", 1))).first()
        least = -(-left // together)
        if blocks <= 1 or left <= 1 or (before is not None and partitions <= least and before - containers <= before * LEAST_GAIN):
            done.append(bins)
            break
        done.append(bins.where("not open"))
        level, before, partitions = level + 1, left, max(least, -(-partitions // FAN_IN))
        # Hashed anew at every level, so that other containers meet.
        mixed = bins.where("open").repartition(partitions, F.xxhash64(F.lit(level), "container"))
        bins = cut_lineage(_level(mixed, schema, level, capacity, together))
    closed = done[0]
    for more in done[1:]:
        closed = closed.unionByName(more)
    placed = closed.select("container", F.explode("members").alias("m")).select("container", F.col("m.k").alias(key), "m.part", F.col("m.start").alias("start_at"), F.col("m.n").alias("n_tokens"))
    empty = items.where("n = 0").select(F.lit(None).cast("string").alias("container"), F.col("k").alias(key), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("start_at"), F.lit(0).alias("n_tokens"))
    return placed.unionByName(empty)
