"""Nearest vectors by cosine, for many queries at once: exact, or by an index.

Both searches read the vectors once, whatever the number of queries.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from millrace.session import cut_lineage

#: Queries and vectors scored in one step.
BLOCK, STEP = 1024, 2048
#: Scores are compared by so many digits; what may come between them and those of a product.
DIGITS, SLACK = 9, 2e-9
#: Numbers of vectors that a task holds at a time, about (32 MB).
NUMBERS = 1 << 22
#: Numbers in the query matrix up to which it goes to every executor (128 MB);
#: above that, queries and vectors meet in blocks of ``MEET`` rows a side.
MOST_BROADCAST, MEET = 1 << 24, 1 << 15
#: Vectors on which an index is fitted, at most, and its lists.
SAMPLE, MOST_LISTS = 50_000, 1024


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1, norms)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


class _Best:
    """The ``k`` best vectors of each query so far, in the order of ``_ranked``.

    Equal vectors have equal scores, so they are scored once, and of each only the
    ``k`` least ids can count.
    """

    def __init__(self, names: np.ndarray, unit: np.ndarray, k: int):
        self.names, self.unit, self.k = names, unit, k
        self.scores, self.ids = np.full((len(names), k), -np.inf), np.empty((len(names), k), object)

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        first, own, starts = _classes(ids, rows, self.k)
        for at in range(0, len(first), STEP):
            vectors = rows[first[at : at + STEP]]
            for q in range(0, len(self.names), BLOCK):
                s, floor = self.unit[q : q + BLOCK] @ vectors.T, self.scores[q : q + BLOCK, -1:]
                near = s >= floor - SLACK
                if (many := near.sum(1) > self.k).any():
                    near[many] &= s[many] >= np.partition(s[many], -self.k, axis=1)[:, -self.k, None] - SLACK
                row, c = np.nonzero(near)
                if len(row):
                    self._take(row + q, c + at, vectors, at, ids[own], starts)

    def _take(self, row: np.ndarray, c: np.ndarray, vectors: np.ndarray, at: int, ids: np.ndarray, starts: np.ndarray) -> None:
        # A product of matrices may differ in its last digits with the shape; these sums don't.
        some = max(1, NUMBERS // max(1, vectors.shape[1]))
        s = np.concatenate([(self.unit[row[i : i + some]] * vectors[c[i : i + some] - at]).sum(1) for i in range(0, len(row), some)])
        order = np.lexsort((c, -_rounded(s), row))
        row, c, s = row[order], c[order], s[order]
        # Classes are in the order of their least ids: after k of them none counts.
        kept = _place(row) < self.k
        row, c, s = row[kept], c[kept], s[kept]
        sizes = starts[c + 1] - starts[c]
        before = np.cumsum(sizes) - sizes
        tie = np.r_[True, (row[1:] != row[:-1]) | (_rounded(s[1:]) != _rounded(s[:-1]))]
        new = np.r_[True, row[1:] != row[:-1]]
        # Nor does a class with k ids of better score.
        kept = before[np.maximum.accumulate(np.where(tie, np.arange(len(row)), 0))] - before[np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))] < self.k
        row, c, s, sizes = row[kept], c[kept], s[kept], sizes[kept]
        member = np.repeat(starts[c] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        row, s, ids = np.repeat(row, sizes), np.repeat(s, sizes), ids[member]
        touched = np.unique(row)
        old, held = self.scores[touched], self.scores[touched] > -np.inf
        row, s, ids = np.r_[np.repeat(touched, held.sum(1)), row], np.r_[old[held], s], np.r_[self.ids[touched][held], ids]
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -_rounded(s), row))
        row, s, ids = row[order], s[order], ids[order]
        place = _place(row)
        kept = place < self.k
        self.scores[touched], self.ids[touched] = -np.inf, None
        self.scores[row[kept], place[kept]], self.ids[row[kept], place[kept]] = s[kept], ids[kept]

    def batches(self, arrow: pa.Schema):
        for at in range(0, len(self.names), BLOCK):
            s, i = self.scores[at : at + BLOCK], self.ids[at : at + BLOCK]
            held = s > -np.inf
            if held.any():
                names = np.repeat(self.names[at : at + BLOCK], held.sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), arrow.field(0).type), pa.array(i[held].tolist(), arrow.field(1).type), pa.array(s[held])], schema=arrow)


def _rounded(scores: np.ndarray) -> np.ndarray:
    return np.round(scores, DIGITS)


def _place(row: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its row; rows are in order."""
    new = np.r_[True, row[1:] != row[:-1]]
    at = np.arange(len(row))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _classes(ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal vectors in the order of their least ids: a row of each;
    the rows of their ``k`` least ids, class by class; where each class starts there."""
    order = np.argsort(ids, kind="stable")
    keys = np.ascontiguousarray(rows[order]).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    _, first, own = np.unique(keys, return_index=True, return_inverse=True)
    first, own = np.sort(first), np.argsort(np.argsort(first))[own.ravel()]
    at = np.argsort(own, kind="stable")
    at = at[_place(own[at]) < k]
    return order[first], order[at], np.r_[0, np.cumsum(np.bincount(own[at], minlength=len(first)))]


def _names(column) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _meet_all(best: _Best, batches) -> None:
    """Batches of ``(id, embedding)`` meet the queries, about ``NUMBERS`` numbers at a time."""
    held, numbers = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((_names(batch.column(0)), _matrix(batch.column(1))))
            numbers += held[-1][1].size
        if numbers >= NUMBERS:
            best.meet(*(np.concatenate(x) for x in zip(*held)))
            held, numbers = [], 0
    if held:
        best.meet(*(np.concatenate(x) for x in zip(*held)))


def _usable(df: DataFrame) -> DataFrame:
    return df.where("id is not null and embedding is not null").select("id", "embedding")


def _schema(queries: DataFrame, vectors: DataFrame) -> str:
    return f"query_id {queries.schema['id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def top_similar(queries: DataFrame, vectors: DataFrame, k: int = 30, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` vectors most similar to each query.

    Both inputs are ``(id, embedding)``. Cosine with 0 for zero vectors; scores
    that are equal to nine digits are in the order of ids. Null ids and vectors
    are left out; vectors must have one width.
    """
    found, members = shared_similar(queries, vectors, k, most_broadcast)
    return found if members is None else members.join(found.withColumnRenamed("query_id", "like"), "like").select("query_id", "id", "score", "rank")


def shared_similar(queries: DataFrame, vectors: DataFrame, k: int = 30, most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame | None]:
    """``top_similar`` of one query for each vector that queries have, and
    ``(query_id, like)``: whose result is each query's. None: each has its own.

    Top k is decomposable: every task keeps the ``k`` best of its vectors by
    matrix products, and only those are moved and ranked. Queries of up to
    ``most_broadcast`` numbers go to every executor, and the vectors are read
    once. More of them meet the vectors in blocks, each pair of blocks in a task.
    """
    spark = queries.sparkSession
    qs, vs, schema = _usable(queries), _usable(vectors), _schema(queries, vectors)
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    classes = qs.groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("of"))
    total, n, numbers = classes.agg(F.coalesce(F.sum("of"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], f"{schema}, rank bigint"), None
    members = None
    # An id with several vectors has one result from all of them.
    if n < total and qs.agg(F.count_distinct("id")).first()[0] == total:
        classes = cut_lineage(classes.select("id", "embedding"))
        members = cut_lineage(qs.select(F.col("id").alias("query_id"), "embedding").join(classes.withColumnRenamed("id", "like"), "embedding").select("query_id", "like"))
        qs = classes
    elif n < total:
        n, numbers = qs.agg(F.count("*"), F.sum(F.size("embedding"))).first()
    if numbers <= most_broadcast:
        held = qs.toArrow()
        shared = spark.sparkContext.broadcast((_names(held.column("id")), _matrix(held.column("embedding"))))

        def score(batches):
            best = _Best(*shared.value, k)
            _meet_all(best, batches)
            yield from best.batches(arrow)

        return _ranked(vs.mapInArrow(score, schema), k), members
    q_blocks, v_blocks = -(-n // MEET), max(1, -(-vs.count() // MEET))
    left = qs.withColumn("q", _bucket(q_blocks)).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
    # Under other names, as Spark prunes columns that both sides have from one table.
    right = vs.withColumn("v", _bucket(v_blocks)).withColumnsRenamed({"id": "v_id", "embedding": "v_embedding"}).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    return _ranked(left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(_meeting(arrow, k, "v_id", "v_embedding"), schema), k), members


def _meeting(arrow: pa.Schema, k: int, id_: str = "id", embedding: str = "embedding"):
    """Queries of a block and the vectors of another."""

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return arrow.empty_table()
        best = _Best(_names(a.column("id")), _matrix(a.column("embedding")), k)
        _meet_all(best, b.select([id_, embedding]).to_batches())
        return pa.Table.from_batches(best.batches(arrow), schema=arrow)

    return meet


class VectorIndex(Protocol):
    """What a search needs of an index over ``(id, embedding)``."""

    def get(self, ids: DataFrame) -> DataFrame: ...

    def query(self, queries: DataFrame, k: int = 30) -> DataFrame: ...


class ExactIndex:
    """Every query against every vector."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors

    def get(self, ids: DataFrame) -> DataFrame:
        """The vectors of the column ``id``; ids without vector drop out."""
        return self.vectors.join(ids.select("id").distinct(), "id", "left_semi")

    def query(self, queries: DataFrame, k: int = 30) -> DataFrame:
        return top_similar(queries, self.vectors, k)


def _centres(rows: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(lists, len(rows)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(np.bincount(own, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
    return centres


class ListIndex(ExactIndex):
    """An inverted file: every vector is in the list of its nearest centre, and a
    query looks into its ``probes`` nearest lists.

    The centres are fitted on at most ``sample`` vectors, chosen by hash; all
    vectors are indexed. A list is cut into parts of about ``MEET`` vectors, so
    a list that holds a third of all is many tasks. ``recall`` tells how much
    of the exact result comes out.
    """

    def __init__(self, vectors: DataFrame, probes: int = 8, lists: int | None = None, sample: int = SAMPLE):
        super().__init__(vectors)
        vs = _usable(vectors)
        n = vs.count()
        rows = vs.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow() if n else None
        wanted = lists or min(MOST_LISTS, max(1, int(n**0.5)))
        self._centres = vectors.sparkSession.sparkContext.broadcast(_centres(_matrix(rows.column(0)), wanted) if n else np.zeros((0, 0)))
        self.probes = probes
        listed = cut_lineage(self._listed(vs, 1))
        sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / MEET).cast("int").alias("parts"))
        self._sizes = cut_lineage(sizes)
        self._indexed = listed.join(F.broadcast(self._sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    def _listed(self, df: DataFrame, most: int) -> DataFrame:
        schema = f"id {df.schema['id'].dataType.simpleString()}, embedding array<float>, list int"
        arrow, centres = to_arrow_schema(_parse_datatype_string(schema)), self._centres

        def assign(batches):
            for batch in batches:
                if batch.num_rows and len(centres.value):
                    near = np.argsort(-(_matrix(batch.column("embedding")) @ centres.value.T), axis=1, kind="stable")[:, :most]
                    row = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("embedding").take(row).cast(arrow.field("embedding").type), pa.array(near.ravel().astype(np.int32))], schema=arrow)

        return df.select("id", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(assign, schema)

    def query(self, queries: DataFrame, k: int = 30) -> DataFrame:
        schema = _schema(queries, self.vectors)
        arrow = to_arrow_schema(_parse_datatype_string(schema))
        probing = self._listed(_usable(queries), self.probes).join(F.broadcast(self._sizes), "list")
        probing = probing.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        return _ranked(probing.groupBy("list", "part").cogroup(self._indexed.groupBy("list", "part")).applyInArrow(_meeting(arrow, k), schema), k)

    def recall(self, queries: DataFrame, k: int = 30) -> float:
        """The share of the exact result that the index finds."""
        exact, found = (x.select("query_id", "id") for x in (top_similar(queries, self.vectors, k), self.query(queries, k)))
        return exact.join(found, ["query_id", "id"], "left_semi").count() / max(1, exact.count())
