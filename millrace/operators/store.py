"""Mutations as set operations, and tables kept as versions of parts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.schemas import TABLES


def first_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key; rows with a null in the key all stay, as no
    key equals null."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    ranked = batch.where(whole).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return ranked.unionByName(batch.where(~whole))


def insert_if_absent(store: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows of ``batch`` to append: first of their key in the batch and not
    in the store. Applying it again appends nothing but rows with null keys."""
    return first_per_key(batch, keys, order).join(store.select(*keys).distinct(), list(keys), "left_anti").select(*batch.columns)


def known_keys(batch: DataFrame, store: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``batch`` with a column ``known``: whether the store has the key."""
    marks = store.select(*keys).distinct().withColumn("_k", F.lit(True))
    return batch.join(marks, list(keys), "left").select(*batch.columns, F.coalesce("_k", F.lit(False)).alias("known"))


def upsert_users(store: DataFrame, batch: DataFrame, written: Sequence[str] = ("name", "email", "resume", "job_expectations")) -> DataFrame:
    """The store after upserting a batch by telegram_id, one row a key in the batch.

    A user that exists keeps id and vectorize_id and takes all written columns
    from the batch, nulls too; others are appended as they are.
    """
    given = batch.select(F.col("telegram_id"), F.lit(True).alias("_g"), *[F.col(c).alias(f"_{c}") for c in written])
    updated = store.join(given, "telegram_id", "left").select(*[F.when(F.col("_g"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in written else F.col(c) for c in store.columns])
    new = batch.join(store.select("telegram_id").where("telegram_id is not null").distinct(), "telegram_id", "left_anti")
    return updated.unionByName(new.select(*store.columns))


def update_by_key(store: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The store with the other columns of ``updates`` set where the key matches."""
    written = [c for c in updates.columns if c != key]
    given = updates.select(F.col(key), F.lit(True).alias("_g"), *[F.col(c).alias(f"_{c}") for c in written])
    return store.join(given, key, "left").select(*[F.when(F.col("_g"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in written else F.col(c) for c in store.columns])


def update_where(store: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """The store with columns set in all rows that meet a condition."""
    return store.select(*[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in store.columns])


def insert_or_replace(store: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The store with rows of the batch's keys replaced; columns the batch lacks are null."""
    kept = store.join(batch.select(*keys).distinct(), list(keys), "left_anti").select(*store.columns)
    return kept.unionByName(batch, allowMissingColumns=True).select(*store.columns)


def upsert_vectors(store: DataFrame, batch: DataFrame, order: Sequence[Column], width: int | None = None) -> DataFrame:
    """The vectors after an upsert; of several with one id the last holds. A
    vector of another width is an error, not a fallback."""
    if width is not None:
        wrong = F.raise_error(F.concat(F.lit(f"expected width {width}, not "), F.size("embedding").cast("string")))
        batch = batch.withColumn("embedding", F.when(F.size("embedding") == width, F.col("embedding")).otherwise(wrong.cast("array<float>")))
    last = batch.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_n = 1").select(*store.columns)
    return insert_or_replace(store, last, ["id"])


def delete_by_key(store: DataFrame, keys_df: DataFrame, key: str) -> DataFrame:
    return store.join(keys_df.select(key).distinct(), key, "left_anti")


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


class SnapshotStore:
    """Tables as parts and numbered lists of the parts that hold.

    ``root/table/parts/<name>`` are Parquet folders; ``root/table/commits/N.json``
    names the parts of version N. Appending writes one part and a commit; a change
    rewrites only the parts that hold a changed key. A reader keeps the version it
    opened, as parts are never overwritten. All access goes through Hadoop's
    ``FileSystem``, so the root may be any storage Spark writes to. A commit is
    created under its number and never replaced: of two writers one gets
    ``CommitConflict``. An unreadable last commit (a writer that died) is skipped.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, table: str) -> list[int]:
        fs, folder = self._path(table, "commits")
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def _current(self, table: str) -> tuple[int, list[str]]:
        for n in self._numbers(table):
            fs, path = self._path(table, "commits", f"{n}.json")
            stream = fs.open(path)
            try:
                return n, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"]
            except ValueError:
                continue
            finally:
                stream.close()
        return 0, []

    def _commit(self, table: str, based_on: int, parts: list[str]) -> int:
        n = max([based_on, *self._numbers(table)[:1]]) + 1
        if n != based_on + 1 and self._current(table)[0] != based_on:
            raise CommitConflict(f"{table} is past version {based_on}")
        fs, path = self._path(table, "commits", f"{n}.json")
        try:
            stream = fs.create(path, False)
        except Exception as e:
            raise CommitConflict(f"version {n} of {table} exists") from e
        stream.write(json.dumps({"parts": parts}).encode())
        stream.close()
        return n

    def _write_part(self, table: str, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table]]).write.parquet(f"{self.root}/{table}/parts/{name}")
        return name

    def _read_parts(self, table: str, parts: Sequence[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/{table}/parts/{p}" for p in parts])

    def create(self) -> None:
        """Every table that doesn't exist yet, empty."""
        for table in TABLES:
            if not self.version(table):
                self._commit(table, 0, [])

    def version(self, table: str) -> int:
        return self._current(table)[0]

    def parts(self, table: str) -> list[str]:
        return self._current(table)[1]

    def read(self, table: str) -> DataFrame:
        """The current version; an empty table before the first write."""
        return self._read_parts(table, self.parts(table))

    def write(self, table: str, df: DataFrame) -> int:
        """A new version that holds ``df`` alone."""
        return self._commit(table, self.version(table), [self._write_part(table, df)])

    def append(self, table: str, df: DataFrame) -> int:
        """A new version with the rows of ``df`` more; no other row is written again."""
        version, parts = self._current(table)
        return self._commit(table, version, [*parts, self._write_part(table, df)])

    def rewrite(self, table: str, keys: DataFrame, on: Sequence[str], change: Callable[[DataFrame], DataFrame], more: DataFrame | None = None) -> int:
        """A new version in which the parts that hold a row of ``keys`` are
        replaced by what ``change`` makes of them, and ``more`` is appended."""
        version, parts = self._current(table)
        found = self._read_parts(table, parts).select(*on, F.regexp_extract("_metadata.file_path", r"/parts/([0-9a-f]{32})/", 1).alias("_part")) if parts else None
        # One row a part, however many rows change.
        hit = {r[0] for r in found.join(keys.select(*on).distinct(), list(on), "left_semi").select("_part").distinct().collect()} if parts else set()
        kept = [p for p in parts if p not in hit]
        new = [self._write_part(table, change(self._read_parts(table, sorted(hit))))] if hit else []
        if more is not None:
            new.append(self._write_part(table, more))
        return self._commit(table, version, kept + new) if new else version

    def update(self, table: str, updates: DataFrame, key: str) -> int:
        """``update_by_key`` on the parts that hold a key of ``updates``."""
        return self.rewrite(table, updates, [key], lambda part: update_by_key(part, updates, key))

    def replace(self, table: str, batch: DataFrame, keys: Sequence[str]) -> int:
        """``insert_or_replace`` on the parts that hold a key of ``batch``."""
        old = lambda part: part.join(batch.select(*keys).distinct(), list(keys), "left_anti").select(*part.columns)
        return self.rewrite(table, batch, keys, old, more=batch)

    def compact(self, table: str) -> int:
        """A new version with all rows in one part."""
        version, parts = self._current(table)
        return self._commit(table, version, [self._write_part(table, self._read_parts(table, parts))]) if len(parts) > 1 else version
