"""Records that share most of their runs of words, across a whole table.

Deletion-variant signatures. A record's signature has ``segments * WIDTH``
symbols, each the smallest hash over its runs of three words. It is cut into
few segments, so that two records that differ in fewer than ``2 * segments``
symbols have a segment with at most one difference. Every segment is indexed
in ``WIDTH`` variants with one symbol left out; records that meet in a variant
are candidates. A candidate is dropped where bitmaps of the runs already differ in
more places than the threshold allows the runs to differ (which never drops a
similar pair), and each that is left is verified on its words.

The method speaks of signatures of bits. At a similarity of one half, bits of
similar and of unrelated records differ too little (a quarter against a half)
for short segments to tell them apart, so the symbols here are whole hashes,
which unrelated records hardly ever share.

Every run is drawn alike, boilerplate too, since the threshold counts it alike:
whether a pair is found depends on its similarity and not on which of its runs
are shared. Boilerplate brings unlike records together in some variants; there
are more such candidates than similar pairs in a large table, they grow as the
square of the records that share it, and only the bitmaps hold them back.
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.groups import group_of
from millrace.operators.arrowmap import arrow_map
from millrace.session import cut_lineage, release, room_for, spread

WIDTH = 5
LEAST_WORDS = 20
THRESHOLD = 0.5
#: Share of the pairs at the threshold itself that may be missed by the draws.
MISSED = 0.01
#: Signatures computed at once; words and texts remembered by a task.
CHUNK, REMEMBERED, REMEMBERED_TEXTS = 64, 1 << 18, 1 << 10
#: Bytes of an entry of the index in a shuffle.
ENTRY = 28
#: A record's sketch marks each of its runs in so many words of 64 bits.
SKETCH = 8

_ANY_WORDS, _ASCII_WORDS = re.compile(r"[^\W_]+").findall, re.compile(r"[a-z0-9]+").findall
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
_SHIFT = np.uint64(33)


def _words(text: str) -> list[str]:
    lower = text.lower()
    return _ASCII_WORDS(lower) if lower.isascii() else _ANY_WORDS(lower)


def words_of(title: str | None, body: str | None) -> list[str]:
    """Runs of letters and digits of both, in lower case."""
    return _words(f"{title or ''} {body or ''}")


def word_runs(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], words[2:]))


def similarity(a: set, b: set) -> float:
    """Shared runs over all distinct runs of either; 0 if there are none."""
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) if a or b else 0.0


def segments_for(threshold: float, missed: float = MISSED) -> int:
    """The least number of segments of which a pair at the threshold shares no
    variant with a chance of ``missed`` at most."""
    meets = WIDTH * threshold ** (WIDTH - 1) * (1 - threshold) + threshold**WIDTH
    return max(1, math.ceil(math.log(missed) / math.log1p(-meets))) if meets < 1 else 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _C
    x = (x ^ (x >> _SHIFT)) * _D
    return x ^ (x >> _SHIFT)


class _Hasher:
    """Hashes of the word runs of many records at once."""

    def __init__(self):
        self._known: dict[str, int] = {}

    def runs(self, records: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All run hashes, record after record, and where each record starts."""
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        flat: list[int] = []
        for words in records:
            hashes = list(map(known.get, words))
            if None in hashes:
                for w in words:
                    if w not in known:
                        known[w] = xxhash.xxh3_64_intdigest(w)
                hashes = [known[w] for w in words]
            flat += hashes
        h = np.array(flat, np.uint64)
        lengths = np.array([len(w) for w in records])
        runs = _mixed(h[:-2] * _A + _mixed(h[1:-1] * _B + h[2:]))
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        whole = np.ones(len(h), bool)
        whole[np.concatenate((starts + lengths - 1, starts + lengths - 2))] = False  # runs that cross into the next record
        return runs[whole[:-2]], starts - 2 * np.arange(len(records))


def _fingerprint(words: list[str]) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest("\n".join(words))
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _eligible(title: str | None, body: str | None) -> list[str] | None:
    own = _words(body) if body else ()
    return _words(title or "") + own if len(own) >= LEAST_WORDS else None


def _sketches(runs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many runs each record has, and the bits they set, as columns of words."""
    counts = np.diff(np.append(starts, len(runs)))
    bits = np.zeros((len(starts), 64 * SKETCH), bool)
    bits[np.repeat(np.arange(len(starts)), counts), (runs % np.uint64(64 * SKETCH)).astype(np.int64)] = True
    return counts, np.packbits(bits, axis=1).view(np.int64).T


def _survey_setup():
    """Each record's key, fingerprint, number of runs and sketch."""
    hasher = _Hasher()

    def run(keys, titles, bodies):
        found = [(k, w) for k, t, b in zip(keys, titles, bodies) if k is not None and (w := _eligible(t, b))]
        if not found:
            return [[] for _ in range(4 + SKETCH)]
        prints = [_fingerprint(w) for _, w in found]
        sizes, words = _sketches(*hasher.runs([w for _, w in found]))
        return [[k for k, _ in found], [p[0] for p in prints], [p[1] for p in prints], sizes, *words]

    return run


def _signature_setup(segments: int):
    """``(variant, f1)`` for every one-wildcard variant of every segment."""

    def setup():
        hasher = _Hasher()
        symbols = segments * WIDTH
        factors = np.array([xxhash.xxh32_intdigest(f"symbol {i}") | 1 for i in range(symbols)], np.uint32)
        seen: set[int] = set()

        def signatures(records):
            runs, starts = hasher.runs(records)
            mixed = (runs >> np.uint64(32)).astype(np.uint32)[:, None] * factors
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA6B)
            return np.minimum.reduceat(mixed, starts, axis=0).astype(np.uint64)

        def run(titles, bodies):
            out_keys, out_prints = [], []
            todo = []
            for t, b in zip(titles, bodies):
                w = _eligible(t, b)
                if w and (p := _fingerprint(w)[0]) not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()  # a copy may then be indexed again, which changes nothing
                    seen.add(p)
                    todo.append((p, w))
            for at in range(0, len(todo), CHUNK):
                part = todo[at : at + CHUNK]
                parts = signatures([w for _, w in part]).reshape(len(part), segments, WIDTH)
                prints = np.array([p for p, _ in part], np.int64)
                for left_out in range(WIDTH):
                    key = np.broadcast_to(np.arange(segments, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(left_out), parts.shape[:2])
                    for i in range(WIDTH):
                        if i != left_out:
                            key = _mixed(key * _A + parts[:, :, i])
                    out_keys.append(key.reshape(-1).view(np.int64))
                    out_prints.append(np.repeat(prints, segments))
            if not out_keys:
                return [], []
            return np.concatenate(out_keys), np.concatenate(out_prints)

        return run

    return setup


def _verify_setup(threshold: float):
    def setup():
        known: dict[tuple[int, int], set | None] = {}

        def runs(f1, f2, title, body):
            """None for the text of another record with the same key."""
            if (f1, f2) in known:
                return known[f1, f2]
            words = _eligible(title, body)
            if words is None or _fingerprint(words) != (f1, f2):
                return None
            if len(known) >= REMEMBERED_TEXTS:
                known.clear()
            known[f1, f2] = word_runs(words)
            return known[f1, f2]

        def run(*columns):
            kept = []
            for row in zip(*columns):
                a, b = runs(*row[:4]), runs(*row[4:])
                if a and b and similarity(a, b) >= threshold:
                    kept.append(row[:2] + row[4:6])
            return [list(c) for c in zip(*kept)] if kept else [[], [], [], []]

        return run

    return setup


def _met(records: DataFrame, segments: int, distinct: int) -> DataFrame:
    """``(f1, g1)``, f1 < g1: fingerprints that meet in a variant."""
    index = arrow_map(records.select("t", "b"), _signature_setup(segments), "variant bigint, p bigint")
    # Both sides rename, so that one exchange serves both.
    left, right = index.select("variant", F.col("p").alias("f1")), index.select("variant", F.col("p").alias("g1"))
    with room_for(records.sparkSession, distinct * segments * WIDTH * ENTRY):
        return cut_lineage(left.join(right, "variant").where("f1 < g1").select("f1", "g1").distinct())


def _can_be_similar(met: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """``met`` without the pairs whose sketches rule the threshold out.

    Sets of similarity t differ in at most (1 - t) / (1 + t) of the sum of their
    sizes, and their bitmaps in no more places than the sets.
    """
    words = [f"s{i}" for i in range(SKETCH)]
    other = sketches.select(F.col("f1").alias("g1"), F.col("runs").alias("more"), *[F.col(w).alias(f"z{w}") for w in words])
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"z{w}"))) for w in words), F.lit(0))
    allowed = (F.col("runs") + F.col("more")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)
    return met.join(sketches.hint("merge"), "f1").join(other.hint("merge"), "g1").where(differ <= allowed).select("f1", "g1").distinct()


def _with_kin(met: DataFrame) -> DataFrame:
    """``met`` and the pairs whose least partner is the same: edited versions come
    in families, and a pair that missed each other rarely misses the least of its
    family. A record has one least partner, so a family of m adds at most the
    m * m / 2 pairs that it has."""
    both = met.union(met.select("g1", "f1")).toDF("f", "g")
    least = both.groupBy("f").agg(F.min("g").alias("g")).select("f", F.least("f", "g").alias("hub"))
    a, b = least.select("hub", F.col("f").alias("f1")), least.select("hub", F.col("f").alias("g1"))
    return met.union(a.join(b, "hub").where("f1 < g1").select("f1", "g1")).distinct()


def near_duplicate_classes(df: DataFrame, key: str, title: str, body: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Classes of equal words, and which of them are similar.

    ``(k, f1, f2)``: the class of every record with a key and at least
    ``LEAST_WORDS`` words in its body, and ``(f1, f2, g1, g2)``, f1 < g1: the
    pairs of classes with similarity ``threshold`` or more.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    records = spread(df.select(F.col(key).alias("k"), F.col(title).alias("t"), F.col(body).alias("b")))
    sketch = ", ".join(f"s{i} bigint" for i in range(SKETCH))
    survey = cut_lineage(arrow_map(records, _survey_setup, f"k {kind}, f1 bigint, f2 bigint, runs bigint, {sketch}"))
    members = survey.select("k", "f1", "f2")
    # The number of distinct texts only sizes the shuffles.
    distinct = survey.agg(F.approx_count_distinct("f1")).first()[0]

    met = _met(records, segments_for(threshold), distinct)
    with room_for(spark, distinct * 1024):
        one_each = survey.drop("k", "f2").distinct()
        candidates = cut_lineage(_with_kin(cut_lineage(_can_be_similar(met, one_each, threshold))))
        release(met)
        # Texts move once, as one exchange serves both sides of a pair. Without the
        # hints, small tables would be joined in another way than large ones.
        reps = members.groupBy("f1", "f2").agg(F.min("k").alias("k")).hint("merge")
        keyed = candidates.join(reps.toDF("f1", "f2", "ka"), "f1").join(reps.toDF("g1", "g2", "kb"), "g1")
        texts = records.where("k is not null")
        ta, tb = texts.select(F.col("k").alias("ka"), F.col("t").alias("ta"), F.col("b").alias("ba")), texts.select(F.col("k").alias("kb"), F.col("t").alias("tb"), F.col("b").alias("bb"))
        paired = keyed.join(ta.hint("merge"), "ka").join(tb.hint("merge"), "kb").select("f1", "f2", "ta", "ba", "g1", "g2", "tb", "bb")
        similar = cut_lineage(arrow_map(paired, _verify_setup(threshold), "f1 bigint, f2 bigint, g1 bigint, g2 bigint").distinct())
    return members, similar


def near_duplicate_pairs(df: DataFrame, key: str, title: str, body: str, threshold: float = THRESHOLD, left: str = "id_a", right: str = "id_b") -> DataFrame:
    """``(left, right)``, left < right: records with similarity ``threshold`` or more.

    The similarity of two records is the share of their distinct runs of three
    consecutive words that both have; words are runs of letters and digits, in
    lower case, of title (null as empty), a space and body. Records with a null
    key or fewer than ``LEAST_WORDS`` words in the body have no partner. Exact
    copies are paired too; they are one class while candidates are sought.
    Repeated keys give no pair with themselves.
    """
    members, similar = near_duplicate_classes(df, key, title, body, threshold)
    ma, mb = members.toDF("ka", "f1", "f2"), members.toDF("kb", "g1", "g2")
    between = similar.join(ma, ["f1", "f2"]).join(mb, ["g1", "g2"]).select("ka", "kb")
    within = ma.join(members.toDF("kb", "f1", "f2"), ["f1", "f2"]).where("ka < kb").select("ka", "kb")
    return between.union(within).where("ka <> kb").select(F.least("ka", "kb").alias(left), F.greatest("ka", "kb").alias(right)).distinct()


def near_duplicate_groups(df: DataFrame, key: str, title: str, body: str, threshold: float = THRESHOLD) -> DataFrame:
    """``(key, group_id, links)``: one row a distinct key.

    Records linked by ``near_duplicate_pairs``, directly or through others, are a
    group, named by its least key; ``links`` is the number of records that a
    record is paired with. One without partner is its own group. Groups and links
    come from the classes of equal words and their sizes; copies are never
    expanded into pairs. A key that is repeated with other words has the links of
    each and the least of their groups. Null keys are left out.
    """
    members, similar = near_duplicate_classes(df, key, title, body, threshold)
    members = members.distinct()
    sizes = cut_lineage(members.groupBy("f1", "f2").agg(F.count("*").alias("n"), F.min("k").alias("least")))
    name = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    edges = similar.select(name("f1", "f2").alias("x"), name("g1", "g2").alias("y"))
    groups = group_of(edges, "x", "y").select(F.col("id.a").alias("f1"), F.col("id.b").alias("f2"), "group_id")
    both = similar.union(similar.select("g1", "g2", "f1", "f2"))
    linked = both.join(sizes.toDF("g1", "g2", "n", "least"), ["g1", "g2"]).groupBy("f1", "f2").agg(F.sum("n").alias("links"))
    of_class = sizes.join(groups, ["f1", "f2"], "left").withColumn("group_id", F.coalesce("group_id", name("f1", "f2")))
    least = of_class.groupBy("group_id").agg(F.min("least").alias("group"))
    of_class = of_class.join(least, "group_id").join(linked, ["f1", "f2"], "left").select("f1", "f2", "group", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    found = members.join(of_class, ["f1", "f2"]).groupBy("k").agg(F.min("group").alias("group"), F.sum("links").alias("links"))
    ids = df.select(F.col(key).alias("k")).where("k is not null").distinct()
    return ids.join(found, "k", "left").select(F.col("k").alias(key), F.coalesce("group", "k").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
