import hashlib
import itertools
import random

from millrace.llm.groups import grouped_records
from millrace.llm.neardup import WIDTH, near_duplicate_classes, near_duplicate_groups, near_duplicate_pairs, segments_for, similarity, word_runs, words_of

SCHEMA = "id string, title string, job_desc string, id_a int"


def brute(data, threshold=0.5):
    runs = {}
    for k, t, b in data:
        if k is not None and b and len(words_of(None, b)) >= 20:
            runs.setdefault(k, []).append(word_runs(words_of(t, b)))
    return {(min(a, b), max(a, b)) for a, b in itertools.combinations(runs, 2) if any(similarity(x, y) >= threshold for x in runs[a] for y in runs[b])}


def corpus(seed, families=60, size=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    boilerplate = "we offer a transparent pay band and a quiet rota for every parent in the team".split()
    data = []
    for f in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for v in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 1, 3, len(base) // 10, len(base) // 6])):
                i = rng.randrange(len(text))
                text[i : i + rng.randint(0, 1)] = [rng.choice(words)]
            data.append((f"{f:03}-{v}", f"Title {f}" if v else None, ". ".join([" ".join(text).upper() if v == 2 else " ".join(text), " ".join(boilerplate)])))
    return data


def test_against_all_pairs(spark, rows):
    data = corpus(1)
    df = spark.createDataFrame([(*r, 0) for r in data], SCHEMA).repartition(5)
    got, want = set(rows(near_duplicate_pairs(df, "id", "title", "job_desc"))), brute(data)
    assert got <= want and len(want) > 150
    # The signatures are random draws: near the threshold itself a pair can be missed.
    assert not (want - got) & brute(data, 0.75)
    assert len(want - got) <= 0.02 * len(want)


def test_a_family_of_a_third_of_all_rows(spark, rows):
    """Its runs are common, so its members must meet through their kin."""
    rng = random.Random(9)
    base = [f"base{i}" for i in range(60)]
    data = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randint(1, 4)):
            text[rng.randrange(60)] = f"edit{i}x{rng.randrange(99)}"
        data.append((f"f{i:03}", "T", " ".join(text)))
    data += [(f"o{i:03}", "T", " ".join(f"other{rng.randrange(4000)}" for _ in range(60))) for i in range(300)]
    got, want = set(rows(near_duplicate_pairs(spark.createDataFrame([(*r, 0) for r in data], SCHEMA), "id", "title", "job_desc"))), brute(data)
    assert got <= want and len(want) > 8000
    assert not (want - got) & brute(data, 0.6)
    assert len(want - got) <= 0.002 * len(want)


def test_edges(spark, rows):
    twenty = " ".join(f"word{i}" for i in range(20))
    long_text = " ".join(f"token{i % 5000}x{i}" for i in range(30_000))
    data = [
        ("a", "T", twenty), ("b", "T", twenty), ("c", "t", twenty.upper().replace(" ", "  ")), ("d", None, twenty), ("short", "T", " ".join(twenty.split()[:19])), ("null", "T", None), ("empty", "T", ""), (None, "T", twenty),
        ("a", "T", twenty), ("long", "", long_text), ("long2", "", long_text + " end"), ("far", "T", " ".join(f"other{i}" for i in range(40))), ("same words", "word0", " ".join(["word0"] * 25)), ("same words 2", "word0", " ".join(["word0"] * 30)),
    ]
    df = spark.createDataFrame([(*r, 0) for r in data], SCHEMA)
    got = rows(near_duplicate_pairs(df, "id", "title", "job_desc"))
    assert got == sorted([("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d"), ("c", "d"), ("long", "long2"), ("same words", "same words 2")], key=repr)
    assert rows(near_duplicate_pairs(df.limit(0), "id", "title", "job_desc")) == []


def test_many_copies_are_one_class(spark, rows):
    base = " ".join(f"word{i}" for i in range(30))
    data = [(f"{i:03}", "T", base) for i in range(60)] + [("x", "T", base + " more words here")]
    got = rows(near_duplicate_pairs(spark.createDataFrame([(*r, 0) for r in data], SCHEMA).repartition(3), "id", "title", "job_desc"))
    assert len(got) == 60 * 59 // 2 + 60


def test_words():
    assert words_of("A-b", "c_d É2 x") == ["a", "b", "c", "d", "é2", "x"]
    assert similarity(set(), set()) == 0


def test_pairs_that_share_mainly_boilerplate(spark, rows):
    """Half of each short posting stands in many long, otherwise unlike ones, so
    no third record meets both of a pair."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(200_000)}"
    boilerplate = [" ".join(f"b{n}x{i}" for i in range(60)) for n in range(25)]
    data = [(f"long{i:04}", "T", " ".join([*rng.sample(boilerplate, 6), *(word() for _ in range(600))])) for i in range(1000)]
    data += [(f"short{n:02}-{v}", None, " ".join([b, *(word() for _ in range(17))])) for n, b in enumerate(boilerplate) for v in "ab"]
    got = rows(near_duplicate_pairs(spark.createDataFrame([(*r, 0) for r in data], SCHEMA), "id", "title", "job_desc"))
    assert got == [(f"short{n:02}-a", f"short{n:02}-b") for n in range(25)]


def test_segments_follow_the_recall_target(spark, rows):
    def missed(segments, t):
        return (1 - WIDTH * t ** (WIDTH - 1) * (1 - t) - t**WIDTH) ** segments

    for t in (0.3, 0.5, 0.8, 0.95):
        assert missed(segments_for(t), t) <= 0.01 and (segments_for(t) == 1 or missed(segments_for(t) - 1, t) > 0.01)
    assert segments_for(0.5) == 23 and segments_for(1.0) == 1


def test_pairs_without_kin_at_the_threshold(spark, rows):
    """Pairs of a similarity of 0.50 to 0.51; 13 segments miss about 6 % of them."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    data = []
    for n in range(1000):
        base = [word() for _ in range(70)]
        data += [(f"{n:04}-{v}", None, " ".join([*base, *(word() for _ in range(33))])) for v in "ab"]
    want = {(f"{n:04}-a", f"{n:04}-b") for n in range(1000)}
    got = set(rows(near_duplicate_pairs(spark.createDataFrame([(*r, 0) for r in data], SCHEMA), "id", "title", "job_desc")))
    assert got <= want and len(want - got) <= 20


def test_a_family_in_a_large_share_of_the_table(spark, rows):
    """A fifth of the records share 92 words and have 41 of their own: similarity 0.52."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(92)]
    data = [(f"f{i:03}", None, " ".join([*base, *(word() for _ in range(41))])) for i in range(200)]
    data += [(f"o{i:03}", None, " ".join(word() for _ in range(100))) for i in range(800)]
    got = near_duplicate_pairs(spark.createDataFrame([(*r, 0) for r in data], SCHEMA).repartition(4), "id", "title", "job_desc")
    assert got.count() == 200 * 199 // 2


def test_groups_are_those_of_the_pairs(spark, rows):
    data = corpus(3, families=25, size=4)
    data += [(f"copy{i}", *data[5][1:]) for i in range(12)] + [(None, "T", "x"), ("short", None, "few words"), ("short", None, "few words")]
    df = spark.createDataFrame([(*r, 0) for r in data], SCHEMA).repartition(5)
    want = grouped_records(df, "id", near_duplicate_pairs(df, "id", "title", "job_desc"), "id_a", "id_b")
    assert rows(near_duplicate_groups(df, "id", "title", "job_desc")) == rows(want)
    assert rows(near_duplicate_groups(df.limit(0), "id", "title", "job_desc")) == []


def test_a_hot_class_is_split(spark):
    """A third of all rows are copies: adaptive execution splits their join, as
    nothing is repartitioned before it."""
    small = {"adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB", "adaptive.skewJoin.skewedPartitionFactor": "1.2", "adaptive.advisoryPartitionSizeInBytes": "4KB", "autoBroadcastJoinThreshold": "-1", "files.maxPartitionBytes": "16KB", "files.openCostInBytes": "0"}
    before = {name: spark.conf.get(f"spark.sql.{name}") for name in small}
    try:
        for name, value in small.items():
            spark.conf.set(f"spark.sql.{name}", value)
        base = " ".join(f"word{i}" for i in range(30))
        data = [(hashlib.sha256(str(i).encode()).hexdigest(), "T", base if i % 3 == 0 else f"{base} {' '.join(f'x{i}y{j}' for j in range(90))}") for i in range(600)]
        members, _ = near_duplicate_classes(spark.createDataFrame([(*r, 0) for r in data], SCHEMA).repartition(6), "id", "title", "job_desc")
        joined = members.toDF("ka", "f1", "f2").join(members.toDF("kb", "f1", "f2"), ["f1", "f2"]).where("ka < kb").select("ka")
        assert len(joined.collect()) == 200 * 199 // 2
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(f"spark.sql.{name}", value)
