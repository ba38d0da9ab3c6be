import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.functions.multivalue import ValueSplitter, country_spellings
from millrace.operators.splitting import split_values

SPLIT = ValueSplitter(["Garimgate and Elmside", "Skuezell/Wehr", "Eckoford & Holt", "Canada and Mexico", "Plain"], country_spellings(["US", "CA", "IN"]))


@pytest.mark.parametrize(
    ("text", "values"),
    [
        (None, []),
        ("", []),
        (" ,; | ", []),
        ("Aville", ["Aville"]),
        ("A, , B,", ["A", "B"]),
        ("A;B|C / D • E\nF & G", ["A", "B", "C", "D", "E", "F", "G"]),
        ("A and B or C", ["A", "B", "C"]),
        ("Brandon or Sandor", ["Brandon", "Sandor"]),
        ("A, A", ["A", "A"]),
        ("Aville, US", ["Aville, US"]),
        ("Aville, us, Bville (IN)", ["Aville, us", "Bville (IN)"]),
        ("Aville, United States / B", ["Aville, United States", "B"]),
        ("Aville, US, CA", ["Aville, US", "CA"]),
        ("Remote, CANADA AND MEXICO", ["Remote", "CANADA AND MEXICO"]),
        ("GARIMGATE AND ELMSIDE and skuezell/wehr", ["GARIMGATE AND ELMSIDE", "skuezell/wehr"]),
        ("Eckoford & Holt & B", ["Eckoford & Holt", "B"]),
        ('"A, B"; C', ["A, B", "C"]),
        ('"A ""x"" B", C', ['A "x" B', "C"]),
        ("“A; B”, 'C, US'", ["A; B", "C, US"]),
        ('A "x, y', ['A "x', "y"]),
        ('"A', ['"A']),
        ("O'Neil, B", ["O'Neil", "B"]),
        ("A (x, y), B", ["A (x, y)", "B"]),
        ("A (x, B", ["A (x", "B"]),
        ("A\\, B, C", ["A\\, B", "C"]),
        ("A (hybrid), US; B", ["A (hybrid), US", "B"]),
    ],
)
def test_values(text, values):
    assert SPLIT(text) == values


@given(st.text(alphabet="ab ,;'\"“”()\\/&\n", max_size=40))
def test_any_text_splits_without_losing_letters(text):
    values = SPLIT(text)
    assert all(v.strip() == v and v for v in values)
    letters = lambda s: [c for c in s if c in "ab"]
    assert letters("".join(values)) == letters(text)


def test_operator(spark, rows):
    ref = spark.createDataFrame([(1, "Aville and Bside", "US", ["AB"]), (2, "World", None, None)], "place_id bigint, place_name string, country_code string, alt_names array<string>")
    data = [("1", "Aville and Bside, C", 9), ("2", None, 9), ("3", " ", 9), ("4", "one", 9), (None, "x; y", 9), ("6", "x,y", 9), ("6", "x,y", 9), ("7", "a," * 20_000, 9)]
    df = spark.createDataFrame(data, "id string, location string, piece int")
    out = rows(split_values(df, "id", "location", ref))
    assert [r for r in out if r[0] != "7"] == sorted([("1", 1, "Aville and Bside"), ("1", 2, "C"), (None, 1, "x"), (None, 2, "y"), *[("6", 1, "x"), ("6", 2, "y")] * 2], key=repr)
    assert sum(r[0] == "7" for r in out) == 20_000
    assert rows(split_values(df.limit(0), "id", "location", ref)) == []
    assert ("6", 2, "y") in rows(split_values(df, "id", "location", ref.limit(0)))
