import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.lookalikes import ARMENIAN, CHEROKEE, CYRILLIC, GREEK, ambiguous_tokens, canonical_texts, folded, look_alike_classes, look_alike_pairs, repaired

BACK = {v: k for k, v in CYRILLIC.items()}


def canonical(text):
    f = folded(text)
    script, _ = ambiguous_tokens(f)
    return repaired(f, script, set())


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("alone", "аlоnе"), ("toolkit", "tοolkit"), ("ｃｌｏｓｅ．", "close."), ("find flow", "ﬁnd ﬂow"), ("hands-on", "hands‑on"), ("a b", "a b"), ("a b", "a b"), ("word", "wo​rd﻿"),
        ("soft", "so­ft"), ("é", "é"), ("Kelvin", "Kelvin"), ("Ｎｏ １２", "No 12"), ("line\nbreak", "line\r\nbreak"), ("ёлка ждёт", "ëлка ждëт"), ("Мы и он", "Mы и oн"), ("熟悉Go的同事", "熟悉Gо的同事"), ("a I", "а І"), ("soon", "s\u0585\u0585n"), ("gone", "\u0581\u0585\u0578e"), ("GRAB", "\u13c0\u13a1A\u13f4"), ("Մարդ", "Մարդ"),
    ],
)
def test_look_the_same(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("e", "é"), ("a b", "a  b"), ("1", "l"), ("a.", "a,"), ("a\nb", "a b"), ("x²", "x2"), ("o", "0"), ("a-b", "a–b"), ("…", "..."), ("👨‍👩", "👨👩"), ("и", "й"), ("мир", "mup")])
def test_look_different(a, b):
    assert canonical(a) != canonical(b)


def test_scripts_are_kept():
    assert canonical("Мы предлагаем гибкий график и ноутбук") == "Мы предлагаем гибкий график и ноутбук"
    assert canonical("Nobodу hеre, а word") == "Nobody here, a word"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefgpoxyAKOTMгдежпийсоа .é", max_size=30), st.integers(0, 2**30 - 1))
def test_substitutions_never_matter(text, mask):
    other = "".join(BACK.get(c, c) if mask >> i & 1 else c for i, c in enumerate(text))
    assert canonical(text) == canonical(other) == canonical(unicodedata.normalize("NFD", other))
    assert canonical(canonical(text)) == canonical(text)


def test_tables_are_one_to_one():
    tables = (CYRILLIC, GREEK, ARMENIAN, CHEROKEE)
    assert all(len(k) == len(v) == 1 and v.isascii() for t in tables for k, v in t.items())
    assert sum(map(len, tables)) == len({k for t in tables for k in t})


def test_operators(spark, rows):
    data = [(1, "close the door", 1), (2, "ｃｌｏｓｅ the dооr", 1), (3, "close the door", 1), (4, "close the Door", 1), (5, None, 1), (6, "", 1), (7, " ​", 1), (8, "  ", 1), (9, "и со мной", 1), (10, "и co мнoй", 1), (None, "close the dοor", 1), (11, "ы" + " word" * 9000, 1), (12, "ы" + " wоrd" * 9000, 1), (1, "close the door", 1)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, canonical int")
    forms = dict(rows(canonical_texts(df, "doc_id", "text")))
    assert forms[1] == forms[2] == forms[None] and forms[5] is None and forms[6] == "" and forms[9] == forms[10] == "и со мной"
    assert canonical_texts(df, "doc_id", "text").count() == len(data)
    assert rows(look_alike_pairs(df, "doc_id", "text")) == sorted([(1, 2), (2, 3), (9, 10), (11, 12)], key=repr)
    assert rows(look_alike_pairs(df.limit(0), "doc_id", "text")) == []
    classes = {k: (c, n) for k, c, n in rows(look_alike_classes(df, "doc_id", "text"))}
    assert classes == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0), 8: (8, 0), 9: (9, 1), 10: (9, 1), 11: (11, 1), 12: (11, 1)}
    assert rows(look_alike_classes(df.limit(0), "doc_id", "text")) == []
