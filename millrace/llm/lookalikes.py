"""One form for texts that look the same on the screen.

Width, composition, ligatures, invisible characters and kinds of space and
hyphen are folded by tables. Letters of Latin, Cyrillic, Greek, Armenian and
Cherokee that are drawn alike are repaired token by token: the letters of a token that only one
script has tell its dominant script, and its look-alikes become letters of that
script. A token of look-alikes only takes the dominant script of its document,
if that spelling is in the corpus vocabulary, else its Latin spelling.

Everything a decision rests on (unambiguous letters, the spelling without
script, the vocabulary) is the same for texts that look the same, so they come
out equal.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.arrowmap import arrow_map
from millrace.session import cut_lineage, spread

# Letters drawn like a Latin one, by script.
CYRILLIC = dict(zip("асеорхуѕіјԁһԛԝАВСЕНІЈКМОРЅТХҮԚԜ", "aceopxysijdhqwABCEHIJKMOPSTXYQW"))
GREEK = dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oABEZHIKMNOPTYX"))
ARMENIAN = dict(zip("օոսհցզՕՍՏԼ", "onuhgqOUSL"))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏙᏚᏞᏟᏢᏦᏴᏒᏔᏕᏂᏧ", "DRTiAJEWMHYGZVSLCPKBRWShd"))
HYPHENS = "‐‑﹣－"
LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆĲĳ"
BREAKS = "\r\x85\u2028\u2029"
#: Invisible characters that change what is drawn next to them and stay.
OVERRIDES = "\u202d\u202e"

_BY_SCRIPT = {"C": CYRILLIC, "G": GREEK, "A": ARMENIAN, "K": CHEROKEE}
_TO_LATIN = str.maketrans(CYRILLIC | GREEK | ARMENIAN | CHEROKEE)
_INTO = {"L": {}} | {s: str.maketrans({latin: own for own, latin in reversed(letters.items())}) for s, letters in _BY_SCRIPT.items()}
_DRAWN_ALIKE = frozenset(_TO_LATIN.values())
_TOKEN = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{M}]+")
_FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}]")
_SCRIPTS = tuple((s, regex.compile(rf"\p{{{name}}}")) for s, name in (("L", "Latin"), ("C", "Cyrillic"), ("G", "Greek"), ("A", "Armenian"), ("K", "Cherokee")))
#: The same for a scan in the JVM: blocks that hold those scripts.
_FOREIGN_BLOCKS = "[\u0370-\u058f\u13a0-\u13ff\uab70-\uabbf]"
# A joiner stays between pictures, and after letters that it shapes.
_JOINERS = regex.compile(r"(?<![\p{Extended_Pictographic}\ufe0f\U0001F3FB-\U0001F3FF\u0600-\u08ff\u0900-෿])[\u200c\u200d]|[\u200c\u200d](?![\p{Extended_Pictographic}\u0600-\u08ff\u0900-෿])")
_INVISIBLE = regex.compile(rf"[\p{{Cf}}\ufe00-\ufe0f\u034f\u115f\u1160\u3164\uffa0--[\u200c\u200d{OVERRIDES}\u0600-\u0605\u06dd\u070f\u08e2\U000E0020-\U000E007F]]", regex.V1)


def _folds() -> dict[int, str]:
    table = {ord(c): "-" for c in HYPHENS} | {ord(c): "\n" for c in BREAKS}
    for code in (*range(0x80, 0x3400), *range(0xF900, 0x10000)):
        c = chr(code)
        kind = unicodedata.decomposition(c).split(" ", 1)[0]
        if code in table:
            continue
        if unicodedata.category(c) == "Zs":
            table[code] = " "
        elif kind in ("<wide>", "<narrow>") or c in LIGATURES:
            table[code] = unicodedata.normalize("NFKC", c)
    return table


_FOLDS = _folds()
_SIMPLE = regex.compile(r"[\x00-\x0c\x0e-\x7f]*+")


def folded(text: str) -> str:
    """``text`` without differences of width, composition, ligatures, invisible
    characters, kinds of space, hyphen and line break."""
    if _SIMPLE.fullmatch(text):
        return text
    text = _INVISIBLE.sub("", _JOINERS.sub("", text.replace("\r\n", "\n"))).translate(_FOLDS)
    return unicodedata.normalize("NFC", text)


def _letters(text: str) -> Counter:
    """How many letters of each script no other script has alike."""
    found: Counter = Counter()
    for c, n in Counter(unicodedata.normalize("NFD", text)).items():
        if c not in _DRAWN_ALIKE and ord(c) not in _TO_LATIN:
            for name, script in _SCRIPTS:
                if script.match(c):
                    found[name] += n
                    break
    return found


def dominant(letters: Counter) -> str | None:
    """The script with most letters of its own; Latin before the others on a tie."""
    return max("LCGAK", key=lambda s: (letters[s], -"LCGAK".index(s))) if letters.total() else None


def skeleton(token: str) -> str:
    """The token with every look-alike as its Latin letter."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", token).translate(_TO_LATIN))


def spelled(token: str, script: str) -> str:
    """The token with every look-alike as the letter of ``script``, where it has one."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", token).translate(_TO_LATIN).translate(_INTO[script]))


def ambiguous_tokens(text: str) -> tuple[str, set[str]]:
    """The script of a folded text, and the skeletons of its tokens that have
    only letters drawn alike (none in Latin texts, where nothing is open)."""
    script = dominant(_letters(text)) or "L"
    if script == "L":
        return script, set()
    return script, {skeleton(t) for t in set(_TOKEN.findall(text)) if not _letters(t).total()}


def repaired(text: str, script: str, latin: frozenset[str] | set[str]) -> str:
    """A folded text with its look-alikes repaired.

    ``script`` is the text's, ``latin`` the skeletons to be spelled in Latin
    although the text isn't.
    """
    if not _FOREIGN.search(text):
        return text
    forms: dict[str, str] = {}

    def repair(match: regex.Match) -> str:
        token = match.group()
        if token not in forms:
            own = dominant(_letters(token))
            forms[token] = spelled(token, own or ("L" if skeleton(token) in latin else script))
        return forms[token]

    return _TOKEN.sub(repair, text)


def _vocabulary_setup():
    def run(texts):
        counts: Counter = Counter()
        for t in texts:
            f = folded(t or "")
            if _FOREIGN.search(f):
                script, skeletons = ambiguous_tokens(f)
                if skeletons:
                    counts.update((script, sk) for token in set(_TOKEN.findall(f)) if (sk := skeleton(token)) in skeletons and token == spelled(token, script))
        return [s for s, _ in counts], [k for _, k in counts], list(counts.values())

    return run


def _fold_setup():
    def run(keys, texts):
        out = ([], [], [], [])
        for k, t in zip(keys, texts):
            f = None if t is None else folded(t)
            script, open_ = ("L", ()) if f is None or not _FOREIGN.search(f) else ambiguous_tokens(f)
            if f is not None and not open_:
                f = repaired(f, script, frozenset())
            for column, value in zip(out, (k, f, script, sorted(open_))):
                column.append(value)
        return out

    return run


def _repair_setup():
    def run(keys, texts, scripts, latins):
        return keys, [repaired(t, s, set(x or ())) for t, s, x in zip(texts, scripts, latins)]

    return run


def canonical_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, canonical)``: every text in one form, one row per row of ``df``.

    Null stays null and empty stays empty; null keys and repeated rows are
    kept; only the two columns are read, so others can't clash. Texts are read
    whole. Only texts that are mostly Cyrillic or Greek and hold tokens of
    look-alikes alone go through the join with the vocabulary; all others are
    finished in one pass without a shuffle.
    """
    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    kind = df.schema[key].dataType.simpleString()
    one = arrow_map(rows, _fold_setup, f"k {kind}, t string, script string, open array<string>")
    one = cut_lineage(one.withColumn("row", F.monotonically_increasing_id()))
    done = one.where("size(open) = 0 or t is null").select("k", "t")
    open_ = one.where("size(open) > 0 and t is not null")
    counts = arrow_map(rows.where(F.col("t").rlike(_FOREIGN_BLOCKS)).select("t"), _vocabulary_setup, "script string, sk string, n bigint")
    vocabulary = counts.groupBy("script", "sk").agg(F.sum("n").alias("n"))
    tokens = open_.select("row", "script", F.explode("open").alias("sk"))
    latin = tokens.join(vocabulary, ["script", "sk"], "left_anti").groupBy("row").agg(F.collect_list("sk").alias("latin"))
    repaired_ = arrow_map(open_.join(latin, "row", "left").select("k", "t", "script", "latin"), _repair_setup, f"k {kind}, t string")
    return done.unionByName(repaired_).select(F.col("k").alias(key), F.col("t").alias("canonical"))


def _members(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(k, r1, r2, c1, c2)``: fingerprints of the text and of its canonical form,
    of every row with a key and a visible character."""
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("raw")).where("k is not null and raw is not null")
    # The raw text's fingerprint travels through the operator beside the key.
    tagged = texts.select(F.struct("k", F.xxhash64("raw").alias("r1"), F.xxhash64(F.lit(11), "raw").alias("r2")).alias("id"), "raw")
    forms = canonical_texts(tagged, "id", "raw").where(F.regexp_replace("canonical", r"[\p{Z}\p{C}]", "") != "")
    return cut_lineage(forms.select("id.k", "id.r1", "id.r2", F.xxhash64("canonical").alias("c1"), F.xxhash64(F.lit(11), "canonical").alias("c2")).distinct())


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, class_id, links)``: one row a distinct key.

    Rows that look the same are a class, named by its least key, whether or not
    their texts are equal; ``links`` is how many rows look the same in other
    characters. Only sizes are counted, so a text with many copies costs no more
    than its rows. A key whose text is null or has no visible character is its
    own class; one repeated with other texts has the least class and the links
    of each. Null keys are left out.
    """
    members = _members(df, key, text)
    texts = members.groupBy("c1", "c2", "r1", "r2").agg(F.count("*").alias("n"), F.min("k").alias("least"))
    whole = texts.groupBy("c1", "c2").agg(F.sum("n").alias("all"), F.min("least").alias("class"))
    counted = texts.join(whole, ["c1", "c2"]).select("r1", "r2", "class", (F.col("all") - F.col("n")).alias("links"))
    found = members.select("k", "r1", "r2").join(counted, ["r1", "r2"]).groupBy("k").agg(F.min("class").alias("class"), F.sum("links").alias("links"))
    ids = df.select(F.col(key).alias("k")).where("k is not null").distinct()
    return ids.join(found, "k", "left").select(F.col("k").alias(key), F.coalesce("class", "k").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def look_alike_pairs(df: DataFrame, key: str, text: str, left: str = "doc_a", right: str = "doc_b") -> DataFrame:
    """``(left, right)``, left < right: rows whose texts differ but look the same.

    Texts without a visible character and rows with a null key have no
    partner; equal strings don't count. Equal texts are one class while
    partners are sought: classes of one canonical form are paired, and their
    members joined to the pairs, so a text with many copies costs no more than
    its pairs. A key that is repeated with other texts is paired by each.
    """
    members = _members(df, key, text)
    classes = members.select("c1", "c2", "r1", "r2").distinct()
    other = classes.select("c1", "c2", F.col("r1").alias("s1"), F.col("r2").alias("s2"))
    pairs = classes.join(other, ["c1", "c2"]).where("r1 < s1 or (r1 = s1 and r2 < s2)").drop("c1", "c2")
    a = members.select(F.col("k").alias("ka"), "r1", "r2")
    b = members.select(F.col("k").alias("kb"), F.col("r1").alias("s1"), F.col("r2").alias("s2"))
    joined = pairs.join(a, ["r1", "r2"]).join(b, ["s1", "s2"]).where("ka <> kb")
    return joined.select(F.least("ka", "kb").alias(left), F.greatest("ka", "kb").alias(right)).distinct()
