"""Personal data in free text, found by a skip-chain CRF and replaced.

Wide grammars propose mentions (``pii_grammar``), and the model decides which of
them are personal data and of what kind. Its nodes are a text's mentions in
order; neighbours share transition potentials, and mentions with a word or a
number in common share a skip potential, however far apart, so that evidence for
one carries over to the others. It is trained on texts labelled by hand
(``pii_examples``), which are the same for every table; what a table adds are
frequent words of its names and of its texts, as observations.
"""

from __future__ import annotations

from functools import lru_cache

import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.crf import Model, Sequence, decode, train
from millrace.llm.pii_examples import EXAMPLES, GIVEN, KINDS_BY_LETTER
from millrace.llm.pii_grammar import CUES, KINDS, NOT_NAMES, PARTICLES, THINGS, Candidate, Grammar, plain, words_of
from millrace.operators.arrowmap import arrow_map
from millrace.session import spread

LABELS = ["O", *KINDS]
#: Texts decoded at once.
TOGETHER = 500
#: Shares of names and of texts in which a word occurs to count as frequent, and
#: texts at least. There are at most (words each) / share of such words.
FREQUENT, COMMON, COMMON_LEAST = 0.002, 0.002, 5
# The placeholder of each kind.
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

_PIECES = regex.compile(r"[\p{L}][\p{L}'’]*(?:[\-‐‑][\p{L}'’]+)*\.?|,")
_JOB, _THING, _PARTICLE = (regex.compile(rf"(?:{x})", regex.I) for x in (NOT_NAMES, THINGS, PARTICLES))


# Words before a mention that tell people from firms and places.
_LEADS = frozenset("at of from by with in for to and near the".split())
#: What a cue for a name ends with.
_BEFORE_NAMES = frozenset(" :-–\n")
_LAST_WORD = regex.compile(r"\p{L}+$")


def _class_of(word: str, given: frozenset[str], common: frozenset[str]) -> str:
    """What kind of word a piece of a name is, in one letter."""
    lower = word.lower().rstrip(".")
    if lower in given:
        return "g"
    if word == ",":
        return ","
    if len(lower) == 1:
        return "i"
    if _PARTICLE.fullmatch(word):
        return "p"
    if _JOB.fullmatch(lower):
        return "j"
    if _THING.fullmatch(lower):
        return "t"
    if lower in common:
        return "c"
    return "x" if word[0].islower() else "u"


def _around(text: str, start: int, end: int) -> list[str]:
    """Observations of what stands before and after."""
    i, j = start - 1, end
    while i >= 0 and text[i] == " ":
        i -= 1
    while j < len(text) and text[j] == " ":
        j += 1
    shown = lambda c: "9" if c.isdigit() else "w" if c.isalpha() else c
    before = "^" if i < 0 or text[i] == "\n" else shown(text[i])
    after = "$" if j >= len(text) or text[j] == "\n" else shown(text[j])
    gap = "wide" if j - end > 1 else ""
    if before == "w" and (word := _LAST_WORD.search(text, max(0, i - 12), i + 1)) and word.group() in _LEADS:
        before = word.group()
    return ["<" + before, ">" + after + gap, "<>" + before + after]


def observe(text: str, mentions: list[list[Candidate]], given: frozenset[str], common: frozenset[str]) -> Sequence:
    """The observed sequence of a text's mentions."""
    known: dict[str, str] = {}

    def class_of(word: str) -> str:
        if word not in known:
            known[word] = _class_of(word, given, common)
        return known[word]

    features, may, keys = [], [], []
    previous: Candidate | None = None
    for mention in mentions:
        start, end = mention[0].start, max(c.end for c in mention)
        around = _around(text, start, end)
        fs = ["b", *(f"{c.kind}:{c.form}" for c in mention), *around]
        if previous and start - previous.end <= 14 and "\n" not in text[previous.end : start]:
            fs.append(f"{previous.kind}~{mention[0].kind}")
        previous = mention[-1]
        own: set[str] = set()
        first = mention[0]
        if first.kind == "person_name":
            before = text[max(0, start - 40) : start]
            cue = "name" if first.form == "cued" or (before[-1:] in _BEFORE_NAMES and CUES["name"].search(before)) else ""
            classes = "".join(class_of(w) for w in _PIECES.findall(text[start:end]))
            capital = "A" if text[start:end].isupper() else "a"
            kinds = "".join(sorted(set(classes)))
            fs += ["W" + classes + capital, "k" + kinds, f"{first.form}+{cue}", f"k{kinds}+{cue}", f"k{kinds}{around[0]}", f"k{kinds}{around[1]}", *("h" + c for c in set(classes))]
            if text.find("\n", 0, start) < 0:
                fs.append("head" + around[0])
            # A firm named after a person is linked with itself alone.
            own = {"t" + plain(text[start:end])} if {"t", "j"} & set(classes) else {"n" + w for w in words_of(text[start:end]) if len(w) > 2}
        elif first.kind in ("phone", "id_number"):
            before = text[max(0, start - 40) : start]
            cue = next((name for name in ("id", "phone", "not") if CUES[name].search(before)), "")
            forms = "/".join(c.form for c in mention)
            fs += ["c" + cue, f"{forms}+{cue}", f"both+{cue}" if len(mention) > 1 else f"{first.kind}+{cue}"]
            own = {"d" + "".join(c for c in text[start:end] if c.isdigit())}
        else:
            own = {first.kind[0] + text[start:end].lower()}
        features.append(fs)
        may.append([0, *(LABELS.index(c.kind) for c in mention)])
        keys.append(own)
    last: dict[str, int] = {}
    skips = []
    for i, own in enumerate(keys):
        # "Sandgren" goes with "Ulla Sandgren", but "Bo Sandgren" doesn't.
        skips += sorted({(last[k], i) for k in own if k in last and (own <= keys[last[k]] or keys[last[k]] <= own)})
        last |= dict.fromkeys(own, i)
    return Sequence(features, skips, may)


def read_example(marked: str) -> tuple[str, list[Candidate]]:
    """A labelled text without its marks, and the items that they mark."""
    text, items = "", []
    for part in regex.split(r"(\[[nepis]:(?:[^\[\]]|\[[^\[\]]*\])*\])", marked):
        if part[:1] == "[" and part[2:3] == ":" and part[1] in KINDS_BY_LETTER:
            items.append(Candidate(KINDS_BY_LETTER[part[1]], len(text), len(text) + len(part) - 4, ""))
            part = part[3:-1]
        text += part
    return text, items


def common_in(read: list[tuple[str, list[Candidate]]]) -> frozenset[str]:
    """The words of labelled texts outside their items, which stand for frequent
    ones; some are part of a name elsewhere."""
    return frozenset(m.group().lower() for text, items in read for m in regex.finditer(r"[\p{L}’']+", text) if not any(i.start <= m.start() < i.end for i in items))


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of the labelled texts. Each is seen with given names known and not."""
    read = [read_example(x) for x in EXAMPLES]
    common = common_in(read)
    sequences, answers = [], []
    for text, items in read:
        for given in (GIVEN, frozenset()):
            mentions = Grammar(given).mentions(text)
            seen = observe(text, mentions, given, common)
            answer = [next((LABELS.index(i.kind) for i in items for c in m if c.kind == i.kind and c.start < i.end and i.start < c.end), 0) for m in mentions]
            sequences.append(seen)
            answers.append(answer)
            # Mentions whose observations are hidden are known by their links alone.
            for hidden in ({i for i, _ in seen.skips}, {j for _, j in seen.skips}):
                if hidden:
                    sequences.append(Sequence([["hidden"] if i in hidden else fs for i, fs in enumerate(seen.features)], seen.skips, seen.may))
                    answers.append([a if i in hidden else -1 for i, a in enumerate(answer)])
    return train(sequences, answers, LABELS, epochs=60, l2=1e-4)


def find_spans(texts: list[str], grammar: Grammar, common: frozenset[str], model: Model) -> list[list[Candidate]]:
    """The mentions that the model takes for personal data, by text."""
    out = []
    for at in range(0, len(texts), TOGETHER):
        part = texts[at : at + TOGETHER]
        mentions = [grammar.mentions(t) for t in part]
        decoded = decode(model, [observe(t, m, grammar.given, common) for t, m in zip(part, mentions)])
        out += [[c for m, y in zip(ms, ys) for c in m if c.kind == LABELS[y]] for ms, ys in zip(mentions, decoded)]
    return out


def _frequent(df: DataFrame, text: str, least_share: float, least: int) -> frozenset[str]:
    words = df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}]+(?:['’\-][\p{L}]+)*)"), F.lit(1)))).alias("w"))
    n = df.where(F.col(text).rlike(r"\p{L}")).count()
    found = words.where(F.length("w") > 1).groupBy("w").count().where(F.col("count") >= max(least, least_share * n)).select("w")
    return frozenset(r[0] for r in found.collect())


def _prepared(df: DataFrame, text: str, name: str) -> Broadcast:
    """The words that matter and the model, for all executors. How many words
    there can be is bounded by the shares, not by the table."""
    given = frozenset(w for w in _frequent(df, name, FREQUENT, 1) if len(w) > 2) - {"van", "von", "del", "der", "den", "dos"}
    return df.sparkSession.sparkContext.broadcast((given, _frequent(df, text, COMMON, COMMON_LEAST) - given, trained()))


def find_personal_data(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """``(key, kind, start_at)``: one row per item of personal data in ``text``.

    ``start_at`` counts code points from 1. ``name`` is a column of people's
    names, of which only frequent words are used. Null, empty and blank texts
    give no row; null keys are kept; texts are read whole; repeated rows give
    repeated rows; other columns aren't read.
    """
    prepared = _prepared(df, text, name)

    def setup():
        given, common, model = prepared.value
        grammar = Grammar(given)

        def run(keys, texts):
            found = [(k, s.kind, s.start + 1) for k, spans in zip(keys, find_spans(texts, grammar, common, model)) for s in spans]
            return [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]

        return run

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, text).where(F.col(text).rlike(r"\S"))
    return arrow_map(spread(rows), setup, f"`{key}` {kind}, kind string, start_at bigint")


def redact_personal_data(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """``(key, text)``: every text with its personal data replaced by
    placeholders of its kind and the rest as it was; null stays null."""
    prepared = _prepared(df, text, name)

    def setup():
        given, common, model = prepared.value
        grammar = Grammar(given)

        def run(keys, texts):
            out = []
            for t, spans in zip(texts, find_spans([t or "" for t in texts], grammar, common, model)):
                for s in reversed(spans):
                    t = t[: s.start] + PLACEHOLDERS[s.kind] + t[s.end :]
                out.append(t)
            return keys, out

        return run

    kind = df.schema[key].dataType.simpleString()
    return arrow_map(spread(df.select(key, text)), setup, f"`{key}` {kind}, `{text}` string")
