import random

import numpy as np
import pytest
from pii_held_out import HELD_OUT

from millrace.llm.crf import Model, Sequence, decode, train
from millrace.llm.pii import LABELS, common_in, find_personal_data, find_spans, observe, read_example, redact_personal_data, trained
from millrace.llm.pii_examples import EXAMPLES
from millrace.llm.pii_grammar import Grammar

GIVEN = ["Petra", "Tomas", "Élodie", "Bram", "Yuki", "Oskar"]
SURNAMES = ["Morundvar", "Brandiquist", "O'Verewell", "de Södolnova", "Lintefield-Zandumund", "Kelistein"]


def resume(rng):
    name = f"{rng.choice(GIVEN)} {rng.choice(['', '', 'B. ', 'K. '])}{rng.choice(SURNAMES)}"
    head = rng.choice([name, f"Name: {name}", f"CV of {name}."])
    mail = rng.choice(["p.mor@mail.example", "tom_b [at] uni [dot] example", "élan2@post.example.org"])
    phone = rng.choice(["+1 212 555 0164", "(617) 555 0132 ext. 50", "030/23125-003", "01.99.00.63.37"])
    number = rng.choice(["SSN 925-01-0504", "passport number XQ3845601", "DNI: 00002788Y", "Aadhaar no: 0506 2664 4776"])
    street = rng.choice(["171 Heron Close", "Mühlenstraße 50b, 45824 Lake Aville", "88 impasse du Puits", "Calle del Faro 70, 1º izq."])
    body = rng.choice(["Closed ticket 240-12-13 of the backlog.", "See invoice 41936 574 45.", "Worked on the 1225 Main Street Analytics account.", "Related: ISBN 0-150-6311-X.", "Also user@ prefixed nodes."])
    return f"{head}\nmail: {mail}\nTel. {phone}\n{number}\nHome: {street}\n\n{body} Led 37 engineers who measured a wizard. Reported to {rng.choice(["Dr. ", "Ms. ", "Prof. ", ""])}{rng.choice(GIVEN)} {rng.choice(SURNAMES)} from Emberpath Logistics."


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(1)
    data = [(str(i), f"{rng.choice(GIVEN)} {rng.choice(SURNAMES)}", resume(rng), i) for i in range(300)]
    special = [
        ("known", None, "Petra Morundvar | p.mor@mail.example, +44 (0)7700 900441; SSN: 933035649\nBased at 105 Beacon Hill Drive. Kind regards,\nPetra Morundvar", 0),
        ("decoys", None, "Closed ticket 240-12-13. See invoice 41936 574 45 and ISBN 0-150-6311-X, host 192.0.2.21, PO-2023-001539, v8.18.94, the 1225 Main Street Analytics account, @nomosia_dev on chat.", 0),
        ("initial", None, "CV of Y. Aldumoto. Reported to Ms. I. Södemoto of Mosaicbridge Collective.", 0),
        ("null", None, None, 0), ("empty", None, "", 0), ("blank", None, " \n ", 0), (None, None, "Bram Kelistein", 0), ("twice", None, "Bram Kelistein", 0), ("twice", None, "Bram Kelistein", 0),
        ("long", None, "Led 37 engineers who measured a wizard. " * 3000 + "Tomas Brandiquist", 0),
    ]
    return spark.createDataFrame(data + special, "id string, name string, resume string, start_at int")


def test_finds(people):
    found = {}
    for k, kind, at in find_personal_data(people, "id", "resume", "name").collect():
        found.setdefault(k, []).append((at, kind))
    text = {r["id"]: r["resume"] for r in people.collect()}
    at = lambda k, part, nth=0: [i + 1 for i in range(len(text[k])) if text[k].startswith(part, i)][nth]
    assert sorted(found["known"]) == sorted(
        [(1, "person_name"), (at("known", "p.mor"), "email"), (at("known", "+44"), "phone"), (at("known", "9330"), "id_number"), (at("known", "105"), "street_address"), (at("known", "Petra", 1), "person_name")]
    )
    assert "decoys" not in found and not {"null", "empty", "blank"} & set(found)
    assert sorted(found["initial"]) == [(at("initial", "Y."), "person_name"), (at("initial", "I. S"), "person_name")]
    assert found[None] == [(1, "person_name")] and found["twice"] == [(1, "person_name")] * 2
    assert found["long"] == [(at("long", "Tomas"), "person_name")]
    kinds = [kind for k in map(str, range(300)) for _, kind in found[k]]
    assert {k: kinds.count(k) for k in set(kinds)} == {"person_name": 600, "email": 300, "phone": 300, "id_number": 300, "street_address": 300}


def test_redacts(people):
    out = {r["id"]: r["resume"] for r in redact_personal_data(people, "id", "resume", "name").collect()}
    assert out["known"] == "[PERSON_NAME] | [EMAIL], [PHONE]; SSN: [ID_NUMBER]\nBased at [STREET_ADDRESS] Kind regards,\n[PERSON_NAME]"
    assert out["null"] is None and out["empty"] == "" and out["decoys"].startswith("Closed ticket 240-12-13.")


def test_empty_table(people):
    assert find_personal_data(people.limit(0), "id", "resume", "name").count() == 0
    assert redact_personal_data(people.limit(0), "id", "resume", "name").count() == 0


def test_propagation_agrees_with_enumeration():
    """On a chain of five with one skip edge, loopy beliefs and exact ones decode alike."""
    rng = np.random.default_rng(0)
    labels = ["O", "B-x", "I-x"]
    model = train([Sequence([["a"], ["b"], ["a"]], [(0, 2)])] * 40, [[1, 2, 1]] * 40, labels, epochs=2)
    agreed = 0
    for _ in range(60):
        model.weights[:] = rng.normal(0, 1.5, model.weights.shape)
        s = Sequence([[rng.choice(["a", "b"])] for _ in range(5)], [(0, 3)])
        unary = model.weights[model.encode(s.features, 1)].sum(1)
        scores = np.zeros((3,) * 5)
        for y in np.ndindex(*scores.shape):
            scores[y] = sum(unary[i, v] for i, v in enumerate(y)) + sum(model.transitions[a, b] for a, b in zip(y, y[1:])) + model.skip[y[0], y[3]] + (-27.6 if y[0] == 2 else 0)
        p = np.exp(scores - scores.max())
        exact = [p.sum(axis=tuple(j for j in range(5) if j != i)).argmax() for i in range(5)]
        agreed += list(decode(model, [s])[0]) == exact
    assert agreed >= 57


def test_skip_edges_carry_evidence():
    """An unclear occurrence takes the label of a clear one far away."""
    clear, unclear = ["w=x", "cue"], ["w=x"]
    filler = [["f"]] * 6
    train_set = [Sequence([clear, *filler, unclear], [(0, 7)])] * 30 + [Sequence([unclear, *filler], [])] * 40
    answers = [[1, *[0] * 6, 1]] * 30 + [[0, *[0] * 6]] * 40
    model = train(train_set, answers, ["O", "B-x", "I-x"], epochs=30)
    linked, alone = decode(model, [train_set[0], Sequence([unclear, *filler], [])])
    assert list(linked) == answers[0] and list(alone) == answers[-1]


def test_nothing_to_learn_from():
    model = train([], [], LABELS)
    assert len(model.index) == 0 and decode(model, [Sequence([], [])])[0].size == 0
    assert list(decode(model, [Sequence([["b"]], [], [[0, 2]])])[0]) in ([0], [2])


def test_a_node_is_only_what_it_may_be():
    model = train([Sequence([["a"]], [], [[0, 3]])] * 20, [[3]] * 20, LABELS, epochs=5)
    assert [int(decode(model, [Sequence([["a"]], [], [may])])[0][0]) for may in ([0, 3], [0], [0, 1, 2])] != [3, 3, 3]
    assert int(decode(model, [Sequence([["a"]], [], [[0, 3]])])[0][0]) == 3 and int(decode(model, [Sequence([["a"]], [], [[0]])])[0][0]) == 0


KNOWN = common_in([read_example(x) for x in EXAMPLES])


def found_in(text, links=True, given=frozenset()):
    """The mentions that hold in a text, with or without the skip edges."""
    mentions = Grammar(given).mentions(text)
    seen = observe(text, mentions, given, KNOWN | {"rose"})
    labels = decode(trained(), [seen if links else Sequence(seen.features, [], seen.may)])[0]
    return [text[c.start : c.end] for m, y in zip(mentions, labels) for c in m if c.kind == LABELS[y]]


@pytest.mark.parametrize(
    "text",
    [
        "Name: Rose Marlind\n\nHe ran 4 teams. Praise came from partners of Rose Marlind in winter, and Rose Marlind went on.",
        "Dr. Rose Marlind led 9 teams. Presented the index to 12 partners of Rose Marlind; certified in Rose Marlind.",
    ],
)
def test_one_clear_mention_decides_the_others(text):
    assert found_in(text) == ["Rose Marlind"] * 3
    assert len(found_in(text, links=False)) < 3


def test_a_word_of_a_name_in_a_firm_is_not_linked():
    assert found_in("Name: Ulla Sandgren\n\nBuilt the index at Sandgren Works, and Sandgren ran it.") == ["Ulla Sandgren", "Sandgren"]


def test_names_that_no_list_has_are_found_by_what_stands_around():
    assert found_in("My name is Qorvin Thalgast. Reported to Dr. Zelm Okvist-Tarn from Amber Labs.") == ["Qorvin Thalgast", "Zelm Okvist-Tarn"]


def test_held_out_texts():
    """No given name is known to the model here."""
    right = found = true = 0
    for marked in HELD_OUT:
        text, items = read_example(marked)
        got, want = ({(c.kind, c.start) for c in cs} for cs in (find_spans([text], Grammar(), KNOWN, trained())[0], items))
        right, found, true = right + len(got & want), found + len(got), true + len(want)
    assert right / found >= 0.85 and right / true >= 0.95


def _by_hand(*labels):
    """A model in which "cue" asks for a name, "mention" slightly for none, and equal words agree."""
    n = len(labels)
    inside = [label.startswith("I-") for label in labels]
    first = [label == "B-person_name" for label in labels]
    weights = np.zeros((4, n), np.float32)
    weights[0, first], weights[1, 0], weights[2, 0] = 6, 0.2, 6
    weights[:, inside] = -20
    weights[:3, [not f and label != "O" for f, label in zip(first, labels)]] = -20
    return Model(list(labels), {"cue": 0, "mention": 1, "other": 2}, weights, np.zeros((n, n), np.float32), np.where(np.eye(n, dtype=bool), 3, -3).astype(np.float32))


def test_evidence_reaches_every_occurrence():
    features = [["other"] if i % 2 else ["mention"] for i in range(25)]
    features[0] = ["cue"]
    skips = [(i, i + 2) for i in range(0, 23, 2)]
    got, alone = decode(_by_hand("O", "B-person_name"), [Sequence(features, skips), Sequence(features, [])])
    assert list(got) == [1, 0] * 12 + [1] and list(alone) == [1] + [0] * 24
