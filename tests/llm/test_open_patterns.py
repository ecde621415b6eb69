"""Personal data of any shape after patterns that identifiers follow as a rule."""

import random

import pytest
from pyspark.sql import functions as F

from readlake.llm import pii
from test_operators import prose, table


def found(spark, texts):
    rows = pii.find_private(table(spark, texts)).collect()
    return {r["doc_id"]: [texts[r["doc_id"]][x["start"] : x["end"]] for x in r["spans"] if x["kind"] == "id"] for r in rows}


RNG = random.Random(8)
HEXES = ["".join(RNG.choice("0123456789abcdef") for _ in range(40)) for _ in range(12)]
LEARNED = [f'{prose(i, 9)} token = "{x}" then key="{x[::-1]}" and the {x[:33]} {prose(i + 50, 9)} the word{i} the thing{i}' for i, x in enumerate(HEXES)]


@pytest.mark.parametrize("at_once", [262_144, 1])
def test_any_shape_after_open_patterns(spark, monkeypatch, at_once):
    monkeypatch.setattr(pii, "PATTERNS", at_once)
    more = ['a token = "letters" b', 'say token = x. Then', 'the key="Zoë-x/y"! end', "the letters the key the", "my token is letters", 'token = "a.b@c.de" z', "", None]
    got = found(spark, [*LEARNED, *more])
    assert [got[12 + i] for i in range(8)] == [["letters"], ["x"], ["Zoë-x/y"], [], [], [], [], []]
    assert all({x, x[::-1]} <= set(got[i]) for i, x in enumerate(HEXES))
    assert all(f"word{i}" not in got[i] for i in range(12) if i < 10)


def test_fillers_equal_plain_search():
    """Against every start in the text."""
    rng = random.Random(9)
    patterns = {"=", "id =", "id", "k=", "no ("}
    find = pii.Fillers(patterns)
    for _ in range(400):
        text = "".join(rng.choice(["id", " ", " ", "=", '"', "(", "k=", "abc", "7", "no", "\n", "é", "x@y.zz", "-"]) for _ in range(rng.randrange(25)))
        base = pii.base_spans(text)
        want = set()
        for i in range(len(text)):
            begins = i == 0 or text[i - 1].isspace() or text[i - 1] in pii._OPENING
            m = pii._FILLER.match(text, i)
            if begins and m and not any(a < m.end() and i < b for a, b, _ in base):
                want |= {(p, *m.span()) for p in pii._patterns(text, i) if p in patterns}
        assert set(find.of(text)) == want, text


def test_overlaps_of_nested_spans():
    apart = pii._apart([(0, 100, "email"), (5, 8, "ip"), (120, 130, "card")])
    assert [apart(50, 60), apart(100, 120), apart(110, 121), apart(130, 140)] == [False, True, False, True] and pii._apart([])(0, 5)


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(1, t, "x", 2) for t in LEARNED] + [(1, 'token = "abc"', "y", 3), (None, 'token = "abc"', None, 4), (None, None, None, 5), (1, 'token = "abc"', "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pattern string, text_hash int")
    got = pii.find_private(docs).where(F.size("spans") == 1).collect()
    assert [[tuple(x) for x in r["spans"]] for r in got] == [[(9, 12, "id")]] * 3 and len(got) == 3 and pii.find_private(docs).count() == len(rows)


def test_counts_stop_where_patterns_are_closed(spark):
    """The bounds change nothing, and what closed patterns have is not passed on."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    code = lambda: f"{word()}{rng.randrange(10**5):05}"
    texts = [f"id = {code()} no: {code() if k % 9 else word()} the {word() if k % 8 else code()} of ({code() if k % 3 else word()}) " + "the " + " the ".join(word() for _ in range(20)) for k in range(90)]
    docs = table(spark, texts)
    patterns = ["=", "id =", "no:", "the", "of", "never"]
    trusted = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    near = spark.createDataFrame([x for t in texts for x in pii.shaped(t, pii.base_spans(t))], "pattern string, i long")
    may = pii.may_open(trusted, near)
    assert "never" not in {r["pattern"] for r in may.collect()}
    want = {r["pattern"] for r in pii.open_patterns(docs, trusted).collect()}
    assert {r["pattern"] for r in pii.open_patterns(docs, may).collect()} == want == {"=", "id =", "no:"}
    most = {r["pattern"]: r["most"] for r in may.collect()}
    find = pii.Fillers(set(most))
    find.drop("the")
    assert all(p != "the" for t in texts for p, _, _ in find.of(t)) and "the" not in find.last and most["the"] < 90
