"""What tells classes apart may stand anywhere in the training texts."""

import random
import zlib

from readlake.llm import language_id, toxicity


def filler(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_language_that_shows_late(spark):
    """The first kilobytes of all training texts are alike; the rest tells."""
    rng = random.Random(1)
    head = filler(rng, 200)
    own = {"xx": ["tion", "ing", "the"], "yy": ["keit", "ung", "sch"]}
    late = lambda lang: " ".join("".join(rng.choice(own[lang]) for _ in range(3)) for _ in range(300))
    rows = [(i, head + " " + late(lang), lang) for i, lang in enumerate(["xx", "yy"] * 60)]
    rows += [(1000 + i, late(lang), None) for i, lang in enumerate(["xx", "yy"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert all(got[1000 + i] == lang for i, lang in enumerate(["xx", "yy"] * 10))


def test_toxic_words_that_come_late(spark):
    """Ten thousand characters go before the words that make a text toxic."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        rows.append((i, filler(rng, 1500) + (" vileword nastyterm " if toxic else " plain ending ")))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marks)
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((got[i] >= 0.5) == (i % 8 == 0) for i in held)


def test_prior_is_the_share_of_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    for n, want in ((0, toxicity.EDGE), (100, 1 - toxicity.EDGE)):
        marks = spark.createDataFrame([(i, 1, int(i < n)) for i in range(100)], "doc_id long, quality int, toxic int")
        assert toxicity.learn(docs, marks).prior == want
    some = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    marks = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(100)], "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs, marks).prior == sum(i % 2 for i in some) / len(some)
