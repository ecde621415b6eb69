"""The scores of operators 6, 9 and 10, row by row, against plain Python that is given the same learned model."""

import math
import random
import re

import zstandard
from test_operators import labelled

from readlake.llm import language_id, quality_classifier, toxicity

MASK = (1 << 64) - 1


def compressed(text, raw, level=6):
    """Bytes of a text in pieces of 1,024, each compressed by a fresh dictionary."""
    pieces = [text[i : i + 1024] for i in range(0, len(text), 1024)] or [b""]
    options = {"write_content_size": False, "write_checksum": False}
    if len(raw) < 8:
        return sum(len(zstandard.ZstdCompressor(level=level, **options).compress(p)) for p in pieces)
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return sum(len(zstandard.ZstdCompressor(dict_data=d, write_dict_id=False, **options).compress(p)) for p in pieces)


def texts():
    rng = random.Random(3)
    words = ["the", "and", "über", "naïve", "vile", "nasty", "x1", "DOG", "42"]
    return [None, "", " ", "123 !", "Ünd", *(" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60, 900]))) for _ in range(25))]


def frame(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts())], "doc_id long, text string, score int")


def test_languages(spark):
    model = {"aa": b"the and the and dog " * 40, "bb": "über ünd naïve ".encode() * 40, "cc": b"x1 42 nasty vile " * 40}
    got = {r["doc_id"]: r for r in language_id.identify(frame(spark), model).collect()}
    for i, t in enumerate(texts()):
        if t is None or not re.search(r"[^\W\d_]", t):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
            continue
        sizes = sorted((compressed(t.lower().encode(), raw), k) for k, raw in model.items())
        margin = 1 - sizes[0][0] / sizes[1][0]
        assert got[i]["lang_pred"] == sizes[0][1] and abs(got[i]["score"] - margin / (margin + 0.01)) < 1e-9 and got[i]["rejected"] == (margin < 0.005)


def test_quality(spark):
    docs, labels, _ = labelled(spark)
    model = quality_classifier.learn(docs, labels)
    good, bad, plain = [*model.dictionaries, b""][:3]
    got = {r["doc_id"]: r["quality_score"] for r in quality_classifier.score(frame(spark), model).collect()}
    for i, t in enumerate(texts()):
        data = (t or "").encode()
        g, b, p = (compressed(data, raw) for raw in (good, bad, plain))
        x = [20 * (b - g) / (b + g), min(math.log(p / max(1, len(data))) - quality_classifier.ORDINARY_RATE, 0), 1]
        assert abs(got[i] - 1 / (1 + math.exp(-sum(w * v for w, v in zip(model.weights, x))))) < 1e-6


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def slots(text, bits):
    """Of each word, and of its first 5, 6 and 7 bytes where it is longer; letters and all beyond ASCII make words."""
    out = set()
    for word in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
        word = word.lower()  # bytes: A-Z only
        h = mixed(len(word) * 0x9E3779B97F4A7C15 + 1 & MASK)
        for k in range(0, min(len(word), 64), 8):
            h = mixed((h ^ int.from_bytes(word[k : k + 8], "little")) * 0x9E3779B97F4A7C15 & MASK)
        out.add(h >> 64 - bits)
        out |= {mixed(int.from_bytes(word[:k], "little") + k & MASK) >> 64 - bits for k in toxicity.STARTS if len(word) > k}
    return out


def test_toxicity(spark):
    docs, labels, _ = labelled(spark)
    model = toxicity.learn(docs, labels)
    more = docs.select("doc_id", "text").limit(40)
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(more, model).collect()}
    for r in more.collect():
        z = model.bias + sum(float(model.weights[s]) for s in slots(r["text"], model.bits))
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-6
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(frame(spark), model).collect()}
    for i, t in enumerate(texts()):
        z = model.bias + sum(float(model.weights[s]) for s in slots(t, model.bits))
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-6
