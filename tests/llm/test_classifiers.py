import collections
import itertools
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from cauce.llm import quality_classifier, toxicity
from cauce.llm.common import Words, crc_remainder
from tests.llm.conftest import AWKWARD, words


def test_forward_backward_equals_enumeration():
    """Marginals of short texts against the sum over all taggings."""
    rng = np.random.default_rng(2)
    texts = [b"a b c d", b"", b"e f", b"g " * 70 + b"h"]
    w = Words(texts)
    hashed, _, _ = toxicity.units(w)
    model = toxicity.Crf(rng.normal(size=toxicity.DIMENSIONS), 0.3, rng.normal(size=(2, 2)), rng.normal(size=2))
    p, xi, slot = model.marginals(hashed, *toxicity._ends(w), pairs=True)
    emission = model.bias + sum(np.where(hashed[i] > 0, model.weights[slot[i]], 0) for i in range(len(hashed)))
    at = 0
    for n in (4, 2):
        weight = {}
        for tags in itertools.product((0, 1), repeat=n):
            s = model.start[tags[0]] + sum(emission[at + k] * y for k, y in enumerate(tags)) + sum(model.transitions[a, b] for a, b in zip(tags, tags[1:]))
            weight[tags] = math.exp(s)
        total = sum(weight.values())
        for k in range(n):
            assert p[at + k] == pytest.approx(sum(v for t, v in weight.items() if t[k]) / total)
        at += n
    assert xi.sum() == pytest.approx(3 + 1 + 70)


@pytest.fixture(scope="module")
def toxic_corpus():
    rng = random.Random(6)
    rows = []
    for i in range(700):
        text = words(i, rng.randrange(5, 60), 3000)
        y = i % 7 == 0
        if y:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text) + 1), rng.choice(["Vilewort", "vilewort,", "grimstemor", "grimstemix", "grimstemul"]))
        rows.append((i, " ".join(text), int(y)))
    return rows


def test_toxic_documents_and_spans(spark, documents, toxic_corpus):
    docs = documents([(i, t) for i, t, _ in toxic_corpus] + [(1000, "é grimstemzz end"), (1001, None), (1002, "")])
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_corpus] + [(None, 1), (5, None)], "doc_id long, toxic int")
    held = crc_remainder("doc_id", 4) == 2
    model = toxicity.train(docs, labels, ~held)
    rows = {r["doc_id"]: r for r in toxicity.toxic_documents(docs, model).collect()}
    assert all(rows[i]["predicted"] == y for i, _, y in toxic_corpus)
    text = "é grimstemzz end"
    assert [text[s["start"]:s["end"]] for s in rows[1000]["spans"]] == ["grimstemzz"]
    assert rows[1001]["score"] == rows[1002]["score"] == 0 and rows[1002]["spans"] == []
    kept = toxicity.toxic_removed(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, r in rows.items() if not r["predicted"]}


def test_without_labels(spark, awkward, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    crf = toxicity.train(awkward, none, F.lit(True))
    assert {r["score"] for r in toxicity.toxic_documents(awkward, crf).collect()} == {0.0}
    ranked = quality_classifier.train(awkward, none, F.lit(True))
    assert [r["score"] for r in quality_classifier.classify(awkward, ranked).collect()] == [0.5] * len(AWKWARD)
    one = spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, toxic int, quality int")
    assert {r["score"] for r in toxicity.toxic_documents(awkward, toxicity.train(awkward, one, F.lit(True))).collect()} == {1.0}
    assert {r["predicted"] for r in quality_classifier.classify(awkward, quality_classifier.train(awkward, one, F.lit(True))).collect()} == {0}
    assert toxicity.toxic_documents(documents([]), crf).count() == quality_classifier.classify(documents([]), ranked).count() == 0


def test_pairwise_ranking(spark, documents, awkward):
    rng = random.Random(8)
    rows = []
    for i in range(500):
        text = words(i, rng.randrange(20, 80), 3000)
        y = int(i % 5 > 0)
        if not y:
            text = [w + "$$$" if rng.random() < 0.6 else w for w in text] if i % 2 else [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text), y))
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 1), (3, 0)], "doc_id long, quality int")
    held = crc_remainder("doc_id", 5) == 0
    model = quality_classifier.train(docs, labels, ~held)
    found = {r["doc_id"]: r for r in quality_classifier.classify(docs, model).collect()}
    assert sum(found[i]["predicted"] == y for i, _, y in rows) >= 490
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.3) == (r["predicted"] == 1) for r in found.values())
    assert quality_classifier.classify(awkward, model).count() == len(AWKWARD)
    kept = quality_classifier.rejected_removed(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, r in found.items() if r["predicted"]}


def test_preferences_order_strengths():
    """Two features, the second decisive: every preferred row is stronger."""
    rng = np.random.default_rng(0)
    x = np.zeros((200, quality_classifier.N_FEATURES), np.float32)
    x[:, 1], x[:, 2] = rng.random(200), np.arange(200) % 2
    y = (np.arange(200) % 2).astype(int)
    s = x @ quality_classifier.fit(x, y).weights
    assert s[y == 1].min() > s[y == 0].max()


def test_no_telling_word(spark, documents, monkeypatch):
    """Two toxic and six clean texts without a common word: the score is the share of all labelled rows, and none is filtered."""
    monkeypatch.setattr(toxicity, "MAX_TAGGED", 2)
    docs = documents([(i, " ".join(words(i, 12, 10**6))) for i in range(8)])
    labels = spark.createDataFrame([(i, int(i < 2)) for i in range(8)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    assert model.constant == 0.25
    assert toxicity.toxic_removed(docs, model).count() == 8


def plain_features(text):
    """The features in plain Python, shape buckets left out (they are hashes)."""
    split = lambda s: [w for w in s.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    w = split(text)
    out = [0.0] * (quality_classifier.N_FEATURES - quality_classifier.SHAPES)
    if not w:
        return [1.0, *out[1:]], {}
    letters = [c for c in text if c.isalpha()]
    capitals = sum(unicodedata.category(c) == "Lu" for c in letters) / max(1, len(letters))
    chars, n, lines = sum(map(len, w)), len(w), [x for x in text.split("\n") if split(x)]
    again = sum(a == b for a, b in zip(w, w[1:])) / n
    out[1:12] = [math.log1p(n) / 10, capitals, math.sqrt(capitals), again, math.sqrt(again), max(map(w.count, set(w))) / n if n > 20 else 0, len(set(w)) / n,
                 chars / n / 20, 1 - len(set(lines)) / len(lines), min(5, math.log1p(n / len(lines))) / 5, len(letters) / chars]
    for k, c in enumerate(quality_classifier._SYMBOLS):
        out[12 + k] = math.sqrt(text.count(c) / n)
    of = lambda c: "A" if unicodedata.category(c) == "Lu" else "a" if c.isalpha() else "0" if c.isdecimal() else c
    return out, collections.Counter("".join(k for k, _ in itertools.groupby(map(of, x))) for x in w)


def test_quality_features_equal_plain_python():
    rng = random.Random(8)
    alphabet = "aAbéÉñ1٣.,!#\\  \n\t\x0b\x1c\x85 Ⅷªǅ漢🙂"
    texts = ["", " \n ", "x", *(t or "" for _, t in AWKWARD if len(t or "") < 2000), *("".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(200))]
    got = quality_classifier.features([t.encode() for t in texts])
    bucket = {}
    for text, x in zip(texts, got):
        want, shapes = plain_features(text)
        assert x[:len(want)] == pytest.approx(want, abs=1e-6), text
        n = sum(shapes.values())
        assert float((x[-quality_classifier.SHAPES:] ** 2).sum()) == pytest.approx(1.0 if n else 0.0, abs=1e-5)
        if len(shapes) == 1:  # one shape, one bucket, the same in every text
            assert bucket.setdefault(next(iter(shapes)), int(x[-quality_classifier.SHAPES:].argmax())) == int(x[-quality_classifier.SHAPES:].argmax())
    whole, parts = quality_classifier.features([t.encode() for t in texts]), [quality_classifier.features([t.encode()])[0] for t in texts]
    assert np.array_equal(whole, np.array(parts))
    assert quality_classifier.features([]).shape == (0, quality_classifier.N_FEATURES)


def test_pairwise_fit_lowers_the_logistic_loss_of_all_pairs():
    rng = np.random.default_rng(4)
    x = np.zeros((40, quality_classifier.N_FEATURES), np.float32)
    x[:, :5] = rng.normal(size=(40, 5))
    y = (x[:, 0] + 0.5 * rng.normal(size=40) > 0).astype(int)
    w = quality_classifier.fit(x, y, l2=0.0).weights
    loss = lambda v: np.mean([math.log1p(math.exp(-float((x[g] - x[b]) @ v))) for g in np.flatnonzero(y == 1) for b in np.flatnonzero(y == 0)])
    least = loss(w)
    assert least < 0.6 * loss(np.zeros_like(w))
    for k in range(5):  # no step along a feature does better
        for step in (-0.3, 0.3):
            other = w.copy()
            other[k] += step
            assert least <= loss(other) + 1e-3


def test_quality_of_awkward_rows(spark, awkward, documents):
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 1), (5, 1), (8, 1), (9, 0), (10, 1), (10, 0)], "doc_id long, quality int")
    model = quality_classifier.train(awkward, labels, F.lit(True))
    rows = quality_classifier.classify(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    ones = [r["score"] for r, (_, t) in zip(rows, AWKWARD) if t == "one"]
    assert len(set(ones)) == 1
    kept = quality_classifier.rejected_removed(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert quality_classifier.rejected_removed(documents([]), model).count() == 0
