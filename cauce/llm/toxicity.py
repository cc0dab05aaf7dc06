"""Toxicity: a linear-chain conditional random field over words.

Words of labelled documents are tagged toxic when one of their lexical units
(the word, or its first 4 to 6 letters) is tied to toxic documents beyond
chance; a two-state linear-chain CRF with hashed word and affix features is
trained on these tags. Forward-backward marginals of every word of a whole
text give the offending spans, and the noisy-or of its likely words (the
largest marginal, if there is none) the document's score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce.llm import labelled
from cauce.llm.common import Words, mix64, slices

#: Bounds of the fit: labelled rows by class for the lexicon and for the CRF.
MAX_TOXIC, MAX_CLEAN = 2500, 15_000
MAX_TAGGED = 900
MAX_TAGGED_CHARS = 20_000
#: A unit is toxic if so many toxic and no other documents have it with a
#: probability below exp(-CHANCE).
CHANCE = 15.0
CUT = 0.3
SPAN_CUT = 0.5
#: Words below this marginal do not add up: a long clean text is no toxic one.
BACKGROUND = 0.1
DIMENSIONS = 1 << 18
_BLOCK = 64
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KINDS = 6


def units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (kinds x words) of the core (outer punctuation stripped), its
    first 3 to 6 letters and its last 3; 0 where it is shorter. Also the core's place."""
    start, end = words.start.copy(), words.end.copy()
    for step, side in ((1, start), (-1, end)):
        live = np.arange(len(start))
        while len(live):
            at = side[live] - (step < 0)
            live = live[(start[live] < end[live]) & ~_ALNUM[words.data[at]]]
            side[live] += step
    start, end = np.minimum(start, end), end
    continues = (words.data & 0xC0) == 0x80  # inside a UTF-8 sequence
    out = np.zeros((_KINDS, len(start)), np.uint64)
    out[0] = words.hashes(start, end)
    place = start.copy()
    for k in range(1, 7):
        place = np.minimum(place + 1, end)
        for _ in range(3):
            more = place < end
            more[more] = continues[place[more]]
            if not more.any():
                break
            place[more] += 1
        if k >= 3:
            out[k - 2] = np.where((end > place) | (place - start >= k), words.hashes(start, place), 0)
    tail = np.maximum(end - 3, start)
    out[5] = words.hashes(tail, end)
    for i in range(_KINDS):
        out[i] = np.where(end > start, mix64(out[i] + np.uint64(i + 1)), 0)
    return out, start, end


def _scan(m00, m01, m10, m11) -> tuple[np.ndarray, np.ndarray]:
    """Row vectors v_t = v_(t-1) M_t, scaled to sum 1, for one long chain of 2x2
    matrices: products of blocks in step, starts block by block, then all
    vectors in step. The first matrix must not depend on what comes before."""
    n = len(m00)
    blocks = -(-n // _BLOCK)
    pad = blocks * _BLOCK - n
    a, b, c, d = (np.concatenate([x, np.full(pad, one)]).reshape(blocks, _BLOCK).T.copy() for x, one in ((m00, 1.0), (m01, 0.0), (m10, 0.0), (m11, 1.0)))
    p, q, r, s = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for k in range(_BLOCK):
        p, q, r, s = p * a[k] + q * c[k], p * b[k] + q * d[k], r * a[k] + s * c[k], r * b[k] + s * d[k]
        total = p + q + r + s
        p, q, r, s = p / total, q / total, r / total, s / total
    x, y, xs, ys = 0.5, 0.5, np.empty(blocks), np.empty(blocks)
    for i, (p1, q1, r1, s1) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        xs[i], ys[i] = x, y
        x, y = x * p1 + y * r1, x * q1 + y * s1
        total = x + y
        x, y = x / total, y / total
    first, second = np.empty((_BLOCK, blocks)), np.empty((_BLOCK, blocks))
    for k in range(_BLOCK):
        xs, ys = xs * a[k] + ys * c[k], xs * b[k] + ys * d[k]
        total = xs + ys
        xs, ys = xs / total, ys / total
        first[k], second[k] = xs, ys
    return first.T.ravel()[:n], second.T.ravel()[:n]


@dataclass
class Crf:
    """Emission weights of the toxic state (the other's are 0), log transitions and start."""
    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    start: np.ndarray
    constant: float | None = None

    def marginals(self, hashed: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, pairs: bool = False):
        """P(toxic) of each word; ``firsts``/``lasts`` mark text ends. With
        ``pairs``, also the expected transition counts."""
        n = hashed.shape[1]
        slot = (hashed % np.uint64(DIMENSIONS)).astype(np.int64)
        emission = np.full(n, self.bias)
        for i in range(_KINDS):
            emission += np.where(hashed[i] > 0, self.weights[slot[i]], 0)
        e = np.exp(np.clip(emission, -40, 40))
        t, s = np.exp(self.transitions), np.exp(self.start)
        m = [np.where(firsts, s[j], t[i, j]) * (e if j else 1.0) for i in (0, 1) for j in (0, 1)]
        a0, a1 = _scan(*m)
        following = np.append(e[1:], 1.0)
        back = [np.where(lasts, 1.0, t[j, i] * (following if i else 1.0))[::-1] for i in (0, 1) for j in (0, 1)]
        b0, b1 = (x[::-1] for x in _scan(*back))
        on, off = a1 * b1, a0 * b0
        p = on / (on + off)
        if not pairs:
            return p
        inner = ~lasts
        xi = np.empty((2, 2))
        joint = [[(a[:-1] * t[i, j] * (following[:-1] if j else 1.0) * b[1:]) for j, b in ((0, b0), (1, b1))] for i, a in ((0, a0), (1, a1))]
        norm = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
        for i in (0, 1):
            for j in (0, 1):
                xi[i, j] = (joint[i][j] / norm)[inner[:-1]].sum()
        return p, xi, slot


def _ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    firsts, lasts = np.zeros(len(words), bool), np.zeros(len(words), bool)
    some = words.first[:-1] < words.first[1:]
    firsts[words.first[:-1][some]] = True
    lasts[words.first[1:][some] - 1] = True
    return firsts, lasts


def fit(texts: list[bytes], toxic: np.ndarray, lexicon: np.ndarray, epochs: int = 60, l2: float = 1e-6) -> Crf:
    """Train on texts whose words are tagged by the lexicon (toxic texts only).
    Without tagged words, the score is the share of toxic texts."""
    words = Words(texts)
    hashed, _, _ = units(words)
    y = np.isin(hashed[[0, 2, 3, 4]], lexicon).any(axis=0) & toxic[words.doc] if len(words) else np.zeros(0, bool)
    model = Crf(np.zeros(DIMENSIONS), -3.0, np.array([[0.0, 0.0], [0.0, 0.0]]), np.zeros(2))
    if not y.any():
        model.constant = float(toxic.mean()) if len(texts) else 0.0
        return model
    firsts, lasts = _ends(words)
    n = len(y)
    seen = np.zeros((2, 2))
    inner = ~lasts[:-1]
    np.add.at(seen, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), 1)
    begin = np.array([(firsts & ~y).sum(), (firsts & y).sum()], float)
    dims = DIMENSIONS + 7
    theta, m, v = np.zeros(dims), np.zeros(dims), np.zeros(dims)
    theta[DIMENSIONS] = -3.0
    for t in range(1, epochs + 1):
        model = Crf(theta[:DIMENSIONS], theta[DIMENSIONS], theta[DIMENSIONS + 1:DIMENSIONS + 5].reshape(2, 2), theta[DIMENSIONS + 5:])
        p, xi, slot = model.marginals(hashed, firsts, lasts, pairs=True)
        delta = p - y
        grad = np.zeros(dims)
        for i in range(_KINDS):
            grad[:DIMENSIONS] += np.bincount(slot[i][hashed[i] > 0], delta[hashed[i] > 0], DIMENSIONS)
        grad[DIMENSIONS] = delta.sum()
        grad[DIMENSIONS + 1:DIMENSIONS + 5] = (xi - seen).ravel()
        started = np.array([(1 - p[firsts]).sum(), p[firsts].sum()])
        grad[DIMENSIONS + 5:] = started - begin
        grad = grad / y.sum() + l2 * n / y.sum() * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.3 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6) * (np.abs(m) > 0)
    return Crf(theta[:DIMENSIONS].astype(np.float32), float(theta[DIMENSIONS]), theta[DIMENSIONS + 1:DIMENSIONS + 5].reshape(2, 2), theta[DIMENSIONS + 5:])


_COUNTS = T.StructType([T.StructField("unit", T.LongType()), T.StructField("n", T.LongType())])


def _document_counts(rows: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(unit, n): number of texts of a bounded sample that hold each unit (one of ``only``)."""
    def run(batches):
        for batch in batches:
            for _, texts in slices(batch, [], "text"):
                words = Words(texts)
                hashed, _, _ = units(words)
                kinds = hashed[[0, 2, 3, 4]]
                unit, doc = kinds.ravel(), np.tile(words.doc, len(kinds)).astype(np.uint64)
                keep = unit > 0 if only is None else np.isin(unit, only)
                both = np.unique(np.stack([unit[keep], doc[keep]]), axis=1)[0] if keep.any() else np.zeros(0, np.uint64)
                values, n = np.unique(both, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], ["unit", "n"])

    return rows.select("text").mapInArrow(run, _COUNTS).groupBy("unit").agg(F.sum("n").alias("n"))


_SIGNATURE = 8


def _distinct_ids(rows: DataFrame) -> DataFrame:
    """(id, y) of a bounded sample without near copies: texts whose word sets
    share two neighbouring minima of eight are taken as one. Copies would make
    any word of a copied text look tied to its label. Only the minima of the
    sample's rows are collected."""
    seeds = mix64(np.arange(1, _SIGNATURE + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            for kept, texts in slices(batch, ["id", "y"], "text"):
                words = Words(texts)
                hashed = words.hashes()
                least = [np.min(mix64(hashed[a:b, None] ^ seeds), axis=0).tobytes() if b > a else bytes(8 * _SIGNATURE)
                         for a, b in zip(words.first[:-1], words.first[1:])]
                yield pa.RecordBatch.from_arrays([*kept.values(), pa.array(least, pa.binary())], ["id", "y", "least"])

    source = rows.select("id", "y", "text")
    schema = T.StructType([*source.schema.fields[:2], T.StructField("least", T.BinaryType())])
    seen, chosen = set(), {}
    for r in source.mapInArrow(run, schema).orderBy("id", "least").limit(2 * (MAX_TOXIC + MAX_CLEAN)).collect():
        bands = {(k, bytes(r["least"][16 * k:16 * k + 16])) for k in range(_SIGNATURE // 2)}
        if r["id"] not in chosen and not bands & seen:
            chosen[r["id"]] = r["y"]
        seen |= bands
    return rows.sparkSession.createDataFrame(list(chosen.items()), rows.select("id", "y").schema)


def train(docs: DataFrame, labels: DataFrame, use: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Crf:
    """Fit on bounded samples of the labelled rows that satisfy ``use``."""
    ids = labelled.labelled_ids(docs, labels, label, use, id_col)
    toxic, clean = (_distinct_ids(labelled.texts_of(docs, labelled.sample(ids.where(f"y = {y}"), n), id_col, text_col)) for y, n in ((1, MAX_TOXIC), (0, MAX_CLEAN)))
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic:
        return fit([], np.zeros(0, bool), np.zeros(0, np.uint64))
    least = max(3, math.ceil(CHANCE / math.log((n_toxic + n_clean) / n_toxic))) if n_clean else 3
    mostly = {r["unit"]: r["n"] for r in _document_counts(labelled.texts_of(docs, toxic, id_col, text_col)).where(F.col("n") >= least).collect()}
    candidates = np.array(sorted(mostly), np.int64).view(np.uint64)
    other = {r["unit"]: r["n"] for r in _document_counts(labelled.texts_of(docs, clean, id_col, text_col), candidates).collect()}
    share = max(1, n_clean) / n_toxic
    lexicon = np.array([u for u, n in sorted(mostly.items()) if other.get(u, 0) < 0.02 * n * share], np.int64).view(np.uint64)
    texts, marks = [], []
    for rows, y in ((toxic, True), (clean, False)):
        short = labelled.texts_of(docs, labelled.sample(rows, MAX_TAGGED), id_col, text_col)
        for r in short.where(F.length("text") <= MAX_TAGGED_CHARS).orderBy("id", "text").limit(2 * MAX_TAGGED).collect():
            texts.append(r["text"].encode("utf-8"))
            marks.append(y)
    model = fit(texts, np.array(marks, bool), lexicon)
    if model.constant is not None:
        # the samples are drawn per class; the share is that of all labelled rows
        model.constant = float(ids.agg(F.avg("y")).first()[0])
    return model


def tag(texts: list[bytes], model: Crf) -> tuple[np.ndarray, list[list[dict]]]:
    """Score of each text and its toxic spans (code point offsets of the words)."""
    if model.constant is not None or not texts:
        return np.full(len(texts), model.constant or 0.0), [[] for _ in texts]
    words = Words(texts)
    spans: list[list[dict]] = [[] for _ in texts]
    if not len(words):
        return np.zeros(len(texts)), spans
    hashed, start, end = units(words)
    p = model.marginals(hashed, *_ends(words))
    score = np.zeros(len(texts))
    np.maximum.at(score, words.doc, p)
    likely = p >= BACKGROUND
    score = np.maximum(score, -np.expm1(np.bincount(words.doc[likely], np.log1p(-np.minimum(p[likely], 1 - 1e-12)), len(texts))))
    for i in np.flatnonzero(p >= SPAN_CUT).tolist():
        d = int(words.doc[i])
        done = spans[d][-1] if spans[d] else {"end": 0, "_byte": 0}
        at, to = int(start[i] - words.base[d]), int(end[i] - words.base[d])
        a = done["end"] + len(texts[d][done["_byte"]:at].decode("utf-8"))
        spans[d].append({"start": a, "end": a + len(texts[d][at:to].decode("utf-8")), "probability": float(p[i]), "_byte": to})
    for s in spans:
        for x in s:
            del x["_byte"]
    return np.clip(score, 0, 1), spans


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())]))
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def toxic_documents(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score, predicted, spans of every row. Null and empty texts
    score 0 and have no spans; repeated rows are scored alike."""
    source = docs.select(id_col, text_col)

    def run(batches):
        for batch in batches:
            for kept, texts in slices(batch, [id_col], text_col):
                score, spans = tag(texts, model)
                yield pa.RecordBatch.from_arrays([kept[id_col], pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(spans, _ARROW_SPAN)],
                                                 [id_col, "score", "predicted", "spans"])

    return source.mapInArrow(run, T.StructType([source.schema[0], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", _SPAN)]))


def toxic_removed(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """All columns of the documents that are not predicted toxic; all of them where
    no word told toxic texts from others."""
    names = docs.columns
    if model.constant is not None:
        return docs.select(*names)

    def run(batches):
        for batch in batches:
            at = 0
            for _, texts in slices(batch, [], text_col):
                keep = tag(texts, model)[0] < CUT
                yield batch.slice(at, len(texts)).filter(pa.array(keep))
                at += len(texts)

    return docs.select(*names).mapInArrow(run, docs.schema)
