"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. Preference
pairs (a document labelled 1 beats one labelled 0) are drawn from a bounded
sample of labelled rows, and the weights minimise the logistic loss on the
pairs' feature differences. The verdict cuts the strengths at the quantile
that the label-0 share of the sample names.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce.llm import labelled
from cauce.llm.common import ASCII_SPACE, mix64, powers_of_base, slices

#: Bounds of the fit: labelled rows and preference pairs.
MAX_LABELLED = 8000
MAX_PAIRS = 40_000
#: A document is predicted 1 from this score on.
CUT = 0.3
SHAPES = 192
#: Text bytes whose features are made at once.
SLICE_BYTES = 1 << 20
_SYMBOLS = "!?|#$%&*<>{}[]()=+_/\\@~^;:\"'.,-"
N_FEATURES = 12 + len(_SYMBOLS) + SHAPES
_OTHER, _SPACE, _CAPITAL, _LETTER, _DIGIT = range(5)
_SHAPE_OF = np.array([0, 0, ord("A"), ord("a"), ord("0")], np.uint32)
_class_table: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of each code point, made once per worker: ASCII space, upper-case
    letter, other letter, decimal digit, anything else."""
    if not _class_table:
        table = np.zeros(0x110000, np.uint8)
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                table[ord(c)] = _CAPITAL if unicodedata.category(c) == "Lu" else _LETTER
            elif c.isdecimal():
                table[ord(c)] = _DIGIT
        table[[ord(c) for c in ASCII_SPACE]] = _SPACE
        _class_table.append(table)
    return _class_table[0]


def _hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of ``values`` that begins at ``starts``."""
    length = np.diff(np.append(starts, len(values)))
    weight = powers_of_base(int(length.max(initial=0)))
    place = np.arange(len(values)) - np.repeat(starts, length)
    return mix64(np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * weight[place], starts)) if len(starts) else np.zeros(0, np.uint64)


def _distinct(doc: np.ndarray, hashed: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct hashes of each document, and how often its commonest one occurs."""
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])])) if len(doc) else np.zeros(0, np.int64)
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, doc[first], np.diff(np.append(first, len(doc))))
    return np.bincount(doc[first], minlength=docs), top


def features(texts: list[bytes]) -> np.ndarray:
    """Feature vectors of whole texts; a text without words has only its own flag.

    Shares of capitals, of words equal to the one before, of the commonest and
    of distinct words, of repeated lines, sizes, single symbols a word, and
    hashed word shapes (capitals, letters, digits and equal other characters,
    once a run).
    """
    docs = len(texts)
    out = np.zeros((docs, N_FEATURES), np.float32)
    if not docs:
        return out
    # every text ends in a line break: it ends a word and a line
    joined = b"\n".join(texts) + b"\n"
    cp = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), np.uint32)
    first_byte = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    at = np.concatenate([[0], np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)])
    start = at[first_byte]
    kind = _classes()[cp]
    inside = kind != _SPACE
    chars, capitals, letters = (np.add.reduceat(x, start, dtype=np.int64) for x in (inside, kind == _CAPITAL, (kind == _CAPITAL) | (kind == _LETTER)))

    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    word = np.flatnonzero(opens)
    doc = np.searchsorted(start, word, "right") - 1
    n = np.bincount(doc, minlength=docs)
    inner = cp[inside]
    first = np.flatnonzero(opens[inside])
    hashed = _hashes(inner, first)
    distinct, top = _distinct(doc, hashed, docs)
    same = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    adjacent = np.bincount(doc[1:][same], minlength=docs)

    end = np.flatnonzero(cp == 10)
    line = np.concatenate([[0], end[:-1] + 1])
    filled = np.add.reduceat(inside, line, dtype=np.int64) > 0
    line_doc = (np.searchsorted(start, line, "right") - 1)[filled]
    lines = np.bincount(line_doc, minlength=docs)
    different, _ = _distinct(line_doc, _hashes(cp, line)[filled], docs)

    some = n > 0
    out[~some, 0] = 1
    m, k = n[some], lines[some]
    share = capitals[some] / np.maximum(1, letters[some])
    repeated = adjacent[some] / m
    size = chars[some]
    out[some, 1:12] = np.column_stack([np.log1p(m) / 10, share, np.sqrt(share), repeated, np.sqrt(repeated), np.where(m > 20, top[some] / m, 0), distinct[some] / m,
                                       size / m / 20, 1 - different[some] / k, np.minimum(5, np.log1p(m / k)) / 5, letters[some] / size])

    symbol = np.full(128, -1, np.int64)
    symbol[[ord(c) for c in _SYMBOLS]] = np.arange(len(_SYMBOLS))
    marks = np.flatnonzero((cp < 128) & (kind == _OTHER))
    which = symbol[cp[marks]]
    marks, which = marks[which >= 0], which[which >= 0]
    counts = np.bincount((np.searchsorted(start, marks, "right") - 1) * len(_SYMBOLS) + which, minlength=docs * len(_SYMBOLS)).reshape(docs, -1)
    out[some, 12:12 + len(_SYMBOLS)] = np.sqrt(counts[some] / m[:, None])

    shape = _SHAPE_OF[kind[inside]]
    shape = np.where(shape > 0, shape, inner)
    run = opens[inside]
    run[1:] |= shape[1:] != shape[:-1]
    bucket = _hashes(shape[run], np.flatnonzero(opens[inside][run])) % np.uint64(SHAPES)
    shapes = np.bincount(doc * SHAPES + bucket.astype(np.int64), minlength=docs * SHAPES).reshape(docs, -1)
    out[some, -SHAPES:] = np.sqrt(shapes[some] / m[:, None])
    return out


@dataclass(frozen=True)
class BradleyTerry:
    """Strength weights, cut strength, and the score of a document without a model."""
    weights: np.ndarray
    cut: float
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the cut strength gets exactly ``CUT``."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights - self.cut + math.log(CUT / (1 - CUT)), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, max_pairs: int = MAX_PAIRS, steps: int = 400, l2: float = 1e-4, seed: int = 7) -> BradleyTerry:
    """Weights from preference pairs; without both labels the score is constant."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return BradleyTerry(np.zeros(N_FEATURES), 0.0, 0.5 if not len(y) else float(len(good) > 0))
    rng = np.random.default_rng(seed)
    pairs = min(max_pairs, len(good) * len(bad))
    g = rng.permutation(np.resize(good, pairs))
    b = rng.permutation(np.resize(bad, pairs))
    d = (x[g] - x[b]).astype(np.float32)
    w, m, v = np.zeros(d.shape[1]), np.zeros(d.shape[1]), np.zeros(d.shape[1])
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(np.clip(d @ w.astype(np.float32), -30, 30)))
        grad = -(d.T @ p.astype(np.float32)) / pairs + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return BradleyTerry(w, float(np.quantile(x @ w, len(bad) / len(y), method="midpoint")))


def feature_rows(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``features`` (float32 bytes) of each whole text."""
    source = docs.select(*keep, text_col)

    def run(batches):
        for batch in batches:
            for kept, texts in slices(batch, keep, text_col, SLICE_BYTES):
                rows = pa.array([x.tobytes() for x in features(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*kept.values(), rows], [*kept, "features"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField("features", T.BinaryType())]))


def train(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          max_labelled: int = MAX_LABELLED) -> BradleyTerry:
    """Fit on at most ``max_labelled`` labelled rows that satisfy ``use``. Only
    their feature vectors reach the driver."""
    ids = labelled.sample(labelled.labelled_ids(docs, labels, label, use, id_col), max_labelled)
    rows = feature_rows(labelled.texts_of(docs, ids, id_col, text_col), ["id", "y"]).orderBy("id", "features").limit(2 * max_labelled).collect()
    x = np.array([np.frombuffer(r["features"], np.float32) for r in rows]).reshape(-1, N_FEATURES)
    return fit(x, np.array([r["y"] for r in rows], int))


def classify(docs: DataFrame, model: BradleyTerry, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score, predicted of every row.

    Null and empty texts are scored too, repeated rows each, and an empty table
    gives no rows. Without a model (no labelled rows, or one label only) all
    rows have the same score.
    """
    source = docs.select(id_col, text_col)

    def run(batches):
        for batch in batches:
            for kept, texts in slices(batch, [id_col], text_col, SLICE_BYTES):
                score = model.scores(features(texts))
                yield pa.RecordBatch.from_arrays([kept[id_col], pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32))], [id_col, "score", "predicted"])

    return source.mapInArrow(run, T.StructType([source.schema[0], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def rejected_removed(docs: DataFrame, model: BradleyTerry, text_col: str = "text") -> DataFrame:
    """All columns of the documents that the model accepts, row by row: repeated
    rows share a verdict, null and empty texts are scored like others, and an
    empty table stays empty."""
    def run(batches):
        for batch in batches:
            keep = [model.scores(features(texts)) >= CUT for _, texts in slices(batch, [], text_col, SLICE_BYTES)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
