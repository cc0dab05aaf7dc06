"""Byte-pair encoding and decoding of whole texts with forced-boundary splitting.

A merged token can only span two neighbouring bytes if that pair occurs inside
some vocabulary token. A pair that occurs in none is a certain cut: nothing
ever merges across it, so the fragments on its two sides are encoded
independently (most of them come from a bounded cache) and their ids are
concatenated. Cuts next to white space, inside UTF-8 sequences and before an
apostrophe after punctuation are left alone, because there the pre-tokenizer's
pattern looks across the cut.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the pre-tokenizer's pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SEPARATOR = b"\xff"  # never part of UTF-8
#: Stands between fragments that are encoded in one call; a list of which one holds it is encoded one by one.
_BETWEEN = "\U0010fffe"


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 stands for itself, the rest is numbered from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Fragments(dict):
    """Fragment -> ids (little-endian unsigned 32-bit). Two generations: a full
    one becomes the old one, so memory is bounded and common fragments stay."""

    def __init__(self, encode, capacity: int, longest: int = 96):
        super().__init__()
        self.encode, self.capacity, self.longest, self.old = encode, capacity, longest, {}

    def __missing__(self, fragment: bytes) -> bytes:
        ids = self.old.get(fragment)
        if ids is None:
            ids = np.array(self.encode(fragment.decode("utf-8")), "<u4").tobytes()
        self.keep(fragment, ids)
        return ids

    def keep(self, fragment: bytes, ids: bytes) -> None:
        if len(fragment) <= self.longest:
            if len(self) >= self.capacity:
                self.old = dict(self)
                self.clear()
            self[fragment] = ids


def _runs(rows: list[int], texts: list[bytes], budget: int = 4 << 20) -> list[list[int]]:
    """Consecutive rows in runs of about ``budget`` bytes of text."""
    out, size = [], budget
    for k in rows:
        if size >= budget:
            out.append([])
            size = 0
        out[-1].append(k)
        size += len(texts[k])
    return out


class ForcedBoundaryBPE:
    """Encoder and decoder for a byte-level BPE file (JSON of vocabulary and merges)."""

    def __init__(self, path: str, cache: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.table = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        for token, i in added.items():
            self.table[i] = token.encode("utf-8")
        inside = np.zeros((256, 256), bool)
        for token in ranks:
            if len(token) > 1:
                pair = np.frombuffer(token, np.uint8)
                inside[pair[:-1], pair[1:]] = True
        self.never = ~inside
        self._cut = self._text_cuts().ravel()
        self._encoder = tiktoken.Encoding("forced-boundary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={_BETWEEN: len(self.table)})
        self._ids = _Fragments(self._encoder.encode_ordinary, cache)
        self._special = {t.encode("utf-8"): np.array([i], "<u4").tobytes() for t, i in added.items()}
        self._split = re.compile(b"(" + b"|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + b")") if added else None

    def _text_cuts(self) -> np.ndarray:
        """Certain cuts that are also safe for the pre-tokenizer's pattern."""
        cut = self.never.copy()
        cut[128:, :] = False
        cut[[*range(9, 14), *range(28, 33)], :] = False
        alnum = np.zeros(256, bool)
        alnum[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        cut[~alnum, ord("'")] = False
        return cut

    def _plain(self, data: bytes) -> bytes:
        raw = np.frombuffer(data, np.uint8)
        if len(raw) < 2:
            return self._ids[data] if data else b""
        at = np.flatnonzero(self._cut[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]) + 1
        fragments = np.insert(raw, at, 255).tobytes().split(_SEPARATOR)
        return b"".join(map(self._ids.__getitem__, fragments))

    def _lookup(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of distinct fragments: unknown ones are encoded on their own, but in one call."""
        cache = self._ids
        found = list(map(cache.get, fragments))
        missing = [k for k, ids in enumerate(found) if ids is None]
        for k in missing:
            found[k] = cache.old.get(fragments[k])
        fresh = [k for k in missing if found[k] is None]
        between = _BETWEEN.encode("utf-8")
        listed = between.join([fragments[k] for k in fresh])
        if listed.count(between) >= max(1, len(fresh)):
            for k in fresh:
                found[k] = np.array(cache.encode(fragments[k].decode("utf-8")), "<u4").tobytes()
        elif fresh:
            ids = np.array(self._encoder.encode(listed.decode("utf-8"), allowed_special="all"), "<u4")
            packed, edges = ids.tobytes(), (4 * np.flatnonzero(ids == len(self.table))).tolist()
            for k, a, b in zip(fresh, [0, *(e + 4 for e in edges)], [*edges, len(packed)]):
                found[k] = packed[a:b]
        for k in missing:
            cache.keep(fragments[k], found[k])
        return found

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """``encode`` of each text: the distinct fragments of all are looked up once."""
        out = [self.encode(t) if self._split is not None and self._split.search(t) else b"" for t in texts]
        plain = [k for k, t in enumerate(texts) if t and not out[k]]
        for run in _runs(plain, texts):
            self._encode_plain(run, texts, out)
        return out

    def _encode_plain(self, run: list[int], texts: list[bytes], out: list[bytes]) -> None:
        data = b"".join([texts[k] for k in run])
        raw = np.frombuffer(data, np.uint8)
        cut = np.ones(len(raw) + 1, bool)
        np.take(self._cut, (raw[:-1].astype(np.uint16) << 8) | raw[1:], out=cut[1:-1])
        ends = np.cumsum([len(texts[k]) for k in run])
        cut[ends] = True
        offsets = np.flatnonzero(cut).astype(np.int32)
        fragments = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self._lookup(fragments.dictionary.to_pylist()), pa.large_binary()).take(fragments.indices)
        _, starts, packed = ids.buffers()
        starts = np.frombuffer(starts, np.int64)[:len(ids) + 1]
        at = starts[np.searchsorted(offsets, ends)].tolist()
        packed = packed.to_pybytes() if packed is not None else b""
        for k, a, b in zip(run, [int(starts[0]), *at], at):
            out[k] = packed[a:b]

    def encode(self, data: bytes) -> bytes:
        """Ids of a UTF-8 text, packed as little-endian unsigned 32-bit integers."""
        if self._split is None or not self._split.search(data):
            return self._plain(data)
        return b"".join(self._special.get(p) or self._plain(p) for p in self._split.split(data))

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryBPE:
    """One encoder per Python worker and vocabulary file."""
    return ForcedBoundaryBPE(path)


def _bytes_of(value) -> bytes:
    text = value.as_py()
    return text.encode("utf-8") if text else b""


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (binary: packed little-endian unsigned 32-bit) of each whole text.

    One row per input row, repeated ids too; null and empty text give no ids.
    ``path`` must be readable on the executors.
    """
    def run(batches):
        bpe = codec(path)
        for batch in batches:
            ids = pa.array([bpe.encode(_bytes_of(v)) for v in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, T.StructType([source.schema[0], T.StructField("ids", T.BinaryType())]))


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` from packed ids (special tokens are kept); null ids give empty text."""
    def run(batches):
        bpe = codec(path)
        for batch in batches:
            text = pa.array([bpe.decode(v.as_py() or b"") for v in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], [id_col, "text"])

    source = encoded.select(id_col, ids_col)
    return source.mapInArrow(run, T.StructType([source.schema[0], T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_documents`` and ``decode_documents`` in one Python pass: ``id_col``, ``ids``, ``decoded``."""
    def run(batches):
        bpe = codec(path)
        for batch in batches:
            packed, back = [], []
            for value in batch.column(1):
                ids = bpe.encode(_bytes_of(value))
                packed.append(ids)
                back.append(bpe.decode(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(back, pa.string())], [id_col, "ids", "decoded"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, T.StructType([source.schema[0], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]))
