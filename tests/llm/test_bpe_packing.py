import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cauce.llm import bpe, packing
from tests.llm.conftest import AWKWARD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library_on_random_texts(reference):
    rng = random.Random(3)
    alphabet = ["a", "e", "th", "The", "'s", "'", "'ll", "'re", " ", "  ", "\n", "\t", " ", " ", "\u0085", "\x1c", "\x00", "!", "#'", "$$$", "12", "é", "ß", "日本", "🙂", "́",
                "<|endoftext|>", "<|", "|>", "﻿", "٣", "½", ".com", "U.S", "--", "\r\n"]
    codec = bpe.ForcedBoundaryBPE(PATH, cache=50)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        ids = reference.encode(text, add_special_tokens=False).ids
        packed = codec.encode(text.encode())
        assert np.frombuffer(packed, "<u4").tolist() == ids, text
        assert codec.decode(packed) == reference.decode(ids, skip_special_tokens=False) == text


def test_lists_of_texts_equal_the_library(reference):
    """Many texts at once: as each alone, with special tokens, the mark between fragments, and a small cache."""
    rng = random.Random(4)
    alphabet = ["a", "th", "The", "'s", "'", " ", "  ", "\n", "\u0085", "\x00", "!", "$$$", "12", "é", "日本", "🙂", bpe._BETWEEN, "<|endoftext|>", "<|", "|>", ".com", "--", "\r\n"]
    codec = bpe.ForcedBoundaryBPE(PATH, cache=50)
    for few in (alphabet, [a for a in alphabet if a != bpe._BETWEEN]):
        for _ in range(200):
            texts = ["".join(rng.choice(few) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(20))]
            packed = codec.encode_all([t.encode() for t in texts])
            assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_fragments_are_encoded_in_one_call():
    codec, calls = bpe.ForcedBoundaryBPE(PATH), []
    encoder = codec._encoder

    class Counting:
        def encode(self, text, **options):
            calls.append(text)
            return encoder.encode(text, **options)

    codec._encoder, codec._ids.encode = Counting(), None
    texts = [f"word{k} other{k * k}, text".encode() for k in range(500)]
    once = codec.encode_all(texts)
    assert len(calls) == 1 and codec.encode_all(texts) == once and len(calls) == 1
    assert once == [bpe.codec(PATH).encode(t) for t in texts]


def test_cuts_never_fall_inside_a_token():
    codec = bpe.codec(PATH)
    for token in codec.table:
        pair = np.frombuffer(token, np.uint8)
        if len(pair) > 1 and token != b"<|endoftext|>":
            assert not codec.never[pair[:-1], pair[1:]].any()
    assert codec.never.sum() > 60_000 and codec._text_cuts().sum() > 1000


def test_decoding_replaces_bytes_that_are_no_text(reference):
    ids = [i for i, t in enumerate(bpe.codec(PATH).table) if t in (b"\xe2", b"\xff", b"a")]
    assert bpe.codec(PATH).decode(np.array(ids, "<u4").tobytes()) == reference.decode(ids, skip_special_tokens=False)


def test_awkward_documents_round_trip(awkward, reference):
    rows = bpe.round_trip(awkward, PATH).collect()
    expect = sorted((str(i), hashlib.sha256(np.array(reference.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest(), t or "") for i, t in AWKWARD)
    assert sorted((str(r["doc_id"]), hashlib.sha256(r["ids"]).hexdigest(), r["decoded"]) for r in rows) == expect
    back = bpe.decode_documents(bpe.encode_documents(awkward, PATH), PATH).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t in AWKWARD)


def test_empty_tables(documents):
    none = documents([])
    assert bpe.round_trip(none, PATH).count() == 0
    assert packing.pack_documents(none, PATH).count() == 0


def _check_plan(counts, capacity, **options):
    plan = packing.plan_packing(counts, capacity, **options)
    room, seen = defaultdict(list), defaultdict(int)
    for k in range(len(plan.length)):
        same = plan.length == plan.length[k]
        later = plan.rank[same & (plan.rank > plan.rank[k])]
        n = int(later.min() if len(later) else counts[plan.length[k]]) - int(plan.rank[k])
        seen[int(plan.length[k])] += n
        for c in range(n):
            room[int(plan.sequence[k]) + c].append((int(plan.offset[k]), int(plan.length[k])))
    assert seen == {k: v for k, v in counts.items() if v}
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(room) == plan.n_sequences
    return plan.n_sequences


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_valid_and_near_the_bound(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 100, 2048])
    counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 60) for _ in range(rng.randrange(1, 80))}
    n = _check_plan(counts, capacity, groups=rng.choice([1, 4, 96, 1000]))
    total, big = sum(k * v for k, v in counts.items()), sum(v for k, v in counts.items() if 2 * k > capacity)
    assert max(big, -(-total // capacity)) <= n <= 2 * max(big, -(-total // capacity))


def test_many_documents_pack_as_well_as_their_tokens_allow():
    rng = random.Random(5)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(2048, max(1, int(rng.lognormvariate(6, 1))))] += 1
    n = packing.plan_packing(dict(counts)).n_sequences
    assert n <= 1.005 * -(-sum(k * v for k, v in counts.items()) // 2048) + 1


def test_exact_small_optimum():
    assert _check_plan({6: 2, 4: 2, 5: 2}, 10) == 3
    assert _check_plan({7: 3, 3: 3}, 10) == 3


def test_pieces_of_awkward_documents(awkward, reference):
    rows = packing.pack_documents(awkward, PATH).toPandas()
    expect = sorted(zlib.crc32(np.array((ids := reference.encode(t or "", add_special_tokens=False).ids + [0])[:len(ids) % 2048 or 2048], "<u4").tobytes()) for _, t in AWKWARD)
    assert sorted(rows[rows.piece == 0].ids_crc32) == expect
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert (rows[rows.piece > 0].length == 2048).all()
    assert len(rows) == sum(-(-(len(reference.encode(t or "", add_special_tokens=False).ids) + 1) // 2048) for _, t in AWKWARD)
