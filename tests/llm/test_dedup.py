import collections
import random
import re

import numpy as np
import pytest

from cauce.llm import blocked_bloom, common, exact_dedup, hyperminhash, queries
from cauce.llm.components import components
from tests.llm.conftest import AWKWARD, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_exact_groups(documents, block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("abAB é") for _ in range(rng.randrange(9))) for _ in range(60)] + [None, "", "long" * 40, "LONG" * 40, "long" * 39 + "lonx"]
    docs = list(enumerate(texts))
    rows = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(documents(docs), block).collect()}
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(LOWER)].append(i)
    for ids in groups.values():
        for i in ids:
            assert (rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) == (max(ids), len(ids), i == max(ids))


def test_exact_awkward(awkward, documents):
    rows = exact_dedup.exact_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    ones = [r for r in rows if r["group_size"] == 4]
    assert len(ones) == 4 and {r["keep_id"] for r in ones} == {5} and sum(r["kept"] for r in ones) == 1  # one, one, ONE, null id
    empty = [r for r in rows if r["group_size"] == 3]
    assert len(empty) == 3 and {r["keep_id"] for r in empty} == {2}
    stay = exact_dedup.kept_documents(awkward)
    assert stay.columns == awkward.columns and stay.count() == len({(t or "").translate(LOWER) for _, t in AWKWARD})
    assert exact_dedup.exact_duplicates(documents([])).count() == 0
    twice = documents([(1, "same"), (1, "same"), (None, "x"), (None, "x")])
    assert sorted((str(r["doc_id"]), r["kept"]) for r in exact_dedup.exact_duplicates(twice).collect()) == [("1", False), ("1", True), ("None", False), ("None", True)]


def test_rows_without_a_list(spark, documents, monkeypatch):
    """As an anti-join, repeated rows and all columns kept, also when the filter takes every row for listed."""
    rows = documents([(i // 2, f"t{i}") for i in range(2000)]).withColumnRenamed("row", "H")
    for most in (blocked_bloom.MAX_BLOCKS, 1):
        monkeypatch.setattr(blocked_bloom, "MAX_BLOCKS", most)
        for listed in (range(0, 1000, 3), range(5000, 5010), range(0)):
            table = spark.createDataFrame([(i,) for i in listed], "doc_id long")
            left = blocked_bloom.rows_without(rows, table, "doc_id")
            assert left.columns == rows.columns
            assert sorted((r["doc_id"], r["text"], r["ids"]) for r in left.collect()) == sorted((i // 2, f"t{i}", b"x") for i in range(2000) if i // 2 not in listed)


def _moved(df):
    """Rows that a frame's exchanges wrote."""
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            plan.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            plan.append(node.plan())
        else:
            total += node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
            plan += [node.children().apply(k) for k in range(node.children().size())]
    return total


@pytest.mark.parametrize("kept", [exact_dedup.kept_documents, hyperminhash.kept_documents])
def test_rows_that_stay_are_not_moved(spark, documents, kept):
    """Of 3000 texts 100 are copies: the last step moves the copies and few others."""
    rows = [(i, " ".join(words(i, 12, 10**6))) for i in range(2900)]
    rows += [(9000 + i, t) for i, t in rows[:100]]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = kept(documents(rows))
        assert _moved(out) < 400 and out.count() == 2900
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 130)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(1000, 1040), rng.randrange(1000, 1040)) for _ in range(25)] + [(5, 5)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[root(a)] = root(b)
    nodes = [n for n in parent if n != 5]
    for a in nodes:
        for b in nodes:
            assert (found[a] == found[b]) == (root(a) == root(b))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _brute(docs):
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(zip(*(w[k:] for k in range(5)))))
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return sets, label


def _near_copies(seed, n_groups=12):
    """Groups whose members drift: chains, stars, sizes near every layout's border."""
    rng = random.Random(seed)
    docs = []
    for g in range(n_groups):
        base = words(seed * 100 + g, rng.choice([3, 7, 12, 24, 30, 48, 60, 96, 110, 200, 390, 800, 1700]), 5000)
        current = base
        for k in range(rng.randrange(2, 9)):
            start = list(current if rng.random() < 0.5 else base)
            for _ in range(rng.randrange(1 + len(start) // 60 + 1)):
                at = rng.randrange(len(start))
                start[at:at + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [start[at], f"m{rng.randrange(10**6)}"]])
            current = start
            docs.append(" ".join(current))
    docs += [" ".join(words(9, 40, 10**6) + words(seed + k, 4, 10**6)) for k in range(6)]  # a shared passage
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(documents, seed):
    docs = _near_copies(seed)
    sets, label = _brute(docs)
    rows = {r["doc_id"]: r for r in hyperminhash.near_duplicates(documents(docs)).collect()}
    least = {}
    for i, x in enumerate(label):
        least[x] = min(least.get(x, i), i)
    for i, _ in docs:
        assert (rows[i]["n_shingles"], rows[i]["component_id"]) == (len(sets[i]), least[label[i]]), i
        assert rows[i]["kept"] == (least[label[i]] == i)


def test_near_awkward(awkward, documents):
    rows = hyperminhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        if r["n_shingles"] == 0:
            assert r["kept"] and r["component_id"] == r["doc_id"]
    ones = [r for r in rows if r["doc_id"] in (4, 5) or (r["doc_id"] is None and r["n_shingles"])]
    assert {r["component_id"] for r in ones} == {4} and sum(r["kept"] for r in ones) == 1
    assert hyperminhash.kept_documents(awkward).columns == awkward.columns
    assert hyperminhash.near_duplicates(documents([])).count() == 0
    assert hyperminhash.near_duplicates(documents([(1, None), (2, "")])).count() == 2


def test_estimate_corrects_collisions():
    rng = np.random.default_rng(1)
    for n, share in ((20, 0.0), (300, 0.5), (3000, 0.85)):
        raw, fixed = [], []
        for _ in range(40):
            common = rng.integers(0, 2**63, round(2 * n * share / (1 + share)), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)])) for _ in range(2))
            times = hyperminhash.repetitions(n)
            x, y = hyperminhash.registers(a, times), hyperminhash.registers(b, times)
            used = (x != 0xFFFF) | (y != 0xFFFF)
            same = ((x == y) & (x != 0xFFFF)).sum() / used.sum()
            c = hyperminhash.chance_of_collision(n, times)
            raw.append(same)
            fixed.append((same - c) / (1 - c))
        assert abs(np.mean(fixed) - share) < 0.03
        assert 0 < hyperminhash.chance_of_collision(n, times) < 0.002


def test_layouts_meet():
    for n in range(1, 4000, 7):
        for m in range(-(-n * 85 // 100), n + 1, max(1, n // 20)):
            assert set(hyperminhash.layouts(n)) & {hyperminhash.repetitions(m)}


def test_query_bounds_its_batches(spark, documents, tmp_path):
    """op2 cuts Arrow batches by bytes, so that ten thousand long texts do not meet in a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = [(i, " ".join(words(i % 20, 30, 10**6))) for i in range(40)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(key)
    spark.conf.set(key, str(1 << 26))
    try:
        found = {r["doc_id"]: r["component_id"] for r in queries.op2_hyperminhash(spark, str(tmp_path)).collect()}
        assert int(spark.conf.get(key)) <= common.ARROW_BYTES
        assert found == {i: i % 20 for i in range(40)}
    finally:
        spark.conf.set(key, before)
