import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cauce.llm import blocked_bloom, divergence, hard_negatives, queries, url_filter
from tests.llm.conftest import AWKWARD, words

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- divergence

def audit(rows, least):
    """Brute force over (text, lang, source) rows: {(lang, source, part): [(item, value)]}."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [TERM.findall(t.translate(LOWER)) for t, _, _ in rows]
    out = {}
    for lang in {r[1] for r in rows}:
        mine = [(r[2], w) for r, w in zip(rows, terms) if r[1] == lang]
        within = collections.Counter(x for _, w in mine for x in set(w))
        kept = [x for x, n in within.items() if n >= least]
        counts = {s: collections.Counter() for s, _ in mine}
        for s, w in mine:
            counts[s].update(x for x in w if within[x] >= least)
        p = lambda c, x: 1 + 10**9 * (c[x] + 5) // (sum(c.values()) + 5 * len(kept))
        whole = sum(counts.values(), collections.Counter())
        for s, c in counts.items():
            pairs = [(o, sum(abs(p(c, x) - p(d, x)) for x in kept)) for o, d in counts.items() if o != s]
            best = [(x, p(c, x) - p(whole, x)) for x in kept if c[x] and p(c, x) > p(whole, x)]
            key = lambda e: (-e[1], e[0].encode())
            out[lang, s, "pair"], out[lang, s, "term"] = sorted(pairs, key=key), sorted(best, key=key)[:50]
    return {k: v for k, v in out.items() if v}


def found(frame):
    out = collections.defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        out[r["lang"], r["source"], r["part"]].append((r["item"], r["value"]))
        assert r["rank"] == len(out[r["lang"], r["source"], r["part"]])
    return dict(out)


def frame(spark, rows):
    """Extra columns are named like those that the operator makes."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, n long, term string, block long")


@pytest.mark.parametrize("sources", [2, 512])
def test_divergence(spark, sources, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_ROWS", 40)
    rng = random.Random(3)
    # half of the rows come from one source; one source's texts have no term, one language keeps none
    rows = [(" ".join(rng.choice(("Ab", "bC", "cd", "é1ñ", "Ñ", f"w{rng.randrange(40)}x", "don't")) for _ in range(rng.randrange(40))), "en", rng.choice(["s0", "s0", "s0", "s1", "s2", "S3", None])) for _ in range(90)]
    rows += [("1 2 3", "en", "digits"), (None, "en", "digits"), ("rare words", "xx", "a"), ("other ones", "xx", "b"), (None, None, None), ("", None, "z"), ("alone", "yy", "only")]
    rows += [(t, "awk", "s%d" % (k % 3)) for k, (_, t) in enumerate(AWKWARD)] * 2
    for least in (1, 5):
        got = found(divergence.divergences(frame(spark, rows), min_documents=least, sources=sources))
        assert got == audit(rows, least)


def test_divergence_empty(spark):
    assert divergence.divergences(frame(spark, [])).count() == 0
    one = divergence.divergences(frame(spark, [("a b", "en", "s")]), min_documents=1)
    assert found(one) == {}  # its terms are not above the language's, which are its own


def test_probability_is_exact():
    count, total, terms = np.array([0, 7, 8 * 10**14]), 9 * 10**14, 10**6
    got = divergence.probability(count, total, terms)
    assert got.tolist() == [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in count.tolist()]


# ---------------------------------------------------------------- hard negatives

@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 3, 7), (17, 9, 33), (64, 64, 64), (40, 70, 41)])
def test_strassen(shape):
    rng = np.random.default_rng(sum(shape))
    a, c = rng.integers(-2**29, 2**29, (shape[0], shape[1])), rng.integers(-2**29, 2**29, (shape[2], shape[1]))
    assert np.array_equal(hard_negatives.strassen(a, c, 2), a @ c.T)


def test_scores_beyond_64_bits():
    a, c = np.array([[2**40, 3]]), np.array([[2**40, 5], [1, 1], [-2**40, 0]])
    assert hard_negatives.scores(a, c).tolist() == [[2**63 - 1, 2**40 + 3, -(2**63 - 1)]]
    assert hard_negatives.scores(np.array([[2**40]]), np.array([[3, 2**40]])).tolist() == [[3 * 2**40]]
    assert hard_negatives.scores(np.zeros((2, 0), int), np.zeros((3, 0), int)).tolist() == [[0] * 3] * 2


def mined(rows, anchors):
    """Brute force over (id, vector, label)."""
    sound = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
             if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (i, v, y) in enumerate(sound):
        if not anchors(i):
            continue
        all_scores = [(-score(v, w), j, z) for n, (j, w, z) in enumerate(sound) if n != k]
        for ps, p, _ in sorted(x for x in all_scores if x[2] == y)[:5]:
            fit = sorted((s, j) for s, j, z in all_scores if z != y and 30 * -ps <= 100 * -s <= 90 * -ps)
            out += [(i, p, r, j, -ps, -s) for r, (s, j) in enumerate(fit[:10], 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, row long, score long, owner long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1) for r in rows], VECTORS)


def test_hard_negatives(spark):
    rng = random.Random(5)
    unit = lambda n: [rng.gauss(0.2, 1) for _ in range(n)]
    same = unit(6)
    rows = [(i, [float(np.float32(x)) for x in (same if i % 4 == 0 else unit(6 if i % 9 else 3))], i % 3) for i in range(150)]
    rows += [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")], 1), (210, [float("inf"), 1.0], 1), (None, [1.0], 1), (203, [1.0], None), (220, [], 1), (230, [-1.0] * 6, 7), (231, [3e38] * 2, 8)]
    rows += [(40, [float(np.float32(x)) for x in same], 2), (40, [float(np.float32(x)) for x in same], 2)]
    got = hard_negatives.hard_negatives(vectors(spark, rows), F.col("id") % 10 == 0, block_bytes=300)
    small = [r for r in rows if r[0] != 231]
    anchors = lambda i: i % 10 == 0
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(vectors(spark, small), F.col("id") % 10 == 0, block_bytes=300).collect()) == mined(small, anchors)
    assert got.count() > 0  # the vector near the end of float's range saturates
    assert hard_negatives.hard_negatives(vectors(spark, []), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(vectors(spark, [(10, [1.0], 1)]), F.col("id") % 10 == 0).count() == 0


# ---------------------------------------------------------------- URLs

def test_bloom_has_no_false_negative_and_few_false_positives(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    blocks = 2048
    held = blocked_bloom.bloom(rows, blocks)
    inside = np.array([r["h"] for r in rows.collect()])
    outside = np.array([r["h"] for r in spark.range(1 << 40, (1 << 40) + 20_000).select(F.xxhash64("id").alias("h")).collect()])
    assert blocked_bloom.maybe_listed(held, inside).all()
    assert blocked_bloom.maybe_listed(held, outside).mean() < 0.01
    assert blocked_bloom.bloom(rows.limit(0), 1).tolist() == [[0] * blocked_bloom.WORDS]


def judge(url, rules, blocked):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits and host:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if host and canonical(url) in blocked else "allow"


def canonical(url):
    rest = url.split("://", 1)[1]
    host = re.sub(r"\.?(:80|:443)?$", "", re.match(r"[^/?#]*", rest)[0].translate(LOWER))
    query = re.match(r"[^?#]*\??([^#]*)", rest)[1]
    kept = sorted(p for p in query.split("&") if p and not re.match(r"(utm_[^=]*|ref|gclid|fbclid)(=|$)", p))
    return host + re.sub("/+$", "", re.match(r"[^/?#]*([^?#]*)", rest)[1]) + ("?" + "&".join(kept) if kept else "")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.c", "", "block"), ("Tie.x", "/yy", "allow"), ("tie.x", "/yy", "block")]
URLS = [None, "", "no scheme", "://", "http://", "http:///path", "http://NET/", "http://net", "http://www.net/x?y#z", "https://example.net/en/1", "http://xexample.net/en/1", "http://a.example.net/en",
        "http://a.example.com/de/1", "http://example.com/d", "http://É.org/fr/ü", "http://x.a.b.c", "http://b.c/", "http://s.tie.x/yyz", "http://bad.io/p/?utm_source=1&b=2&a=1#f", "http://bad.io/p?a=1&b=2",
        "http://bad.io/p?b=2", "http://bad.io:443/p/?b=2&a=1&", "http://bad.io./q", "http://u@bad.io/q", "http://" + "a." * 3000 + "net/" + "x" * 20_000, "http://q.io?x=://", "http://q.io/://#?"]


def test_urls(spark):
    rows = list(enumerate(URLS)) + [(3, "http://net/"), (3, "http://net/"), (None, "http://net/")] + [(100 + k, f"http://h{k % 3}.net/{k}") for k in range(300)]
    pages = spark.createDataFrame([(*r, "x", True, 1) for r in rows], "page_id long, url string, key string, verdict boolean, row long")
    listed = [None, "x", "http://", "https://BAD.io/p?a=1&b=2", "ftp://bad.io/q/", "http://q.io?x=://"]
    blocked = {canonical(u) for u in listed if u and "://" in u and canonical(u)}
    rules = spark.createDataFrame(RULES + [(None, "/", "block"), ("q.io", None, "block")], "host string, path string, verdict string")
    want = [(r[0], *judge(r[1], [(h.lower(), p, v) for h, p, v in RULES], blocked)) for r in rows]
    by_row = lambda rows: sorted(rows, key=str)
    for most in (1, 1 << 17):  # one block: many false positives, the same verdicts
        got = url_filter.judged(pages, rules, spark.createDataFrame([(u,) for u in listed], "url string"), max_blocks=most)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert by_row(tuple(r) for r in got.collect()) == by_row(want)
    assert {r["verdict"] for r in url_filter.judged(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judged(pages.limit(0), rules).count() == 0


def test_mirrors(spark):
    rows = [(1, "http://a/1", "<p><article>x</article>1"), (2, "http://a/2", "<b><article>x</article>2"), (3, "http://a/3", None), (4, "http://a/4", ""), (5, None, "<article>x</article>"),
            (6, "http://a/6", "plain"), (7, "http://a/7", "plain"), (8, "http://a/8", "<article></article>"), (9, "http://a/9", "<article></article>"), (None, "http://a/0", "plain")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, id long")
    assert sorted(str(r["url"]) for r in url_filter.mirror_urls(pages).collect()) == ["None", "http://a/2", "http://a/7"]


# ---------------------------------------------------------------- the registered queries' own columns

def test_query_columns(spark, tmp_path):
    rng = random.Random(9)
    spark.createDataFrame([(i, " ".join(words(i % 6, 50, 30)), "en", f"s{i % 3}") for i in range(40)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    vecs = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 10) for i in range(400)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    pages = [(k, u, f"<article>{k // 2}</article>") for k, u in enumerate(URLS)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op11_source_divergence(spark, str(tmp_path)).dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    changed = [(i, [float(np.float32(x)) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in vecs]
    assert sorted(tuple(r) for r in queries.op12_hard_negatives(spark, str(tmp_path)).collect()) == mined(changed, lambda i: i % 100 == 0)
    blocked = {canonical(u) for k, u, _ in pages if u and "://" in u and k % 2} - {""}
    want = [(k, *judge(u, queries.URL_RULES, blocked)) for k, u, _ in pages]
    assert sorted((tuple(r) for r in queries.op13_url_filter(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_matrix_pads():
    assert hard_negatives.matrix(pa.array([[1], [], [2, 3]], pa.list_(pa.int64()))).tolist() == [[1, 0], [0, 0], [2, 3]]
