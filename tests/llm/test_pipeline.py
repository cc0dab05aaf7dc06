import corpus_pipeline
from cauce.llm import hyperminhash
from tests.llm.conftest import words


def test_near_copies_from_four_fifths_on(spark, documents):
    """Pairs of known similarity: the stage links from 0.80 on, op2 from 0.85."""
    rows = []
    for k, (common, more) in enumerate([(82, 18), (80, 20), (79, 21), (86, 14)]):
        base = words(70 + k, common + more + 4, 10**6)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:common + 4]))]  # common of common + more shingles
    stay = corpus_pipeline.near_copies(spark, documents(rows), "")
    assert sorted(r["doc_id"] for r in stay.collect()) == [0, 2, 4, 5, 6]
    assert sorted(r["doc_id"] for r in hyperminhash.kept_documents(documents(rows)).collect()) == [0, 1, 2, 3, 4, 5, 6]


def _kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def _brute_exact(rows):
    best = {}
    for i, t in rows:
        low = (t or "").lower()
        best[low] = max(best.get(low, (i, t)), (i, t))
    return sorted(best.values(), key=str)


def _brute_near(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    return sorted((min(r for r, y in zip(rows, label) if y == x) for x in set(label)), key=str)


def test_run_against_brute_force(spark, documents, tmp_path, monkeypatch):
    """Planted low-quality and toxic rows, exact and near copies, no text; every stage and the whole run."""
    rows, marks = [], []
    for i in range(350):
        text = words(i, 40, 3000)
        poor, vile = i % 5 == 0, i % 7 == 1
        if vile:
            text[3:3] = ["vileword", "nastyword"]
        rows.append((i, " ".join(w.upper() + "!!" for w in text) if poor else " ".join(text)))
        marks.append((i, int(vile), int(not poor)))
    planted = [i for i, vile, good in marks if good and not vile]
    for k, i in enumerate(planted[:20]):
        rows.append((1000 + k, rows[i][1]))
    for k, i in enumerate(planted[20:40]):
        rows.append((2000 + k, rows[i][1] + " tail"))
    base = words(999, 104, 3000)
    rows += [(3000, None), (3001, ""), (3002, " ".join(base)), (3003, " ".join(base[:86]))]  # similarity 0.82
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    after, staged = [], corpus_pipeline.staged
    monkeypatch.setattr(corpus_pipeline, "staged", lambda df, name: after.append(staged(df, name)) or after[-1])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    good, clean, single, apart = (_kept(df) for df in after)
    assert all(df.columns == documents([]).columns for df in after)
    truth = {i: (vile, fine) for i, vile, fine in marks}
    assert set(good) <= set(rows) and set(clean) <= set(good)
    assert {i for i, _ in good if i in truth} == {i for i in truth if truth[i][1]}
    assert {i for i, _ in clean if i in truth} == {i for i in truth if truth[i] == (0, 1)}
    assert single == _brute_exact(clean) and apart == _brute_near(single)
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in apart}
    documents([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
