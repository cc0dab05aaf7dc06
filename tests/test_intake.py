import pytest
from pyspark.sql import functions as F

from cauce.functions.ids import is_person_id, sanitize_id
from cauce.operators.intake import intake_counts, triage_ids
from cauce.sources.uploads import parse_id_lines, read_id_files


def _clean(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "raw string")
    rows = df.select("raw", sanitize_id(F.col("raw")).alias("c"), is_person_id(sanitize_id(F.col("raw"))).alias("ok")).collect()
    return {r["raw"]: (r["c"], r["ok"]) for r in rows}


def test_sanitize_and_formats(spark):
    out = _clean(spark, ["12.345.678", " 12345678 ", "p00123", "1234", "123456789012", "P", "PABC",
                         "١٢٣٤٥٦", "¹²³⁴⁵", "12345678901", "P12345678901", "\t55555\n"])
    assert out["12.345.678"] == ("12345678", True)
    assert out[" 12345678 "] == ("12345678", True)
    assert out["p00123"] == ("P00123", True)
    assert out["12345678901"][1] and out["P12345678901"][1] and out["\t55555\n"] == ("55555", True)
    for bad in ["1234", "123456789012", "P", "PABC", "١٢٣٤٥٦", "¹²³⁴⁵"]:
        assert out[bad][1] is False, bad


def test_triage_first_occurrence(spark):
    raw = ["12345", "abc", "12345", "12", "67890"]
    up = spark.createDataFrame([("b", i, v) for i, v in enumerate(raw)], "batch_id string, pos long, raw_id string")
    t = {(r["pos"]): (r["verdict"], r["person_id"]) for r in triage_ids(up).collect()}
    assert t[0] == ("valid", "12345") and t[4] == ("valid", "67890")
    assert t[1][0] == "invalid" and t[3][0] == "invalid"
    assert t[2] == ("duplicate", "12345")


def test_batch_size_gate(spark):
    rows = []
    for batch, n in [("n9", 9), ("n10", 10), ("n2000", 2000), ("n2001", 2001)]:
        rows += [(batch, i, str(10000 + i)) for i in range(n)]
    up = spark.createDataFrame(rows, "batch_id string, pos long, raw_id string")
    gate = {r["batch_id"]: r["gate"] for r in intake_counts(triage_ids(up)).collect()}
    assert gate == {"n9": "too_small", "n10": "accepted", "n2000": "accepted", "n2001": "too_large"}


def test_csv_and_txt_parsing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("12345678,87654321\n55555,44444\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("12345678,\n,87654321", encoding="utf-8")
    (tmp_path / "c.txt").write_bytes("﻿12345678\r\n\r\n87654321\r\n".encode("utf-8"))
    (tmp_path / "d.pdf").write_text("99999999", encoding="utf-8")
    (tmp_path / "e.csv").write_text("", encoding="utf-8")
    lines = read_id_files(spark, str(tmp_path))
    cells = parse_id_lines(lines, keep=["file_path"]).collect()
    by = {}
    for r in sorted(cells, key=lambda r: (r["file_path"], r["pos"])):
        by.setdefault(r["file_path"].rsplit("/", 1)[-1], []).append(r["raw_id"])
    assert by["a.csv"] == ["12345678", "87654321", "55555", "44444"]
    assert by["b.csv"] == ["12345678", "87654321"]
    assert by["c.txt"] == ["12345678", "87654321"]
    assert "d.pdf" not in by and "e.csv" not in by


def test_quoted_cells_blanks_and_long_lines(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"12345678", "P""1" ,"a\nb"\n\u00a087654321\u00a0,"x,y"\n', encoding="utf-8")
    (tmp_path / "t.TXT").write_text("no", encoding="utf-8")
    (tmp_path / "t.txt").write_text('12345, 67890\n"55555"\n', encoding="utf-8")
    rows = parse_id_lines(read_id_files(spark, str(tmp_path)), keep=["file_path"]).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["file_path"], r["pos"])):
        by.setdefault(r["file_path"].rsplit("/", 1)[-1], []).append(r["raw_id"])
    assert by == {"q.csv": ["12345678", 'P"1', "a\nb", "87654321", "x,y"], "t.txt": ["12345, 67890", '"55555"']}
    long = spark.createDataFrame([("b", 0, ",".join(["7"] * 150_001)), ("b", 1, "8")], "batch_id string, line_no int, value string")
    last = parse_id_lines(long, keep=["batch_id"]).orderBy("pos").collect()
    assert [r["raw_id"] for r in last[-2:]] == ["7", "8"] and len({r["pos"] for r in last}) == 150_002


def test_large_uploads_are_read_in_splits(spark, tmp_path):
    """Every line of every file, in order, whether it is one row or cut into blocks."""
    import random
    rng = random.Random(3)
    texts = {f"f{k}.{kind}": end.join(str(rng.randrange(10 ** rng.randrange(1, 12))) + rng.choice(["", ",7", "  ", ",,"]) for _ in range(3000)) + last
             for k, (kind, end, last) in enumerate([("csv", "\n", ""), ("csv", "\r\n", "\r\n"), ("txt", "\n", "\n\n"), ("csv", "\n\n", ",9")])}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(("\ufeff" + text).encode())
    (tmp_path / "empty.csv").write_text("")
    expect = {n: [c.strip() for line in t.splitlines() for c in ([line] if n.endswith("txt") else line.split(",")) if c.strip()] for n, t in texts.items()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        for whole in (1 << 20, 25_000, 0):
            got = {}
            for r in sorted(parse_id_lines(read_id_files(spark, str(tmp_path), whole_bytes=whole), keep=["file_path"]).collect(), key=lambda r: (r["file_path"], r["pos"])):
                got.setdefault(r["file_path"].rsplit("/", 1)[-1], []).append(r["raw_id"])
            assert got == expect
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")

def test_ids_end_where_the_text_ends(spark):
    values = ["12345\u2028", "\u00a012345\u00a0", "\u200512345", "12345\n", "P1\u2028x"]
    df = spark.createDataFrame([(v,) for v in values], "raw string")
    got = [r["ok"] for r in df.select(is_person_id(sanitize_id(F.col("raw"))).alias("ok")).collect()]
    assert got == [True, True, True, True, False]
    bare = spark.createDataFrame([("12345\u2028",)], "x string")
    assert bare.select(is_person_id(F.col("x")).alias("ok")).first()["ok"] is False
