import os
import time

from pyspark.sql import functions as F

from cauce import fixed
from cauce.operators.encode import FeatureEncoder
from cauce.streaming import jobs


def _persons(spark):
    rows = [("1", 30, 1.0, 700, 1, 2.0, 0.3, 20.0, "A", "0_DIAS", ["x"], ["educacion", "salud"], ["digital"], [], ["pareja"], None, "t1"),
            ("2", 40, 2.0, 600, 0, 1.0, 0.2, 30.0, "B", "30_DIAS", ["y"], None, ["presencial"], ["m"], [], ["c"], None)]
    schema = ("cedula string, edad int, ingresos double, score_datacredito int, num_creditos_activos int, "
              "deuda_total_acumulada_cop double, cuota_mensual_total_cop double, capacidad_endeudamiento_disponible_pct double, "
              "categoria_afiliacion string, mora_maxima_historica string, area_trabajo array<string>, intereses array<string>, "
              "preferencias array<string>, momentos_clave array<string>, composicion_familiar array<string>, "
              "historial_creditos array<string>, product_target string")
    return spark.createDataFrame(rows, schema)


def test_encoder_fit_transform_save_load(spark, tmp_path):
    df = _persons(spark)
    enc = FeatureEncoder().fit(df)
    out = enc.transform(df, keep=["cedula"])
    assert out.columns == ["cedula", "product_target", *enc.feature_names()]
    r = {x["cedula"]: x for x in out.collect()}
    assert r["1"]["categoria_afiliacion_A"] == 1.0 and r["2"]["categoria_afiliacion_A"] == 0.0
    assert r["2"]["mora_maxima_historica"] == 1.0 and r["1"]["intereses_salud"] == 1.0 and r["2"]["intereses_salud"] == 0.0
    unseen = df.withColumn("categoria_afiliacion", F.lit("Z"))
    u = enc.transform(unseen).collect()[0]
    assert u["categoria_afiliacion_A"] == 0.0 and u["categoria_afiliacion_B"] == 0.0
    path = str(tmp_path / "enc")
    enc.save(spark, path)
    again = FeatureEncoder.load(spark, path)
    assert again.vocab == enc.vocab
    assert set(fixed.NUMERIC_COLS) <= set(again.feature_names())


IDS = [f"100000{k:02d}" for k in range(1, 7)] + ["P0001", "P0002", "P0003", "99999999"]


def _run(spark, personas, tmp_path):
    q = jobs.run_campaign_stream(spark, str(tmp_path / "in"), personas, str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    return {t: spark.read.parquet(str(tmp_path / "out" / t)).collect() for t in ("batches", "results", "outbox")}


def test_stream_campaign(spark, personas, tmp_path):
    """Old files, re-sent files and files below the gate; a replay changes nothing."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "u1.csv").write_text("\ufeff" + ",".join(IDS[:5]) + "\r\n" + '"10000006", "P0001"\n' + ",".join(IDS[7:]) + "\n", encoding="utf-8")
    (inbox / "small.csv").write_text(",".join(IDS[:9]), encoding="utf-8")
    first = _run(spark, personas, tmp_path)
    assert sorted((r["gate"], r["count"]) for r in first["batches"]) == [("accepted", 10), ("too_small", 9)]
    status = [r["result_status"] for r in first["results"]]
    assert {s: status.count(s) for s in set(status)} == {"processed": 8, "no_offer": 1, "person_not_found": 1}
    assert len(first["outbox"]) == 8
    time.sleep(1.1)
    (inbox / "u1_again.csv").write_bytes((inbox / "u1.csv").read_bytes())  # same content, other name
    old = inbox / "old.txt"
    old.write_text("\n".join([*IDS[:9], "P0004"]), encoding="utf-8")
    os.utime(old, (time.time() - 30 * 86400,) * 2)
    second = _run(spark, personas, tmp_path)
    assert len(second["batches"]) == 3 and len(second["results"]) == 20 and len(second["outbox"]) == 8 + 9
    again = jobs.run_campaign_stream(spark, str(inbox), personas, str(tmp_path / "out"), checkpoint=str(tmp_path / "ck2"))  # replay of everything
    again.awaitTermination()
    assert {t: spark.read.parquet(str(tmp_path / "out" / t)).count() for t in second} == {t: len(v) for t, v in second.items()}
    done = jobs.progress(spark, str(tmp_path / "out")).collect()
    assert [(r["finished"], r["total"], r["progress"]) for r in done] == [(10, 10, 1.0)] * 2


def test_stream_keeps_large_uploads(spark, personas, tmp_path):
    """Padded and quoted cells are read, and files beyond the bound of one row, in splits."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "padded.csv").write_text("\n".join(f'"{i}"' + " " * 120_000 for i in IDS), encoding="utf-8")
    (inbox / "quoted.csv").write_text("\n".join(f'"{i}",' + '" ",' * 40_000 for i in reversed(IDS)), encoding="utf-8")
    (inbox / "beyond one.csv").write_text("\r\n".join(["P0006," + "," * 300_000, *IDS[:9]]), encoding="utf-8")
    (inbox / "beyond.txt").write_text("12345678\n" * 40_000 + "1" * 70_000_000, encoding="utf-8")  # above 64 MiB too
    assert all(f.stat().st_size > 300_000 for f in inbox.iterdir())
    for _ in range(2):  # a replay changes nothing
        q = jobs.run_campaign_stream(spark, str(inbox), personas, str(tmp_path / "out"), checkpoint=str(tmp_path / f"ck{_}"), max_bytes=250_000)
        q.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out" / "batches")).collect()
        assert sorted((r["gate"], r["raw_count"], r["count"]) for r in rows) == [("accepted", 10, 10)] * 3 + [("too_many_raw", 40_001, 1)]
        assert len(rows) == 4 and spark.read.parquet(str(tmp_path / "out" / "results")).count() == 30
