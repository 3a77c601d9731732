import json

import numpy as np
import pytest

from loomspan.__main__ import main
from loomspan.operators import metrics
from loomspan.service import Service
from loomspan.sources import files, synthetic
from pyspark.sql import functions as F


def test_requests_and_their_answers(spark, tmp_path):
    s = Service(spark, str(tmp_path))
    assert s.handle("GET", "/health") == (200, {"status": "ok"}) and s.handle("GET", "/")[1]["indexes"] == 0
    assert s.handle("POST", "/indexes", {"name": "i", "dimension": 2, "metric": "euclidean"})[0] == 200
    assert s.handle("POST", "/indexes", {"name": "i", "dimension": 2})[0] == 409
    for bad in ({"name": "a/b", "dimension": 2}, {"name": "j", "dimension": 0}, {"name": "j", "dimension": 2, "metric": "taxi"}, {"name": "j"}, {"name": "j", "dimension": 2, "x": 1}, []):
        assert s.handle("POST", "/indexes", bad)[0] == 400
    rows = [{"id": "a", "values": [0, 0], "metadata": {"color": "red", "n": 5}}, {"id": "b", "values": [1, 0], "metadata": {"color": "blue"}}, {"id": "a", "values": [0, 1], "metadata": {"color": "red", "n": 7}}]
    assert s.handle("POST", "/indexes/i/upsert", {"vectors": rows}) == (200, {"upserted": 2})
    assert s.handle("POST", "/indexes/i/upsert", {"vectors": [{"id": "c", "values": [1]}]})[0] == 400
    assert s.handle("POST", "/indexes/i/upsert", {"vectors": [{"id": "c", "values": ["x", 1]}]})[0] == 400
    got = s.handle("POST", "/indexes/i/query", {"vector": [0, 1], "top_k": 5, "include_values": True})[1]["matches"]
    assert [(m["id"], m["score"], m["values"]) for m in got] == [("a", 0.0, [0.0, 1.0]), ("b", 2.0, [1.0, 0.0])]
    got = s.handle("POST", "/indexes/i/query", {"vector": [0, 1], "filter": {"n": {"$gte": 6}}, "include_metadata": False})[1]["matches"]
    assert got == [{"id": "a", "score": 0.0}]
    assert s.handle("POST", "/indexes/i/query", {"vector": [0, 1, 2]})[0] == 400
    assert s.handle("POST", "/indexes/none/query", {"vector": [0, 1]})[0] == 404
    assert set(s.handle("POST", "/indexes/i/fetch", {"ids": ["a", "zz"]})[1]["vectors"]) == {"a"}
    assert s.handle("GET", "/indexes/i/stats")[1]["namespaces"]["default"]["vectors"] == 2
    assert s.handle("POST", "/indexes/i/delete", {"ids": ["a", "zz"]}) == (200, {"deleted": 1})
    assert s.handle("POST", "/indexes/i/vacuum")[0] == 200
    assert s.handle("GET", "/indexes")[1]["indexes"][0]["namespaces"] == ["default"]
    assert s.handle("DELETE", "/indexes/i")[0] == 200 and s.handle("GET", "/indexes/i")[0] == 404 and s.handle("PUT", "/x")[0] == 404


def test_verbs(spark, tmp_path, capsys):
    at = lambda x: str(tmp_path / x)
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    main(["compress", at("t.csv"), at("packed")], spark)
    main(["decompress", at("packed"), at("back")], spark)
    assert sorted(map(tuple, spark.read.parquet(at("back")).collect())) == [(1, "x"), (2, "y")]
    np.save(tmp_path / "a.npy", np.ones((2, 3), np.float32))
    main(["compress", at("a.npy"), at("files")], spark)
    main(["decompress", at("files"), (tmp_path / "out").as_uri()], spark)
    assert np.load(tmp_path / "out" / "a.npy").sum() == 6
    windows = synthetic.domain(spark, "waves", 40, 1).select(F.col("series").alias("win_id"), "values")
    windows.write.parquet(at("w"))
    main(["train", at("w"), at("m"), "--steps", "32", "--features", "4", "--patch", "8"], spark)
    main(["encode", at("w"), at("m"), at("e")], spark)
    main(["decode", at("e"), at("m"), at("d")], spark)
    assert sorted(map(tuple, spark.read.parquet(at("d")).collect())) == sorted(map(tuple, windows.collect()))
    main(["decode", at("e"), at("m"), at("s"), "--tier", "search"], spark)
    assert spark.read.parquet(at("s")).count() == 40
    files.write_container(windows.withColumnRenamed("values", "coordinates"), at("c"), key="win_id")
    capsys.readouterr()
    main(["info", at("c")], spark)
    assert json.loads(capsys.readouterr().out)["rows"] == 40
    for verb in (["search", at("e"), at("m"), "--window", "3"], ["stats", at("e"), at("m")], ["ratio", at("t.csv")], ["benchmark", "--suite", "finance", "--series", "1", "--windows", "1", "--modes", "lossless,quantized_8", "--html", at("r.html")]):
        main(verb, spark)
        assert capsys.readouterr().out.count("|") > 5
    assert "<td>gold</td>" in (tmp_path / "r.html").read_text()
    with pytest.raises(SystemExit):
        main(["nothing"], spark)


def test_losses_and_schedules(spark):
    assert [metrics.warmed(s, 4, 2.0) for s in (0, 1, 4, 9)] == [0, 0.5, 2, 2] and metrics.warmed(0, 0) == 1
    rate = [metrics.learning_rate(s, 100, 10, 1.0, 0.1) for s in range(100)]
    assert rate[0] == 0.1 and max(rate) == 1.0 and rate[9:] == sorted(rate[9:], reverse=True) and rate[-1] > 0.1
    df = spark.createDataFrame([(1.0, 3.0, 1.0), (2.0, 2.5, 3.0)], "x double, y double, w double")
    error = F.col("x") - F.col("y")
    assert metrics.weighted_loss(df, error, F.col("w")).first().loss == pytest.approx((4 + 3 * 0.25) / 4)
    assert metrics.weighted_loss(df, error, F.col("w"), "huber").first().loss == pytest.approx((1.5 + 3 * 0.125) / 4)
    with pytest.raises(ValueError):
        metrics.weighted_loss(df, error, F.col("w"), "log")
    rows = [([1.0, 2.0, 4.0, 1.0], [1.0, 2.0, 3.0, 1.0]), (None, [1.0]), ([], [])]
    d = abs(np.fft.rfft(rows[0][0])) - abs(np.fft.rfft(rows[0][1]))
    assert metrics.spectral_mse(spark.createDataFrame(rows, "a array<double>, b array<double>"), "a", "b").first().mse == pytest.approx((d * d).mean())
    sizes = [r[0] for r in spark.createDataFrame([(n,) for n in (5, 2048, 3 << 20, 5 << 40)], "n long").select(metrics.human_bytes(F.col("n"))).collect()]
    assert sizes == ["5 B", "2.0 KB", "3.0 MB", "5.0 TB"]
