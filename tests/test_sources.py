import numpy as np
import pytest

from loomspan.operators import codec
from loomspan.sources import files, registry, synthetic
from loomspan.streaming import chunks


def test_prices_with_gaps_and_bad_numbers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date, Open,High ,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\n2024-01-03,1,2,,1.5,10\n2024-01-04,x,2,1,1.5,10\n")
    got = files.read_prices(spark, str(tmp_path / "p.csv"), "s").collect()
    assert len(got) == 1 and got[0].low == 0.5 and got[0].symbol == "s"
    one = files.read_prices(spark, str(tmp_path / "p.csv"))
    assert files.combine({"a": one, "b": one}).groupBy("symbol").count().count() == 2
    (tmp_path / "q.csv").write_text("Date,Open\n2024-01-02,1\n")
    with pytest.raises(ValueError):
        files.read_prices(spark, str(tmp_path / "q.csv"))


def test_npy_files_come_back(spark, tmp_path):
    made = np.arange(24, dtype=np.float64).reshape(2, 3, 4) / 7
    np.save(tmp_path / "a.npy", made)
    got = files.read_npy(spark, str(tmp_path / "a.npy")).first()
    assert got["shape"] == [2, 3, 4] and np.array_equal(np.float32(got["values"]), made.astype(np.float32).ravel())


def test_sound_is_cut_into_windows(spark, tmp_path):
    x = np.sin(np.arange(2500) / 9, dtype=np.float32).reshape(-1, 1)
    (tmp_path / "a.wav").write_bytes(files.to_wav(np.hstack([x, -x]), 8000))
    (tmp_path / "b.wav").write_bytes(files.to_wav(x[:10], 8000))
    rows = files.read_wav(spark, f"{tmp_path}/*.wav").collect()
    long = sorted((r for r in rows if r.path.endswith("a.wav")), key=lambda r: r.win_id)
    short = [r for r in rows if r.path.endswith("b.wav")]
    assert [r.win_id for r in long] == [0, 1] and np.allclose(np.concatenate([r["values"] for r in long]), x[:2048, 0], atol=1e-4)
    assert len(short) == 1 and short[0]["values"][10:] == [0.0] * 1014
    with pytest.raises(ValueError):
        files.wav_samples(files.to_wav(x, 8000)[:34] + b"\x18\0" + files.to_wav(x, 8000)[36:])


def test_synthetic_series_repeat(spark):
    assert files.swiss_roll(spark, 50).collect() == files.swiss_roll(spark, 50).collect()
    assert files.sine_series(spark, 3, 20, noise=0.0).filter("abs(value) > 1").count() == 0
    assert files.sine_series(spark, 3, 20).count() == 60


def test_tables_by_their_ending(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2.5\n")
    assert files.read_table(spark, str(tmp_path / "a.tsv")).first().asDict() == {"x": 1, "y": 2.5}
    spark.range(3).write.parquet(str(tmp_path / "b.parquet"))
    assert files.read_table(spark, str(tmp_path / "b.parquet")).count() == 3
    with pytest.raises(ValueError):
        files.read_table(spark, "x.xyz")


def test_pictures_come_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"p{c}.png", 4, 5, c, (rng.integers(0, 256, 20 * c) / 255).tolist()) for c in (1, 3, 4)]
    df = spark.createDataFrame(rows, "name string, height int, width int, channels int, values array<double>")
    assert files.write_images(df, f"{tmp_path.as_uri()}/out").count() == 3
    (tmp_path / "out" / "bad.png").write_bytes(b"no picture")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.read_images(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {"p1.png", "p3.png", "p4.png"}
    for name, h, w, c, values in rows:
        assert (got[name].height, got[name].width, got[name].channels) == (h, w, c)
        assert np.allclose(got[name]["values"], values, atol=1.01 / 255)


def test_files_are_packed_and_come_back(spark, tmp_path):
    a = np.random.default_rng(2).normal(size=(3, 8, 2)).astype(np.float32)
    np.save(tmp_path / "a.npy", a)
    (tmp_path / "b.txt").write_bytes(b"text " * 100)
    x = np.sin(np.arange(500) / 7).reshape(-1, 1)
    (tmp_path / "c.wav").write_bytes(files.to_wav(x, 8000))
    packed = files.compress_files(spark, f"{tmp_path}/*.*")
    assert {r.kind for r in packed.collect()} == {"npy", "raw", "wav 8000"}
    files.decompress_files(packed, f"{tmp_path.as_uri()}/out")
    assert np.array_equal(np.load(tmp_path / "out" / "a.npy"), a)
    assert (tmp_path / "out" / "b.txt").read_bytes() == b"text " * 100
    back = files.wav_samples((tmp_path / "out" / "c.wav").read_bytes())
    assert back[0] == 8000 and np.allclose(back[1], x, atol=2e-4)
    again = spark.createDataFrame([("d.npy", [2, 3], [1.0] * 6)], "name string, shape array<int>, values array<double>")
    files.write_arrays(again, f"{tmp_path.as_uri()}/out")
    assert np.load(tmp_path / "out" / "d.npy").shape == (2, 3)
    sound = spark.createDataFrame([("e.wav", 100, 2, [0.5] * 8)], "name string, rate int, channels int, values array<double>")
    files.write_sounds(sound, f"{tmp_path.as_uri()}/out")
    assert files.wav_samples((tmp_path / "out" / "e.wav").read_bytes())[1].shape == (4, 2)


def test_float_sound(tmp_path):
    x = np.array([[0.25, -0.5], [1.0, 0.0]], "<f4")
    head = b"fmt " + (16).to_bytes(4, "little") + np.array([3, 2], "<u2").tobytes() + np.array([100, 800], "<u4").tobytes() + np.array([8, 32], "<u2").tobytes()
    raw = b"RIFF" + (0).to_bytes(4, "little") + b"WAVE" + head + b"data" + (16).to_bytes(4, "little") + x.tobytes()
    rate, got = files.wav_samples(raw)
    assert rate == 100 and np.array_equal(got, x)


def test_containers_read_what_is_asked(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i)], 0.5, bytes([i])) for i in range(10)], "id long, coordinates array<double>, confidence double, blob binary")
    files.write_container(df, str(tmp_path / "c"), decoder="abc")
    assert files.read_header(spark, str(tmp_path / "c")) == {"key": "id", "blocks": ["coordinates", "confidence", "blob"], "rows": 10, "decoder": "abc"}
    got = files.read_container(spark, str(tmp_path / "c"), ["coordinates"], [3, 4, 99])
    assert got.columns == ["id", "coordinates"] and sorted(r.id for r in got.collect()) == [3, 4]
    assert "ReadSchema: struct<id:bigint,coordinates" in got._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        files.read_container(spark, str(tmp_path / "c"), ["codes"])


def test_chunk_lists_and_streams_of_values(spark):
    rows = [(k, i, float(10 * k + i)) for k in range(3) for i in range(9 + k)]
    df = spark.createDataFrame(rows, "k long, i int, x double")
    short = {r.key: r for r in chunks.rest(df, "k", ["i"], "x", 4).collect()}
    assert {k: (r.chunk, r["values"]) for k, r in short.items()} == {0: (2, [8.0]), 1: (2, [18.0, 19.0]), 2: (2, [28.0, 29.0, 30.0])}
    whole = [(k, c, [x for kk, i, x in rows if kk == k and i // 4 == c]) for k in range(3) for c in range(3)]
    made = chunks.encoded(spark.createDataFrame(whole, "key long, chunk int, values array<float>"))
    lists = files.chunk_lists(made, ["key"], "chunk")
    back = chunks.joined(chunks.decoded(files.listed_chunks(lists)))
    assert [tuple(r) for r in back.orderBy("key", "i").collect()] == sorted(rows)
    raw = files.pack_chunks([b"", b"abc"])
    assert files.unpack_chunks(raw) == [b"", b"abc"]
    with pytest.raises(ValueError):
        files.unpack_chunks(raw[:-1])


@pytest.mark.parametrize("name", synthetic.DOMAINS)
def test_every_domain_repeats_itself(spark, name):
    size = synthetic.DOMAINS[name][0]
    a = synthetic.domain(spark, name, 3, 2).collect()
    b = synthetic.domain(spark, name, 3, 2).repartition(2).collect()
    assert sorted(a) == sorted(b) and len(a) == 6 and all(len(r["values"]) % size == 0 and np.isfinite(r["values"]).all() for r in a)
    x = np.array(a[0]["values"], np.float32).reshape(size, -1)
    assert codec.decode(codec.encode(x, "lossless_fast")).tobytes() == x.tobytes()


def test_suites_manifolds_and_anomalies(spark):
    assert {r.domain for r in synthetic.suite(spark, "finance", 1, 1).select("domain").collect()} == set(synthetic.SUITES["finance"])
    v = np.array([r.v for r in synthetic.sine_manifold(spark, 60, 2, 20, 0.0).collect()])
    assert v.shape == (60, 20) and len(np.unique(v.round(9), axis=0)) == 60
    assert np.array([r.v for r in synthetic.folded_manifold(spark, 5).collect()]).shape == (5, 320)
    odd = synthetic.with_anomalies(spark, 50, 10, 3, 30)
    size = odd.selectExpr("label", "aggregate(v, 0d, (a, x) -> a + x * x) as s").groupBy("label").avg("s").collect()
    assert {r.label: r["avg(s)"] for r in size}[1] > 5 * {r.label: r["avg(s)"] for r in size}[0]
    calm = synthetic.domain(spark, "prices", 2, 3)
    crash = {(r.series, r.win_id): r["values"] for r in synthetic.with_crash(calm, 1, 2).collect()}
    for r in calm.collect():
        same = crash[r.series, r.win_id] == r["values"]
        assert same == ((r.series, r.win_id) != (1, 2))


def test_registries(spark, tmp_path):
    models = registry.Registry(spark, str(tmp_path / "models"))
    models.put("a", "finance", {"ratio": 3.5})
    models.put("b", "sound", {"ratio": 2.0})
    models.put("a", "finance", {"ratio": 4.0})
    assert models.names() == ["a", "b"] and models.get("a") == {"name": "a", "domain": "finance", "facts": {"ratio": "4.0"}}
    assert [r.name for r in models.list("sound").collect()] == ["b"]
    models.remove("b")
    assert models.names() == ["a"]
    with pytest.raises(KeyError):
        models.get("b")
    x = {"w": np.arange(6, dtype=np.float32).reshape(2, 3), "b": np.zeros(2, np.float32)}
    assert registry.parameters_hash(x) == registry.parameters_hash(dict(reversed(x.items()))) != registry.parameters_hash({**x, "b": np.ones(2, np.float32)})
