import datetime
import decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import codes, frames, tiers


@pytest.mark.parametrize("mode", codes.MODES)
@pytest.mark.parametrize("most", [7, 256, 5000])
def test_codes_come_back(mode, most):
    rng = np.random.default_rng(most)
    top, bottom = rng.integers(0, most, 30), rng.integers(0, most, (30, 4, 3))
    back = codes.unpack_codes(codes.pack_codes(top, bottom, mode))
    assert (back[0] == top).all() and (back[1] == bottom).all()
    assert len(codes.pack_codes(top, bottom)) <= len(codes.pack_codes(top, bottom, "grouped"))
    with pytest.raises(ValueError):
        codes.pack_codes(top - most, bottom)


def test_code_figures():
    top, bottom = np.array([0, 0, 1, 1]), np.zeros((4, 2, 2), np.int64)
    got = codes.code_stats(top, bottom, 100)
    assert got["top_bits"] == 1 and got["level_bits"] == [0, 0] and got["plain_bytes"] == 5
    assert got["entropy_bytes"] == pytest.approx(1 / 8) and got["best_bytes"] * 4 == min(got["flat_size"], got["grouped_size"], got["optimal_size"])


@pytest.fixture(scope="module")
def coded(spark):
    rng = np.random.default_rng(1)
    shapes = rng.normal(size=(4, 16, 2)).cumsum(axis=1)
    rows = [(i, (shapes[i % 4] * rng.uniform(1, 9) + rng.uniform(-50, 50) + rng.normal(size=(16, 2)) * 0.05).astype(np.float32).ravel().tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "win_id long, values array<float>").repartition(3)
    return df, rows, tiers.fit(df, 16, 2, 4, top_codes=4, codes=8, levels=2)


def test_both_tiers_give_windows_back(spark, coded, tmp_path):
    df, rows, model = coded
    odd = df.unionByName(spark.createDataFrame([(900, [1.0]), (901, None)], "win_id long, values array<float>"))
    search, storage = tiers.tiered(odd, model)
    near = {r.win_id: r["values"] for r in tiers.decode_search(search, model).collect()}
    assert set(near) == {i for i, _ in rows}
    error = [np.sqrt(np.mean((np.array(near[i]) - v) ** 2)) / np.ptp(v) for i, v in rows]
    assert max(error) < 0.1
    exact = {r.win_id: r["values"] for r in tiers.decode_lossless(tiers.encode_lossless(odd, model), model).collect()}
    assert exact == dict(rows)
    stats = tiers.tier_stats(search, storage.filter("win_id < 900"), model).first()
    assert stats.n_windows == 120 and stats.raw_bytes == 120 * 128 and stats.search_ratio > stats.storage_ratio > stats.total_ratio
    model.save(spark, f"{tmp_path}/m")
    again = tiers.Model.load(spark, f"{tmp_path}/m")
    assert tiers.encode(df, again).orderBy("win_id").collect() == tiers.encode(df, model).orderBy("win_id").collect()


def test_windows_are_found_by_their_codes(coded):
    df, rows, model = coded
    search = tiers.encode(df, model)
    for by in ("codes", "values"):
        got = tiers.search(search, search.filter("win_id < 3"), model, 1, by).collect()
        assert len(got) == 3 and all(r.score == 0 for r in got)
    top = {r.win_id: r.top for r in search.collect()}
    assert len({top[i] for i in range(4)}) == 4 and all(top[i] == top[i % 4] for i in range(120))


def test_encoding_by_brute_force(coded):
    df, rows, model = coded
    for r in tiers.encode(df, model).filter("win_id < 10").collect():
        x = np.array(rows[r.win_id][1], np.float64).reshape(16, 2)
        z = (x - x.mean(axis=0)) / np.sqrt(x.var(axis=0) + 1e-5)
        assert r.top == min(range(len(model.top)), key=lambda c: ((z.ravel() - model.top[c]) ** 2).sum())
        rest = (z.ravel() - model.top[r.top]).reshape(4, 8)
        for p in range(4):
            left = rest[p]
            for level, book in enumerate(model.levels):
                assert r.bottom[p][level] == min(range(len(book)), key=lambda c: ((left - book[c]) ** 2).sum())
                left = left - book[r.bottom[p][level]]
    masked = model.decode(np.array([-1]), np.full((1, 4, 2), -1), np.zeros((1, 2), np.float32), np.ones((1, 2), np.float32))
    assert not masked.any()


def test_frames_keep_types_and_nulls(spark, tmp_path):
    kind = "a long, b double, c float, d string, e date, f timestamp, g boolean, h array<int>, i decimal(10,2), j short, k binary"
    rows = [(i, i / 7, i / 3, f"s{i}", datetime.date(2020, 1, 1 + i), datetime.datetime(2020, 1, 1, i), i % 2 == 0, [i, None], decimal.Decimal(i) / 4, i, bytes([i])) for i in range(20)]
    df = spark.createDataFrame([*rows, (None,) * 11, rows[3]], kind).repartition(3)
    made = frames.compress_frame(df)
    back = frames.decompress_frame(made, df.schema)
    assert back.schema == df.schema and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    frames.write_frame(df, f"{tmp_path}/f")
    assert frames.read_frame(spark, f"{tmp_path}/f").count() == 22
    assert frames.decompress_frame(frames.compress_frame(df.limit(0)), df.schema).count() == 0
    assert frames.numeric_columns(df).columns == ["a", "b", "c", "i", "j"]
    steady = spark.range(20_000).select("id", (F.col("id") % 5).alias("x"))
    assert frames.frame_ratio(steady).first().ratio > 20
    assert {r.column for r in frames.frame_ratio(steady, by_column=True).collect()} == {"id", "x"}
