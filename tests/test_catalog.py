import duckdb
import pytest

from loomspan.plans import catalog


def same(spark, sf, name):
    """Rows of a registered query, after they are held against its SQL twin."""
    with duckdb.connect() as db:
        for t in ("embeddings", "events"):
            db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = db.sql(catalog.ORACLES[name])
        names, rows = want.columns, want.fetchall()
    got = [tuple(r) for r in catalog.QUERIES[name](spark, sf).select(*names).collect()]
    assert len(got) == len(rows) > 0

    def key(r):
        return [x for x in r if isinstance(x, int)]

    for g, w in zip(sorted(got, key=key), sorted(rows, key=key), strict=True):
        assert key(g) == key(w)
        for x, y in zip(g, w, strict=True):
            assert x == pytest.approx(y, abs=2e-4)
    return got


@pytest.fixture(scope="module")
def vector_table(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, [float((i * k) % 17 + k) for k in (1, 3, 5)], i % 3) for i in range(450)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{sf}/e")
    _one(sf, "e", "embeddings")
    spark.createDataFrame([(0, 0)], "event_id long, user_id long").coalesce(1).write.parquet(f"{sf}/v")
    _one(sf, "v", "events")
    return sf


def _one(sf, folder, name):
    from pathlib import Path

    next(Path(sf, folder).glob("*.parquet")).rename(f"{sf}/{name}.parquet")


@pytest.mark.parametrize("name, n", [("pairwise_distances", 5 * 450), ("lerp_path", 449 * 5), ("slerp_path", 449 * 5), ("multi_point_path", 3 * (149 * 4 + 1))])
def test_queries_over_all_embeddings(spark, vector_table, name, n):
    assert len(same(spark, vector_table, name)) == n


@pytest.mark.parametrize("name", ["slerp_path", "lerp_path", "vec_add", "vec_sub", "vec_analogy"])
def test_pairs_of_odd_vectors_agree_to_the_bit(spark, tmp_path, name):
    pairs = [
        ([0.0, 0.0, 0.0], [1.0, 2.0, 3.0]),
        ([1.0, 2.0, 3.0], [0.0, 0.0, 0.0]),
        ([1e-4, -2e-4, 3e-4], [0.0, 1e-4, 3e-4]),
        ([0.0, -8e-9, 8e-9], [0.25, -0.0, 0.5]),
        ([-0.0, -1e-7, 0.0], [-0.0, 1e-8, 1e-7]),
        ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]),
        ([1.0, 2.0, 3.0], [2.0, 4.0, 6.0]),
        ([5e6, 1.57, 5.5e11], [6.4e11, 1.51, -0.01]),
        ([1.0, 2.0, 3.0], None),
        (None, [1.0, 2.0, 3.0]),
        ([], []),
    ]
    rows = [(3 * i + j, v, 0) for i, pair in enumerate(pairs) for j, v in enumerate(pair)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/e")
    _one(tmp_path, "e", "embeddings")
    with duckdb.connect() as db:
        db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
        want = db.sql(catalog.ORACLES[name])
        names, want = want.columns, want.fetchall()
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select(*names).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_windows_of_a_hot_user_keep_ids_of_their_own(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    rnd, start = random.Random(4), datetime(2024, 1, 1)
    users = [1] * 4100 + [2] * 40
    rows = [(i, start + timedelta(seconds=i), u, "view", rnd.uniform(1, 100)) for i, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/v")
    _one(tmp_path, "v", "events")
    spark.createDataFrame([(0, [0.0], 0)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/e")
    _one(tmp_path, "e", "embeddings")
    got = same(spark, tmp_path, "window_features_search")
    assert len({(r[0], r[1]) for r in got}) == len(got) == 5 * (11 + 1)


def test_8_bit_values_agree_to_the_last_digit(spark, tmp_path):
    from datetime import datetime, timedelta

    start, values = datetime(2024, 1, 1), [(i * 7919 % 100_003) / 179 for i in range(16_000)]
    rows = [(i, start + timedelta(seconds=i), i % 10, "view", x) for i, x in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/v")
    _one(tmp_path, "v", "events")
    with duckdb.connect() as db:
        db.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
        want = db.sql(f"select user_id, win_id, v from ({catalog.ORACLES['quantized_8_values']})").fetchall()
    got = catalog.QUERIES["quantized_8_values"](spark, str(tmp_path)).select("user_id", "win_id", "v").collect()
    assert sorted(map(tuple, got)) == sorted(want)
