import pytest
from pyspark.sql import functions as F

from loomspan.operators import entropy, mining, paths, quantise, series, similarity, store, transforms
from loomspan.operators.filters import compile_filter


def test_nearest_is_the_vector_itself_and_ties_go_to_the_smaller_id(spark):
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, v array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, q array<double>")
    assert [r.id for r in similarity.knn(v, q, 2, "cosine").orderBy("rnk").collect()] == [1, 2]
    with pytest.raises(ValueError):
        similarity.knn(v, q, 2, "taxi")


def test_filters_fail_rows_without_the_field_and_reject_unknown_operators(spark):
    rows = spark.createDataFrame([("a", "red"), ("b", None), ("c", "blue")], "id string, color string")
    assert [r.id for r in rows.filter(compile_filter({"color": {"$ne": "red"}})).collect()] == ["c"]
    with pytest.raises(ValueError):
        compile_filter({"color": {"$like": "r"}})


def test_store_round_trip(spark, tmp_path):
    s = store.VectorStore(spark, str(tmp_path))
    s.create_index("i", 2)
    rows = [("x", [1.0, 0.0], {"color": "red"}, 1), ("y", [0.0, 1.0], {"color": "blue"}, 2), ("x", [1.0, 1.0], {"color": "red"}, 3)]
    kind = "id string, values array<float>, metadata map<string,string>, seq int"
    s.upsert("i", spark.createDataFrame(rows, kind))
    q = spark.createDataFrame([(0, [1.0, 1.0])], "qid long, q array<double>")
    assert [r.id for r in s.query("i", q, 1).collect()] == ["x"]
    assert s.query("i", q, 2, where={"color": "blue"}).first().id == "y"
    with pytest.raises(ValueError):
        s.upsert("i", spark.createDataFrame([("z", [1.0], None, 1)], kind))
    assert s.delete("i", ["x", "none"]) == 1
    assert [r.id for r in s.vectors("i").collect()] == ["y"]
    s.delete_index("i")
    assert s.list_indexes() == []


def test_store_versions_survive_other_writers(spark, tmp_path):
    s = store.VectorStore(spark, str(tmp_path))
    s.create_index("i", 1, "euclidean")
    kind = "id string, values array<float>, metadata map<string,string>, seq int"
    rows = lambda ids, x: spark.createDataFrame([(i, [float(x)], None, 1) for i in ids], kind)
    s.upsert("i", rows(map(str, range(40)), 1), "a")
    before = s.vectors("i", "a")
    s.upsert("i", rows(["3", "x"], 2), "a")
    assert before.count() == 40 and s.vectors("i", "a").count() == 41  # a running reader keeps its version
    assert s.fetch("i", ["3", "4"], "a").orderBy("id").select("values").collect()[0][0] == [2.0]
    held = s._version
    s._version = lambda *a: (held(*a)[0] - 1, held(*a)[1])  # a writer that read the version before
    with pytest.raises(RuntimeError):
        s.upsert("i", rows(["y"], 3), "a")
    s._version = held
    s.vacuum("i", "a")
    assert s.vectors("i", "a").count() == 41 and s.namespaces("i") == ["a"]
    assert {(r.namespace, r.vectors) for r in s.stats("i").collect()} == {("a", 41), (None, 41)}
    same = spark.createDataFrame([("q", [1.0], None, 1), ("q", [2.0], None, 1)], kind)
    assert store.upsert(s.vectors("i", "a"), same).filter("id = 'q'").first()["values"] == store.upsert(s.vectors("i", "a"), same.orderBy("values")).filter("id = 'q'").first()["values"]


def test_search_by_matrix_equals_pairs(spark):
    import random

    rnd = random.Random(1)
    v = [(i, [float(rnd.randint(-3, 3)) for _ in range(4)], i % 3) for i in range(300)] + [(900, None, 1)]
    q = [(i, v[i][1]) for i in range(0, 300, 29)]
    vectors = spark.createDataFrame(v, "id long, v array<double>, label int").repartition(3)
    queries = spark.createDataFrame(q, "qid long, q array<double>")
    size = lambda a: sum(x * x for x in a) ** 0.5
    for metric, score in (("euclidean", lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))), ("dotproduct", lambda a, b: -sum(x * y for x, y in zip(a, b))), ("cosine", lambda a, b: -sum(x * y for x, y in zip(a, b)) / (size(a) * size(b) + 1e-10))):
        want = {i: [k for _, k in sorted((round(score(a, b), 9), k) for k, b, _ in v if b)[:7]] for i, a in q}
        got = {}
        for r in similarity.knn(vectors, queries, 7, metric).orderBy("qid", "rnk").collect():
            got.setdefault(r.qid, []).append(r.id)
            assert r.label == r.id % 3
        assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()} or metric == "cosine"
        assert all(len(x) == 7 for x in got.values())
    near = {(r.qid, r.id) for r in similarity.within(vectors, queries, 3.0).collect()}
    assert near == {(i, k) for i, a in q for k, b, _ in v if b and sum((x - y) ** 2 for x, y in zip(a, b)) < 9}
    assert similarity.pairwise(queries.toDF("id", "v"), vectors).count() == len(q) * 300


def test_windows_of_a_series(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "k int, t int, x double")
    got = series.sliding_windows(rows, ["k"], ["t"], "x", 4, 3).orderBy("win_id").collect()
    assert [r["values"][0] for r in got] == [0.0, 3.0, 6.0]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_integer_differences_invert(spark, order):
    values = [2**31 - 1, -(2**31), 0, 5, -7, 123456789, -1]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(values)], "k int, t int, x long")
    d = transforms.with_delta(rows, ["k"], ["t"], "x", order).select("k", "t", "d")
    back = transforms.undelta(d, ["k"], ["t"], "d", order).orderBy("t").collect()
    assert [r.x for r in back] == values


def test_elbow_and_paths(spark):
    inertia = spark.createDataFrame([(1, 100.0), (2, 30.0), (3, 25.0), (4, 22.0)], "k int, inertia double")
    assert series.elbow(inertia).first().k == 2
    pair = spark.createDataFrame([([0.0], [2.0])], "a array<double>, b array<double>")
    assert [r.p for r in paths.path(pair, 3).orderBy("step").collect()] == [[0.0], [1.0], [2.0]]


def test_entry_registers_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "knn_cosine" in e.queries()


def test_runs_shorter_than_asked_are_dropped(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate("aabaa")], "k int, t int, s string")
    got = series.regimes(rows, ["k"], ["t"], "s", 2).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0, 2), (3, 5)]
    assert rows.filter(F.col("s") == "b").count() == 1


def test_density_clusters_by_brute_force(spark):
    import random

    rnd = random.Random(2)
    points = [(i, [0.9 * i, 0.0]) for i in range(120)]  # a chain of neighbours
    points += [(1000 + i, [rnd.uniform(0, 30), rnd.uniform(20, 40)]) for i in range(150)]
    df = spark.createDataFrame(points, "id long, v array<double>").repartition(3)
    for eps, least in ((1.0, 3), (1.6, 4)):
        near = {i: [j for j, b in points if (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= eps * eps] for i, a in points}
        core, label = {i for i, x in near.items() if len(x) >= least}, {}
        for i in sorted(core):
            if i not in label:
                todo = [i]
                while todo:
                    j = todo.pop()
                    if j not in label:
                        label[j] = i
                        todo += [k for k in near[j] if k in core]
        want = {i: label[i] if i in core else min((label[j] for j in near[i] if j in core), default=-1) for i, _ in points}
        got = {r.id: r.label for r in mining.dbscan(df, eps, least).collect()}
        assert got == want
    assert len({got[i] for i in range(120)}) == 1
    centres = {r.label for r in mining.cluster_centres(df, mining.dbscan(df, 1.0, 3)).collect()}
    assert -1 not in centres and mining.inertia(df, mining.dbscan(df, 1.0, 3)).first().inertia > 0


def test_mining_finds_what_was_put_in(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, [10.0 * (i % 3) + rnd.gauss(0, 0.1), 5.0 * (i % 3) + rnd.gauss(0, 0.1), rnd.gauss(0, 0.01)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got, total = mining.kmeans(df, 3, seeds=2)
    assert [r.label for r in got.orderBy("id").collect()] == [i % 3 for i in range(300)] and total < 20
    assert mining.inertia(df, got.select("id", "label")).first().inertia == pytest.approx(total, rel=1e-6)
    bend = mining.inertias(df, [2, 3, 4, 5])
    assert series.elbow(bend).first().k == 3
    axes = mining.fit_projection(df, 0.99)
    assert len(axes.axes) == 1
    near = df.select("v", axes.project(F.col("v")).alias("z")).select("v", axes.restore(F.col("z")).alias("w")).select(F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x).alias("e"))
    assert near.agg(F.max("e")).first()[0] < 0.5
    odd = df.union(spark.createDataFrame([(999, [200.0, -90.0, 4.0])], "id long, v array<double>"))
    scores = mining.isolation(odd, trees=20, sample=64)
    assert scores.orderBy(F.desc("score")).first().id == 999 and scores.filter("score <= 0 or score > 1").count() == 0
    spread = mining.scaled_isolation(scores)
    assert spread.agg(F.max("score"), F.min("score")).first()[1] == 0
    both = {r.id: r for r in mining.combined({"a": spread, "b": spread.withColumn("score", F.lit(0.0))}).collect()}
    assert both[999].score == pytest.approx(0.5, abs=1e-6) and both[999].flag == 0


def test_residual_quantisation_by_brute_force(spark):
    books = [[[0.0, 0.0], [10.0, 0.0]], [[1.0, 1.0], [-1.0, 1.0], [1.0, 1.0]]]
    rows = [(0, [9.0, 2.0]), (1, [1.0, 1.0]), (2, [5.0, 0.0])]
    frames = [spark.createDataFrame(list(enumerate(b)), "code int, cv array<double>") for b in books]
    for r in quantise.residual(spark.createDataFrame(rows, "id int, v array<double>"), frames).collect():
        rest, total = rows[r.id][1], [0.0, 0.0]
        for level, book in enumerate(books):
            code = min(range(len(book)), key=lambda c: (sum((x - y) ** 2 for x, y in zip(rest, book[c])), c))
            assert r[f"code_{level}"] == code
            rest, total = [x - y for x, y in zip(rest, book[code])], [x + y for x, y in zip(total, book[code])]
        assert r.approx == total


def test_probed_search_finds_nearly_all(spark):
    import random

    rnd = random.Random(4)
    centres = [[rnd.uniform(-50, 50) for _ in range(4)] for _ in range(12)]
    rows = [(i, [c + rnd.gauss(0, 1) for c in centres[i % 12]]) for i in range(1200)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.filter("id % 40 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    exact = similarity.knn(v, q, 10, "euclidean")
    assert similarity.recall(similarity.knn_probed(v, q, 10, 12, 3), exact, 10).first().recall >= 0.9
    assert similarity.recall(exact, exact, 10).first().recall == 1.0


def test_uniformity_of_counts_whose_squares_pass_64_bits(spark):
    c = [4_000_000_000 if i == 32 else 60_000_000 + i for i in range(256)]
    n, q = sum(c), sum(x * x for x in c)
    got = entropy.counted_uniformity(spark.createDataFrame(list(enumerate(c)), "s int, c long")).first()
    assert got.n == n and got.chi2 == pytest.approx(q * 256 / n - n, rel=1e-12) and got.p_value == 0.0
    few = spark.createDataFrame([(s,) for s in (0, 0, 1)], "s int")
    assert entropy.uniformity(few).first().chi2 == pytest.approx(5 * 256 / 3 - 3)
    none = entropy.counted_uniformity(entropy.byte_counts(spark.createDataFrame([("",), (None,)], "text string"), "text")).first()
    assert (none.chi2, none.n) == (None, None)


@pytest.mark.parametrize("what", ["pairwise", "within", "knn"])
def test_search_holds_a_bounded_number_of_pairs(spark, monkeypatch, what):
    import tracemalloc

    df = spark.range(10_000).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: F.sin(F.col("id") * j)).alias("v"))
    asked, held = df.filter("id < 256"), []
    kind = type(df)
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a: (held.append(f), own(self, f, *a))[1])
    q = asked.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    {"pairwise": lambda: similarity.pairwise(asked, df), "within": lambda: similarity.within(df, q, 100.0), "knn": lambda: similarity.knn(df, q, 5, "euclidean")}[what]()
    batch = df.toArrow().combine_chunks().to_batches()[0]
    tracemalloc.start()
    rows = sum(b.num_rows for b in held[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 256 * (5 if what == "knn" else 10_000) and peak < 60e6


def test_search_far_from_the_origin(spark):
    v = spark.createDataFrame([(i, [1e8 + 1.5 * i, -1e8]) for i in range(60)], "id long, v array<double>")
    q = v.filter("id % 7 = 3").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    got = {(r.qid, r.rnk): (r.id, r.score) for r in similarity.knn(v, q, 3, "euclidean").collect()}
    for i in range(3, 60, 7):
        want = sorted((2.25 * (i - j) ** 2, j) for j in range(60))[:3]
        assert [got[i, r + 1] for r in range(3)] == [(j, d) for d, j in want]


def test_probed_search_is_exact_within_its_cells(spark):
    import random

    rnd = random.Random(5)
    rows = [(i, [rnd.randint(-9, 9) + 0.0 for _ in range(3)]) for i in range(700)] + [(900, None)]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    q = v.filter("id % 30 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    rows_of = lambda df: sorted((r.qid, r.rnk, r.id, r.score) for r in df.collect())
    assert rows_of(similarity.knn_probed(v, q, 5, 6, 6)) == rows_of(similarity.knn(v, q, 5, "euclidean"))
    assert rows_of(similarity.knn_probed(v, q, 5, 6, 1)) != rows_of(similarity.knn(v, q, 5, "euclidean"))


def test_density_clusters_write_no_more_than_points(spark, monkeypatch):
    sizes = []
    own = mining.materialize
    monkeypatch.setattr(mining, "materialize", lambda df, name: (sizes.append((name, own(df, name).count())), own(df, name))[1])
    df = spark.createDataFrame([(i, [(i % 40) / 100, (i // 40) / 100]) for i in range(800)] + [(900, None), (901, [0.5, 0.5, 0.5])], "id long, v array<double>")
    got = {r.id: r.label for r in mining.dbscan(df, 1.0, 5).collect()}
    assert got == {**{i: 0 for i in range(800)}, 900: -1, 901: -1}
    assert sizes and max(n for _, n in sizes) <= 802


def test_projections_are_matrices_and_keep_nulls(spark):
    axes = mining.Projection((1.0, 2.0, 3.0), ((1.0, 0.0, 0.0), (0.0, 0.6, 0.8)))
    df = spark.createDataFrame([(0, [2.0, 2.0, 3.0]), (1, None), (2, [1.0, 7.0, 3.0])], "id int, v array<double>")
    z = df.select("id", "v", axes.project(F.col("v")).alias("z"))
    got = {r.id: (r.z, r.w) for r in z.select("id", "z", axes.restore(F.col("z")).alias("w")).collect()}
    assert got[0] == ([1.0, 0.0], [2.0, 2.0, 3.0]) and got[1] == (None, None)
    assert got[2][0] == pytest.approx([0.0, 3.0]) and got[2][1] == pytest.approx([1.0, 3.8, 5.4])
    assert "transform" not in z._jdf.queryExecution().executedPlan().toString()  # no element by element loop
