"""Every registered query of the array engine, with its SQL twin where SQL can say it.

Queries read whole tables. Where a search needs a stated query set, that set is named in the query: the embeddings whose
id is divisible by 100, or every hundredth window of a user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import bits as B
from loomspan.functions import vectors as V
from loomspan.operators import entropy as H
from loomspan.operators import codec, frames, mining, paths, quantise, series, similarity, store, tiers
from loomspan.operators import metrics as M
from loomspan.operators import transforms as T
from loomspan.operators.filters import compile_filter, from_metadata, to_metadata
from loomspan.sources import files
from loomspan.streaming import chunks
from loomspan.streaming.chunks import chunked, windowed
from loomspan.tables import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v"), "label")


def asked(v: DataFrame) -> DataFrame:
    """The stated query set: ids divisible by 100."""
    return v.filter("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


# ---- similarity search ----------------------------------------------------------------------------------------

_SCORES = {
    "cosine": ("list_cosine_similarity(q.embedding::double[], b.embedding::double[])", "desc"),
    "euclidean": ("list_distance(q.embedding::double[], b.embedding::double[])**2", "asc"),
    "dotproduct": ("list_inner_product(q.embedding::double[], b.embedding::double[])", "desc"),
}


def _knn_sql(metric: str, k: int = 10, pre: str = "true", post: str = "true") -> str:
    score, way = _SCORES[metric]
    return f"""select qid, id, rnk, round(score, 6) as score from (
      select *, row_number() over (partition by qid order by score {way}, id) as rnk from (
        select q.vec_id as qid, b.vec_id as id, b.label as label, {score} as score
        from embeddings q, embeddings b where q.vec_id % 100 = 0 and ({pre}))) where rnk <= {k} and ({post})"""


for _m in _SCORES:

    @query(f"knn_{_m}", _knn_sql(_m))
    def _(spark, sf, m=_m):
        v = vectors(spark, sf)
        return similarity.knn(v, asked(v), 10, m).select("qid", "id", "rnk", r6("score"))


@query("knn_batch_coords", f"select k.*, round(list_sum(e.embedding::double[]), 6) as total from ({_knn_sql('euclidean', 5)}) k join embeddings e on e.vec_id = k.id")
def _(spark, sf):
    v = vectors(spark, sf)
    found = similarity.knn(v, asked(v), 5, "euclidean").select("qid", "id", "rnk", r6("score"))
    return found.join(v.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total")), "id")


@query("knn_filtered_pre", _knn_sql("cosine", 10, "b.label in (1, 3, 5)"))
def _(spark, sf):
    v = vectors(spark, sf)
    return similarity.knn(v, asked(v), 10, "cosine", {"label": {"$in": [1, 3, 5]}}).select("qid", "id", "rnk", r6("score"))


@query("knn_filtered_post", _knn_sql("cosine", 10, "true", "label in (1, 3, 5)"))
def _(spark, sf):
    v = vectors(spark, sf)
    return similarity.knn(v, asked(v), 10, "cosine", {"label": {"$in": [1, 3, 5]}}, "post").select("qid", "id", "rnk", r6("score"))


@query("range_query", "select q.vec_id as qid, b.vec_id as id, round(list_distance(q.embedding::double[], b.embedding::double[]), 6) as distance from embeddings q, embeddings b where q.vec_id % 100 = 0 and list_distance(q.embedding::double[], b.embedding::double[])**2 < 1.69")
def _(spark, sf):
    v = vectors(spark, sf)
    return similarity.within(v, asked(v), 1.3).select("qid", "id", r6("distance"))


@query("pairwise_distances", "select a.vec_id as a, b.vec_id as b, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) as distance from embeddings a, embeddings b where a.vec_id % 100 = 0")
def _(spark, sf):
    v = vectors(spark, sf)
    return similarity.pairwise(v.filter("id % 100 = 0"), v).select("a", "b", r6("distance"))


@query("knn_approx_recall")
def _(spark, sf):
    v = vectors(spark, sf)
    found = similarity.knn_probed(v, asked(v), 10, 16, 8)
    return similarity.recall(found, similarity.knn(v, asked(v), 10, "euclidean"), 10)


# ---- filters and store ----------------------------------------------------------------------------------------

_FILTERS = {
    "implicit": ({"event_type": "click"}, "event_type = 'click'"),
    "eq": ({"k": {"$eq": 5}}, "k = 5"),
    "ne": ({"k": {"$ne": 5}}, "k <> 5"),
    "in": ({"event_type": {"$in": ["click", "view"]}}, "event_type in ('click', 'view')"),
    "nin": ({"event_type": {"$nin": ["click", "view"]}}, "event_type not in ('click', 'view')"),
    "range": ({"value": {"$gt": 10.0, "$lte": 50.0}}, "value > 10 and value <= 50"),
    "gte_lt": ({"value": {"$gte": 10.0, "$lt": 50.0}, "k": {"$gte": 50}}, "value >= 10 and value < 50 and k >= 50"),
    "absent": ({"none": {"$ne": 1}}, "false"),
}


@query("filter_ops_all", " union all ".join(f"select '{n}' as rule, count(*) as n, round(coalesce(sum(value), 0), 4) as total from (select *, cast(json_extract(props, '$.k') as int) as k from events) where {s}" for n, (_, s) in _FILTERS.items()))
def _(spark, sf):
    e = table(spark, sf, "events").withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "none": F.lit(None).cast("int")})
    held = F.array(*(F.when(compile_filter(f), F.lit(n)) for n, (f, _) in _FILTERS.items()))
    got = e.select("value", F.explode(held).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    every = spark.createDataFrame([(n,) for n in _FILTERS], "rule string")
    return every.join(got, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"))


_BATCH = "select vec_id + 250 as id, label + 100 as label, vec_id as seq from embeddings union all select vec_id as id, label + 200 as label, vec_id + 100000 as seq from embeddings where vec_id % 7 = 0"


def _batch(v: DataFrame) -> DataFrame:
    moved = v.select((F.col("id") + 250).alias("id"), (F.col("label") + 100).alias("label"), F.col("id").alias("seq"))
    return moved.unionByName(v.filter("id % 7 = 0").select("id", (F.col("label") + 200).alias("label"), (F.col("id") + 100000).alias("seq")))


@query("upsert_merge", f"with b as (select id, arg_max(label, seq) as label from ({_BATCH}) group by id) select vec_id as id, label from embeddings where vec_id not in (select id from b) union all select id, label from b")
def _(spark, sf):
    v = vectors(spark, sf).select("id", "label")
    return store.upsert(v, _batch(v))


@query("upsert_last_wins", f"select id, arg_max(label, seq) as label from ({_BATCH}) group by id")
def _(spark, sf):
    v = vectors(spark, sf).select("id", "label")
    return store.upsert(v.limit(0), _batch(v))


@query("fetch_ids", "select vec_id as id, label from embeddings where vec_id in (1, 5, 77, 99999999)")
def _(spark, sf):
    return store.fetch(vectors(spark, sf).select("id", "label"), [1, 5, 77, 99999999])


@query("delete_ids", "select vec_id as id, label from embeddings where vec_id not in (select vec_id from embeddings where label = 3)")
def _(spark, sf):
    v = vectors(spark, sf).select("id", "label")
    return store.delete(v, v.filter("label = 3"))


@query("delete_count", "select count(*) as deleted from embeddings where label = 3")
def _(spark, sf):
    v = vectors(spark, sf)
    return store.count_present(v, v.filter("label = 3"))


@query("namespace_stats", "select coalesce(label::varchar, 'all') as namespace, count(*) as vectors, max(len(embedding)) as dimension, sum(len(embedding) * 4)::bigint as raw_bytes from embeddings group by rollup(label)")
def _(spark, sf):
    named = vectors(spark, sf).withColumn("namespace", F.col("label").cast("string"))
    return store.statistics(named).withColumn("namespace", F.coalesce("namespace", F.lit("all")))


# ---- vector arithmetic and paths ------------------------------------------------------------------------------


def _pairs(spark, sf) -> DataFrame:
    v = vectors(spark, sf)
    b = v.select((F.col("id") - 1).alias("id"), F.coalesce("v", F.array().cast("array<double>")).alias("b"))
    return v.select("id", F.col("v").alias("a")).join(b, "id")


_PAIRS = "from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"
_LIST = "a.embedding::double[]", "b.embedding::double[]"


def _zip_sql(body: str) -> str:
    return f"[round({body.replace('X', 'a.embedding[i]::double').replace('Y', 'b.embedding[i]::double')}, 6) for i in range(1, len(a.embedding) + 1)]"


@query("vec_add", f"select a.vec_id as id, {_zip_sql('X + Y')} as v {_PAIRS}")
def _(spark, sf):
    return _pairs(spark, sf).select("id", V.rounded(V.add(F.col("a"), F.col("b"))).alias("v"))


@query("vec_sub", f"select a.vec_id as id, {_zip_sql('X - Y')} as v {_PAIRS}")
def _(spark, sf):
    return _pairs(spark, sf).select("id", V.rounded(V.subtract(F.col("a"), F.col("b"))).alias("v"))


@query("vec_analogy", f"select a.vec_id as id, {_zip_sql('Y + (Y - X)')} as v {_PAIRS}")
def _(spark, sf):
    return _pairs(spark, sf).select("id", V.rounded(V.analogy(F.col("a"), F.col("b"), F.col("b"))).alias("v"))


@query("vec_distance", f"select a.vec_id as id, round(list_distance({_LIST[0]}, {_LIST[1]}), 6) as d {_PAIRS}")
def _(spark, sf):
    return _pairs(spark, sf).select("id", F.round(V.distance(F.col("a"), F.col("b")), 6).alias("d"))


_LONG = "(select vec_id, label, i as pos, embedding[i]::double as x from (select vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings))"


def _long(spark, sf) -> DataFrame:
    return vectors(spark, sf).select("id", "label", F.posexplode("v").alias("pos", "x")).withColumn("pos", F.col("pos") + 1)


@query("centroid", f"select label, pos, round(avg(x), 6) as x from {_LONG} group by label, pos")
def _(spark, sf):
    return _long(spark, sf).groupBy("label", "pos").agg(F.round(F.avg("x"), 6).alias("x"))


@query("direction_vector", f"select pos, round(avg(x) filter (label = 1) - avg(x) filter (label = 0), 6) as x from {_LONG} group by pos")
def _(spark, sf):
    part = lambda n: F.avg(F.when(F.col("label") == n, F.col("x")))
    return _long(spark, sf).groupBy("pos").agg(F.round(part(1) - part(0), 6).alias("x"))


@query("centroid_distance", f"select round(sqrt(sum((a - b) ** 2)), 6) as d from (select pos, avg(x) filter (label = 1) as a, avg(x) filter (label = 0) as b from {_LONG} group by pos)")
def _(spark, sf):
    part = lambda n: F.avg(F.when(F.col("label") == n, F.col("x")))
    sums = _long(spark, sf).groupBy("pos").agg((part(1) - part(0)).alias("x"))
    return sums.agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("d"))


_STEPS = "(select unnest(range(0, 5)) as step) s"


@query("lerp_path", f"select a.vec_id as id, step, [round(a.embedding[i]::double * (1 - step / 4.0::double) + b.embedding[i]::double * (step / 4.0::double), 6) for i in range(1, len(a.embedding) + 1)] as p {_PAIRS}, {_STEPS}")
def _(spark, sf):
    return paths.path(_pairs(spark, sf), 5).withColumn("p", V.rounded(F.col("p")))


@query("slerp_path", f"""select id, step, [round(case when o < 1e-8 then a[i] * (1 - step / 4.0::double) + b[i] * (step / 4.0::double) else a[i] * (sin((1 - step / 4.0::double) * o) / sin(o)) + b[i] * (sin(step / 4.0::double * o) / sin(o)) end, 5) for i in range(1, len(a) + 1)] as p from (
    select a.vec_id as id, step, {_LIST[0]} as a, {_LIST[1]} as b, acos(least(1, greatest(-1, list_cosine_similarity({_LIST[0]}, {_LIST[1]})))) as o {_PAIRS}, {_STEPS})""")
def _(spark, sf):
    return paths.path(_pairs(spark, sf), 5, "spherical").withColumn("p", V.rounded(F.col("p"), 5))


@query("multi_point_path", f"""select label, vec_id as segment, step, [round(a[i] * (1 - step / 4.0::double) + b[i] * (step / 4.0::double), 6) for i in range(1, len(a) + 1)] as p
    from (select label, vec_id, embedding::double[] as a, lead(embedding::double[]) over w as b, lead(vec_id, 2) over w as later from embeddings window w as (partition by label order by vec_id)), {_STEPS} where b is not null and (step < 4 or later is null)""")
def _(spark, sf):
    points = vectors(spark, sf).select("label", F.col("id").alias("ord"), "v")
    return paths.multi_path(points, 5, ["label"]).select("label", "segment", "step", V.rounded(F.col("p")).alias("p"))


# ---- time series ----------------------------------------------------------------------------------------------

_W = "over (partition by user_id order by ts, event_id)"
_BY, _ORDER = ["user_id"], ["ts", "event_id"]


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _w_ev():
    return series.ordered(_BY, _ORDER)


#: The event types of the table.
_SYMBOLS = ("click", "error", "purchase", "signup", "view")


@query("union_symbols", " union all ".join(f"select '{s}' as symbol, count(*) as n, round(sum(value), 4) as total from events where event_type = '{s}'" for s in _SYMBOLS))
def _(spark, sf):
    every = files.combine({s: _events(spark, sf).filter(F.col("event_type") == s) for s in _SYMBOLS})
    return every.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _windows_sql(size: int, stride: int) -> str:
    return f"""select user_id, i // {stride} as win_id, round(list_sum(values), 4) as total, round(values[1], 6) as first from (
      select user_id, row_number() {_W} - 1 as i, list(value) over (partition by user_id order by ts, event_id rows between current row and {size - 1} following) as values from events)
      where i % {stride} = 0 and len(values) = {size}"""


def _windows(spark, sf, size: int, stride: int) -> DataFrame:
    return series.sliding_windows(_events(spark, sf), _BY, _ORDER, "value", size, stride)


for _name, _size, _stride in (("sliding_windows", 16, 4), ("nonoverlap_windows", 8, 8)):

    @query(_name, _windows_sql(_size, _stride))
    def _(spark, sf, size=_size, stride=_stride):
        w = _windows(spark, sf, size, stride)
        return w.select("user_id", "win_id", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.col("values")[0], 6).alias("first"))


_RET = f"case when lag(value) {_W} is null then 0.0 else least(10.0, greatest(-10.0, ln(value / (lag(value) {_W} + 1e-10) + 1e-10))) end"


@query("log_returns", f"select event_id, round({_RET}, 6) as r from events")
def _(spark, sf):
    return _events(spark, sf).select("event_id", F.round(series.log_returns(F.col("value"), _w_ev()), 6).alias("r"))


_ROLL = "avg(value) over (partition by user_id order by ts, event_id rows between 19 preceding and current row)"


@query("rolling_mean20", f"select event_id, round({_ROLL}, 6) as m from events")
def _(spark, sf):
    return _events(spark, sf).select("event_id", F.round(series.rolling_mean(F.col("value"), _w_ev()), 6).alias("m"))


@query("volume_robust", f"""with x as (select event_id, user_id, ln(value / ({_ROLL} + 1e-10) + 1e-10) as r from events),
    q as (select user_id, quantile_cont(r, 0.25) as q1, quantile_cont(r, 0.5) as q2, quantile_cont(r, 0.75) as q3 from x group by user_id)
    select event_id, round(least(5.0, greatest(-5.0, (r - q2) / (q3 - q1 + 2e-10))), 6) as robust from x join q using (user_id)""")
def _(spark, sf):
    return series.robust_volume(_events(spark, sf), _BY, _ORDER, "value").select("event_id", r6("robust"))


@query("inverse_returns", f"""with x as (select event_id, user_id, ts, {_RET} as r, first_value(value) {_W} as f from events)
    select event_id, round(f * exp(sum(r) over (partition by user_id order by ts, event_id rows unbounded preceding)), 4) as back from x""")
def _(spark, sf):
    e = _events(spark, sf).withColumns({"r": series.log_returns(F.col("value"), _w_ev()), "f": F.first("value").over(_w_ev())})
    return e.select("event_id", F.round(series.inverse_returns(F.col("f"), F.col("r"), _w_ev()), 4).alias("back"))


@query("window_normalise", "select event_id, round(least(10.0, greatest(-10.0, (value - avg(value) over w) / (stddev_pop(value) over w + 1e-8))), 6) as z from events window w as (partition by user_id)")
def _(spark, sf):
    return _events(spark, sf).select("event_id", F.round(series.normalise(F.col("value"), Window.partitionBy("user_id"), 10.0), 6).alias("z"))


@query("window_denormalise", "select event_id, round(value, 4) as back from events")
def _(spark, sf):
    w = Window.partitionBy("user_id")
    z = _events(spark, sf).withColumns({"z": series.normalise(F.col("value"), w), "m": F.avg("value").over(w), "s": F.stddev_pop("value").over(w) + 1e-8})
    return z.select("event_id", F.round(F.col("z") * F.col("s") + F.col("m"), 4).alias("back"))


def _fitted(spark, sf) -> DataFrame:
    e = _events(spark, sf)
    return e.join(F.broadcast(series.fit(e, "value")))  # one row


@query("zscore_clip", "select event_id, round(least(5.0, greatest(-5.0, (value - m) / greatest(s, 1e-8))), 6) as z from events, (select avg(value) as m, stddev_pop(value) as s from events)")
def _(spark, sf):
    return _fitted(spark, sf).select("event_id", F.round(series.zscore(F.col("value"), F.col("mean"), F.col("std")), 6).alias("z"))


@query("minmax", "select event_id, round((value - lo) / greatest(hi - lo, 1e-8), 6) as x from events, (select min(value) as lo, max(value) as hi from events)")
def _(spark, sf):
    return _fitted(spark, sf).select("event_id", F.round(series.minmax(F.col("value"), F.col("lo"), F.col("hi")), 6).alias("x"))


@query("unzscore", "select event_id, round(value, 4) as back from events")
def _(spark, sf):
    z = _fitted(spark, sf).withColumn("z", series.zscore(F.col("value"), F.col("mean"), F.col("std"), 0.0))
    return z.select("event_id", F.round(series.unzscore(F.col("z"), F.col("mean"), F.col("std")), 4).alias("back"))


@query("unminmax", "select event_id, round(value, 4) as back from events")
def _(spark, sf):
    x = _fitted(spark, sf).withColumn("x", series.minmax(F.col("value"), F.col("lo"), F.col("hi")))
    return x.select("event_id", F.round(series.unminmax(F.col("x"), F.col("lo"), F.col("hi")), 4).alias("back"))


@query("revin_normalise", "select event_id, round((value - avg(value) over w) / sqrt(var_pop(value) over w + 1e-5) * 2.0 + 0.5, 6) as z from events window w as (partition by user_id)")
def _(spark, sf):
    return _events(spark, sf).select("event_id", F.round(series.instance_norm(F.col("value"), Window.partitionBy("user_id"), 2.0, 0.5)[0], 6).alias("z"))


@query("revin_restore", "select event_id, round(value, 4) as back from events")
def _(spark, sf):
    z, mean, scale = series.instance_norm(F.col("value"), Window.partitionBy("user_id"), 2.0, 0.5)
    rows = _events(spark, sf).withColumns({"z": z, "m": mean, "s": scale})
    return rows.select("event_id", F.round(series.restore_instance(F.col("z"), F.col("m"), F.col("s"), 2.0, 0.5), 4).alias("back"))


@query("finite_values", "select event_id, case event_id % 3 when 0 then 0.0 when 1 then 3.4028234663852886e38 else value end as x from events")
def _(spark, sf):
    e = _events(spark, sf)
    k = F.col("event_id") % 3
    odd = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return e.select("event_id", series.finite(odd).alias("x"))


@query("zigzag8", "select vec_id as id, label, case when d >= 0 then 2 * d else -2 * d - 1 end as z from (select vec_id, label, (label * 29 + vec_id) % 256 - 128 as d from embeddings)")
def _(spark, sf):
    d = (F.col("label") * 29 + F.col("id")) % 256 - 128
    return vectors(spark, sf).select("id", "label", B.zigzag(d).bitwiseAND(255).alias("z"))


@query("reshaped", f"select vec_id as id, w, t, f, round(embedding[w * 16 + t * 4 + f + 1]::double, 6) as x from embeddings, (select unnest(range(0, 4)) as w), (select unnest(range(0, 4)) as t), (select unnest(range(0, 4)) as f)")
def _(spark, sf):
    """Flat arrays as windows x steps x features."""
    return series.reshaped(vectors(spark, sf).select("id", "v"), "v", 4, 4).select("id", "w", "t", "f", F.round("x", 6).alias("x"))


@query("unreshaped", "select vec_id as id, [round(x::double, 6) for x in embedding] as v from embeddings")
def _(spark, sf):
    return series.unreshaped(series.reshaped(vectors(spark, sf).select("id", "v"), "v", 4, 4), ["id"]).select("id", V.rounded(F.col("v")).alias("v"))


@query("gated_dimensions", f"select vec_id as id, count(*) as active, round(sum(x * g), 6) as total from (select vec_id, x, 1 / (1 + exp(-10 * (((pos * 7) % 11) / 10.0::double - 0.5))) as g from {_LONG}) where g > 0.5 group by vec_id")
def _(spark, sf):
    """Dimensions whose gate is open, weighted by it."""
    gates = spark.range(1, 65).select(F.col("id").cast("int").alias("pos"), ((F.col("id") * 7 % 11) / 10.0 - 0.5).alias("gate"))
    kept = quantise.gated(_long(spark, sf).select("id", "pos", "x"), gates)
    return kept.groupBy("id").agg(F.count("*").alias("active"), F.round(F.sum("x"), 6).alias("total"))


@query("series_fit", "select event_type, round(min(value), 6) as lo, round(max(value), 6) as hi, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from events group by event_type")
def _(spark, sf):
    return series.fit(_events(spark, sf), "value", ["event_type"]).select("event_type", *map(r6, ("lo", "hi", "mean", "std")))


@query("revin_stats", "select user_id, round(avg(value), 6) as mean, round(sqrt(var_pop(value) + 1e-5), 6) as scale from events group by user_id")
def _(spark, sf):
    return _events(spark, sf).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.sqrt(F.var_pop("value") + 1e-5), 6).alias("scale"))


_FEAT = f"""(select user_id, win_id, avg(x) as m, stddev_pop(x) as s, min(x) as lo, max(x) as hi from (
    select user_id, win_id, unnest([(v - values[1]) / (case when abs(values[1]) < 1e-10 then 1 else abs(values[1]) end) for v in values]) as x from (
      select user_id, i // 4 as win_id, values from (select user_id, row_number() {_W} - 1 as i, list(value) over (partition by user_id order by ts, event_id rows between current row and 15 following) as values from events)
      where i % 4 = 0 and len(values) = 16)) group by user_id, win_id)"""


def _features(spark, sf) -> DataFrame:
    first = F.col("values")[0]
    base = F.when(F.abs(first) < 1e-10, 1.0).otherwise(F.abs(first))
    x = _windows(spark, sf, 16, 4).select("user_id", "win_id", F.explode(F.transform("values", lambda v: (v - first) / base)).alias("x"))
    return x.groupBy("user_id", "win_id").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))


@query("window_features", f"select user_id, win_id, round(m, 5) as m, round(s, 5) as s, round(lo, 5) as lo, round(hi, 5) as hi from {_FEAT}")
def _(spark, sf):
    return _features(spark, sf).select("user_id", "win_id", *(F.round(c, 5).alias(c) for c in ("m", "s", "lo", "hi")))


@query("window_features_search", f"""with f as (select (user_id::bigint << 32) + win_id as id, win_id, [m, s, lo, hi] as v from {_FEAT}) select qid, id, rnk, round(score, 4) as score from (
    select q.id as qid, b.id as id, list_distance(q.v, b.v) ** 2 as score, row_number() over (partition by q.id order by list_distance(q.v, b.v) ** 2, b.id) as rnk from f q, f b where q.win_id % 100 = 0) where rnk <= 5""")
def _(spark, sf):
    """Every hundredth window of each user against all; 32 bits of the id are the window's, so no two share one."""
    f = _features(spark, sf).select((F.shiftleft(F.col("user_id").cast("long"), 32) + F.col("win_id")).alias("id"), "win_id", F.array("m", "s", "lo", "hi").alias("v"))
    q = f.filter("win_id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return similarity.knn(f.select("id", "v"), q, 5, "euclidean").select("qid", "id", "rnk", F.round("score", 4).alias("score"))


@query("split_chrono", f"""select event_id, case when i < floor(n * 0.7) then 'train' when i < floor(n * 0.7) + floor(n * 0.15) then 'valid' else 'test' end as part
    from (select event_id, row_number() {_W} - 1 as i, count(*) over (partition by user_id)::double as n from events)""")
def _(spark, sf):
    return series.split(_events(spark, sf), _BY, _ORDER).select("event_id", "part")


@query("regimes", f"""with a as (select user_id, event_type as label, row_number() {_W} - 1 as i, lag(event_type) {_W} as p from events),
    b as (select *, sum(case when p = label then 0 else 1 end) over (partition by user_id order by i) as run from a)
    select user_id, label, min(i) as start, max(i) + 1 as "end", count(*) as size from b group by user_id, run, label having count(*) >= 2""")
def _(spark, sf):
    return series.regimes(_events(spark, sf), _BY, _ORDER, "event_type", 2)


_INERTIAS = " union all ".join(f"select {k} as k, sum(d) as inertia from (select min(list_distance(v.embedding::double[], b.embedding::double[]) ** 2) as d from embeddings v, embeddings b where b.vec_id < {k} group by v.vec_id)" for k in range(1, 9))


@query("elbow_k", f"with b as (select k, lag(inertia) over (order by k) - 2 * inertia + lead(inertia) over (order by k) as bend from ({_INERTIAS})) select arg_max(k, bend) as k from b where bend is not null")
def _(spark, sf):
    """The bend of the squared distances of all vectors to the nearest of the first k."""
    v = vectors(spark, sf)
    nearest = v.join(F.broadcast(_book(v, 0, 8).agg(F.array_sort(F.collect_list(F.struct("code", "cv"))).alias("book"))))
    d2 = F.transform("book", lambda c: V.squared_distance(F.col("v"), c["cv"]))
    rows = nearest.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.array_min(F.slice(d2, 1, k)))).alias("k", "d"))
    return series.elbow(rows.groupBy((F.col("k") + 1).alias("k")).agg(F.sum("d").alias("inertia")))


@query("chunks_batch", f"select user_id, i // 8 as chunk, count(*) as n from (select user_id, row_number() {_W} - 1 as i from events) group by user_id, i // 8")
def _(spark, sf):
    return series.chunks(_events(spark, sf), _BY, _ORDER, 8)


@query("running_extremes", f"select event_id, round(max(value) {_W}, 6) as hi, round(min(value) {_W}, 6) as lo from events")
def _(spark, sf):
    w = _w_ev().rowsBetween(Window.unboundedPreceding, 0)
    return _events(spark, sf).select("event_id", F.round(F.max("value").over(w), 6).alias("hi"), F.round(F.min("value").over(w), 6).alias("lo"))


@query("latency_percentiles", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by event_type")
def _(spark, sf):
    return _events(spark, sf).groupBy("event_type").agg(*(F.round(F.percentile("value", F.lit(p / 100)), 6).alias(f"p{p}") for p in (50, 95, 99)))


# ---- integer transforms ---------------------------------------------------------------------------------------

_C = "(select o_orderkey as k, o_custkey as c, cast(round(o_totalprice * 100) as bigint) as x from orders)"
_OW = "over (partition by c order by k)"


def _cents(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.round(F.col("o_totalprice") * 100).cast("long").alias("x"))


def _w_or():
    return Window.partitionBy("c").orderBy("k")


@query("zigzag", f"select k, case when x >= 0 then 2 * x else -2 * x - 1 end as u from (select k, x - 15000000 as x from {_C})")
def _(spark, sf):
    return _cents(spark, sf).select("k", B.zigzag(F.col("x") - 15000000).alias("u"))


@query("unzigzag", f"select k, x - 15000000 as x from {_C}")
def _(spark, sf):
    return _cents(spark, sf).select("k", B.unzigzag(B.zigzag(F.col("x") - 15000000)).alias("x"))


@query("split_expmant_int", f"select k, x >> 23 as e, x & 8388607 as m from {_C}")
def _(spark, sf):
    return _cents(spark, sf).select("k", B.sign_exponent(F.col("x")).alias("e"), B.mantissa(F.col("x")).alias("m"))


@query("zeros", f"select k, case when x = 0 then 32 else 32 - length(bin(x)) end as lead, case when x = 0 then 32 else bit_count(xor(x, x - 1)) - 1 end as trail from {_C}")
def _(spark, sf):
    return _cents(spark, sf).select("k", B.leading_zeros(F.col("x")).alias("lead"), B.trailing_zeros(F.col("x")).alias("trail"))


def _delta_sql(order: int) -> str:
    from math import comb

    terms = lambda o: "x" + "".join(f" {'-' if j % 2 else '+'} {comb(o, j)} * lag(x, {j}) {_OW}" for j in range(1, o + 1))
    cases = " ".join(f"when t = {o} then {terms(o)}" for o in range(order))
    return f"select k, (d + 2147483648) & 4294967295 - 0 as u, ((d + 2147483648) & 4294967295) - 2147483648 as d from (select k, case {cases} else {terms(order)} end as d from (select *, row_number() {_OW} - 1 as t from {_C}))"


for _k in range(1, 5):

    @query(f"delta_order{_k}", f"select k, d from ({_delta_sql(_k)})")
    def _(spark, sf, k=_k):
        return T.with_delta(_cents(spark, sf), ["c"], ["k"], "x", k).select("k", "d")

    @query(f"undelta_order{_k}", f"select k, x from {_C}")
    def _(spark, sf, k=_k):
        d = T.with_delta(_cents(spark, sf), ["c"], ["k"], "x", k).select("c", "k", "d")
        return T.undelta(d, ["c"], ["k"], "d", k).select("k", "x")


@query("delta_zigzag", f"select k, case when d >= 0 then 2 * d else -2 * d - 1 end as d from (select k, d from ({_delta_sql(1)}))")
def _(spark, sf):
    return T.zigzag_delta(_cents(spark, sf), ["c"], ["k"], "x").select("k", "d")


@query("xor_delta", f"select k, xor(x, coalesce(lag(x) {_OW}, 0)) as d from {_C}")
def _(spark, sf):
    return _cents(spark, sf).select("k", T.xor_delta(F.col("x"), _w_or()).alias("d"))


@query("unxor_delta", f"select k, x from {_C}")
def _(spark, sf):
    d = _cents(spark, sf).withColumn("d", T.xor_delta(F.col("x"), _w_or()))
    return d.select("k", T.unxor(F.col("d"), _w_or()).alias("x"))


_LI = "(select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) as _, l_orderkey as o, l_linenumber as n, l_partkey as p, l_suppkey as s, l_shipdate as t, cast(round(l_quantity * 100) as bigint) as f0, cast(round(l_extendedprice * 100) as bigint) as f1, cast(round(l_discount * 100) as bigint) as f2 from lineitem)"


_LI_W = "partition by o order by n, p, s, t"
_LI_KEYS = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def _features_of_items(spark, sf) -> DataFrame:
    cents = [F.round(F.col(c) * 100).cast("long").alias(f"f{i}") for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount"))]
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), *_LI_KEYS, *cents)


@query("cross_feature_delta", f"select o, n as line, f0 - coalesce(lag(f0) over ({_LI_W}), 0) as d0, f1 - f0 as d1, f2 - f1 as d2 from {_LI}")
def _(spark, sf):
    d = T.cross_feature_delta(_features_of_items(spark, sf), ["o"], list(_LI_KEYS), ["f0", "f1", "f2"])
    return d.select("o", F.col("l_linenumber").alias("line"), *(F.col(f"f{i}").alias(f"d{i}") for i in range(3)))


@query("uncross_feature_delta", f"select o, n as line, f0, f1, f2 from {_LI}")
def _(spark, sf):
    names = ["f0", "f1", "f2"]
    d = T.cross_feature_delta(_features_of_items(spark, sf), ["o"], list(_LI_KEYS), names)
    return T.uncross_feature_delta(d, ["o"], list(_LI_KEYS), names).select("o", F.col("l_linenumber").alias("line"), *names)


@query("flatten_delta", f"select k, x - coalesce(lag(x) over (order by c, k), 0) as d from {_C}")
def _(spark, sf):
    return T.delta_across(_cents(spark, sf), ["c", "k"], "x").select("k", "d")


@query("unflatten_delta", f"select k, x from {_C}")
def _(spark, sf):
    d = T.delta_across(_cents(spark, sf), ["c", "k"], "x").drop("x")
    return T.undelta_across(d, ["c", "k"], "d").select("k", "x")


@query("flatten_delta_zigzag", f"select k, case when d >= 0 then 2 * d else -2 * d - 1 end as d from (select k, x - coalesce(lag(x) over (order by c, k), 0) as d from {_C})")
def _(spark, sf):
    return T.delta_across(_cents(spark, sf), ["c", "k"], "x").select("k", B.zigzag(F.col("d")).alias("d"))


_WT = f"with a as (select k, c, x, row_number() {_OW} - 1 as t, c // 10 as g from {_C}), b as (select *, x - coalesce(lag(x) over (partition by g, t order by c), 0) as e from a)"


def _window_rows(spark, sf) -> DataFrame:
    return _cents(spark, sf).withColumns({"t": F.row_number().over(_w_or()) - 1, "g": F.floor(F.col("c") / 10)})


@query("window_time_delta", f"{_WT} select k, e - coalesce(lag(e) over (partition by c order by t), 0) as d from b")
def _(spark, sf):
    return T.window_time_delta(_window_rows(spark, sf), ["g"], "c", "t", "x").select("k", "d")


@query("unwindow_time_delta", f"select k, x from {_C}")
def _(spark, sf):
    d = T.window_time_delta(_window_rows(spark, sf), ["g"], "c", "t", "x").drop("x")
    return T.unwindow_time_delta(d, ["g"], "c", "t", "d").select("k", "x")


@query("adaptive_order", "with d as (" + " union all ".join(f"select c, {k} as o, sum(abs(d)) as s from (select k, c, d from ({_delta_sql(k) if k else f'select k, x as d from {_C}'}) join (select k as kk, c from {_C}) on k = kk) group by c" for k in range(5)) + ") select c, best_order from (select c, o as best_order, row_number() over (partition by c order by s, o) as rn from d) where rn = 1")
def _(spark, sf):
    return T.adaptive_order(_cents(spark, sf), ["c"], ["k"], "x")


_Q8 = "(select o_orderkey as k, o_custkey as c, cast(floor((o_totalprice - lo) / greatest(hi - lo, 1e-10) * 255) as int) as q, o_totalprice as x, lo, greatest(hi - lo, 1e-10) as span from orders, (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders))"


def _quant8(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("x"))
    f = o.agg(F.min("x").alias("lo"), F.greatest(F.max("x") - F.min("x"), F.lit(1e-10)).alias("span"))
    return o.join(F.broadcast(f)).withColumn("q", F.floor((F.col("x") - F.col("lo")) / F.col("span") * 255).cast("int"))


@query("quant8", f"select k, q from {_Q8}")
def _(spark, sf):
    return _quant8(spark, sf).select("k", "q")


@query("quant8_delta", f"select k, (q - coalesce(lag(q) over (partition by c order by k), 0) + 256) % 256 as d from {_Q8}")
def _(spark, sf):
    return _quant8(spark, sf).select("k", F.pmod(F.col("q") - F.coalesce(F.lag("q").over(_w_or()), F.lit(0)), F.lit(256)).alias("d"))


@query("dequant_error", f"select round(sqrt(avg((x - (q / 255.0::double * span + lo)) ** 2)), 4) as rmse from {_Q8}")
def _(spark, sf):
    e = F.col("x") - (F.col("q") / 255.0 * F.col("span") + F.col("lo"))
    return _quant8(spark, sf).agg(F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"))


# ---- entropy --------------------------------------------------------------------------------------------------

_SYM = "(select doc_id as g, i, ('0x' || h[2 * i - 1:2 * i])::int as s from (select doc_id, hex(text) as h, unnest(range(1, strlen(text) + 1)) as i from documents))"
_PROB = "c / sum(c) over (partition by g)::double"


def _profile(spark, sf) -> DataFrame:
    """Figures of the UTF-8 bytes of each text."""
    return H.byte_profile(table(spark, sf, "documents").select(F.col("doc_id").alias("g"), "text"), "g", "text").filter("n > 0")


@query("byte_entropy", f"select g, round(-sum(p * log2(p)) + 0, 6) as h0 from (select g, {_PROB} as p from (select g, s, count(*) as c from {_SYM} group by g, s)) group by g")
def _(spark, sf):
    return _profile(spark, sf).select("g", r6("h0"))


_H1 = f"""(select g, 0 - sum(c / n * log2(c / ctx)) as h1 from (select *, sum(c) over (partition by g, b)::double as ctx, sum(c) over (partition by g)::double as n from (
    select g, b, s, count(*) as c from (select g, s, lag(s) over (partition by g order by i) as b from {_SYM}) where b is not null group by g, b, s)) group by g)"""


@query("bigram_entropy", f"select g, round(h1, 6) as h1 from {_H1}")
def _(spark, sf):
    return _profile(spark, sf).filter("h1 is not null").select("g", r6("h1"))


@query("trigram_block_entropy", f"select g, round(-sum(p * log2(p)) + 0, 6) as h from (select g, {_PROB} as p from (select g, s, b, a, count(*) as c from (select g, s, lag(s) over w as b, lag(s, 2) over w as a from {_SYM} window w as (partition by g order by i)) where a is not null group by g, s, b, a)) group by g")
def _(spark, sf):
    return _profile(spark, sf).filter("h3 is not null").select("g", F.round("h3", 6).alias("h"))


def _p_sql(chi2: str, k: float = 255.0) -> str:
    """The p-value formula in SQL."""
    x = f"((pow(({chi2}) / {k}, 1 / 3.0::double) - (1 - 2 / (9 * {k}))) / sqrt(2 / (9 * {k}::double)) / sqrt(2.0::double))"
    t = f"(1 / (1 + {H.ERF_P}::double * abs({x})))"
    poly = "0.0::double"
    for a in reversed(H.ERF_A):
        poly = f"({t} * ({a}::double + {poly}))"
    return f"greatest(0.0, least(1.0, 0.5 * (1 - sign({x}) * (1 - {poly} * exp(-{x} * {x})))))"


@query("chi2_uniform", f"select round(chi2, 3) as chi2, n, round(case when n < 256 then 0.0 else {_p_sql('chi2')} end, 6) as p_value from (select sum(c * c) * 256 / sum(c)::double - sum(c) as chi2, sum(c)::bigint as n from (select s, count(*) as c from {_SYM} group by s))")
def _(spark, sf):
    return H.counted_uniformity(H.byte_counts(table(spark, sf, "documents"), "text")).select(F.round("chi2", 3).alias("chi2"), "n", r6("p_value"))


_SIZES = f"(select s.g, s.n, s.h0, s.q, h.h1 from (select g, sum(c)::bigint as n, -sum(c / t * log2(c / t)) as h0, sum(c * c) * 256 / sum(c)::double - sum(c) as q from (select g, s, count(*) as c, sum(count(*)) over (partition by g)::double as t from {_SYM} group by g, s) group by g) s left join {_H1} h on h.g = s.g)"


@query("certificate", f"""select g, n as original_size, round(f, 6) as entropy, round(8 - f, 6) as gap_bpb, round(case when f > 1e-9 then (8 - f) / f * 100 else 0 end, 4) as gap_pct, round(case when n < 256 then 0.0 else {_p_sql('q')} end, 6) as p_value
    from (select *, least(h0, coalesce(h1, h0)) as f from {_SIZES})""")
def _(spark, sf):
    """Certificates of texts kept as they are, at eight bits a byte."""
    one = table(spark, sf, "documents").select(F.col("doc_id").alias("g"), "text")
    p = H.byte_profile(one, "g", "text", with_p=True).filter("n > 0")
    c = H.gap(F.col("h0"), F.col("h1"), F.col("n"), F.col("n"))
    floor = F.when(c["entropy"] > 1e-9, c["entropy"]).otherwise(0.0)
    return p.select("g", F.col("n").alias("original_size"), F.round(c["entropy"], 6).alias("entropy"), F.round(c["gap_bpb"], 6).alias("gap_bpb"), F.round(F.when(floor > 0, c["gap_pct"]).otherwise(0.0), 4).alias("gap_pct"), r6("p_value"))


@query("adaptive_code_length", f"select g, round(-sum(log2((1 + b) / (256 + t)::double)), 3) as bits from (select g, row_number() over (partition by g, s order by i) - 1 as b, row_number() over (partition by g order by i) - 1 as t from {_SYM}) group by g")
def _(spark, sf):
    return _profile(spark, sf).select("g", F.round("adaptive_bits", 3).alias("bits"))


@query("static_code_length", f"select g, round(-sum(c * log2((c + 1) / (t + 256))), 3) as bits from (select g, s, count(*) as c, sum(count(*)) over (partition by g)::double as t from {_SYM} group by g, s) group by g")
def _(spark, sf):
    return _profile(spark, sf).select("g", F.round("static_bits", 3).alias("bits"))


@query("value_entropy", f"select g, round(-sum(p * log2(p)), 6) as h0 from (select g, {_PROB} as p from (select l_returnflag as g, round_even(l_discount, 2) as s, count(*) as c from lineitem group by 1, 2)) group by g")
def _(spark, sf):
    return H.entropy(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.bround("l_discount", 2).alias("s")), ["g"]).select("g", r6("h0"))


@query("delta_entropy", f"select g, round(-sum(p * log2(p)), 6) as h0 from (select g, {_PROB} as p from (select c % 10 as g, floor(d / 100000.0::double)::bigint as s, count(*) as c from (select c, x - lag(x) {_OW} as d from {_C}) where d is not null group by 1, 2)) group by g")
def _(spark, sf):
    d = _cents(spark, sf).select("c", (F.col("x") - F.lag("x").over(_w_or())).alias("d")).dropna()
    return H.entropy(d.select((F.col("c") % 10).alias("g"), F.floor(F.col("d") / 100000).alias("s")), ["g"]).select("g", r6("h0"))


@query("cross_feature_entropy", "select round(-sum(c / n * log2(c / ctx)), 6) as h from (select c, sum(c) over (partition by q)::double as ctx, sum(c) over ()::double as n from (select l_quantity as q, l_discount as d, count(*) as c from lineitem group by 1, 2))")
def _(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count("*").alias("c"))
    ctx = c.groupBy("l_quantity").agg(F.sum("c").alias("ctx"))
    n = c.agg(F.sum("c").alias("n"))
    rows = c.join(ctx, "l_quantity").join(F.broadcast(n))
    return rows.agg(F.round(-F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") / F.col("ctx"))), 6).alias("h"))


# ---- quantisation ---------------------------------------------------------------------------------------------

_NEAR = "(select v.vec_id as id, b.vec_id as code, list_distance(v.embedding::double[], b.embedding::double[]) ** 2 as d2, row_number() over (partition by v.vec_id order by list_distance(v.embedding::double[], b.embedding::double[]) ** 2, b.vec_id) as rn from embeddings v, embeddings b where b.vec_id < 16)"


def _book(v: DataFrame, a: int = 0, b: int = 16) -> DataFrame:
    return v.filter(f"id >= {a} and id < {b}").select(F.col("id").alias("code"), F.col("v").alias("cv"))


@query("vq_assign", f"select id, code, round(d2, 6) as d2 from {_NEAR} where rn = 1")
def _(spark, sf):
    v = vectors(spark, sf)
    return quantise.assign(v, _book(v)).select("id", "code", r6("d2"))


@query("vq_lookup", f"select id, code, [round(x::double, 6) for x in e.embedding] as cv from {_NEAR} n join embeddings e on e.vec_id = n.code where rn = 1")
def _(spark, sf):
    v = vectors(spark, sf)
    return quantise.assign(v, _book(v)).select("id", "code", V.rounded(F.col("cv")).alias("cv"))


_CODES = f"(select e.label % 2 as g, n.code as s, count(*) as c from {_NEAR} n join embeddings e on e.vec_id = n.id where rn = 1 group by 1, 2)"


def _codes(spark, sf) -> DataFrame:
    v = vectors(spark, sf)
    return quantise.assign(v, _book(v)).select((F.col("label") % 2).alias("g"), F.col("code").alias("s"))


@query("code_entropy", f"select g, round(-sum(p * log2(p)), 6) as h0 from (select g, {_PROB} as p from {_CODES}) group by g")
def _(spark, sf):
    return H.entropy(_codes(spark, sf), ["g"]).select("g", r6("h0"))


@query("perplexity", f"select g, round(exp(-sum(p * ln(p + 1e-10))), 6) as perplexity from (select g, {_PROB} as p from {_CODES}) group by g")
def _(spark, sf):
    return H.perplexity(_codes(spark, sf), ["g"]).select("g", r6("perplexity"))


_REST = f"(select n.id, n.code, [e.embedding[i]::double - b.embedding[i]::double for i in range(1, len(e.embedding) + 1)] as r, b.embedding::double[] as cv from {_NEAR} n join embeddings e on e.vec_id = n.id join embeddings b on b.vec_id = n.code where rn = 1)"


@query("rvq_two_level", f"""select id, code_0, code_1, [round(cv[i] + b[i], 6) for i in range(1, len(cv) + 1)] as approx from (
    select x.id, x.code as code_0, b.vec_id as code_1, x.cv, b.embedding::double[] as b, row_number() over (partition by x.id order by list_distance(x.r, b.embedding::double[]) ** 2, b.vec_id) as rn from {_REST} x, embeddings b where b.vec_id >= 16 and b.vec_id < 32) where rn = 1""")
def _(spark, sf):
    v = vectors(spark, sf)
    return quantise.residual(v, [_book(v), _book(v, 16, 32)]).select("id", "code_0", "code_1", V.rounded(F.col("approx")).alias("approx"))


@query("fsq_codes", "select vec_id as id, p as part, (round(tanh(embedding[3 * p + 1]::double * 8) * 3.5 + 3.5) + 8 * round(tanh(embedding[3 * p + 2]::double * 8) * 2 + 2) + 40 * round(tanh(embedding[3 * p + 3]::double * 8) * 2 + 2))::int as code from embeddings, (select unnest(range(0, 21)) as p)")
def _(spark, sf):
    """Three dimensions a code, 21 codes a vector."""
    parts = vectors(spark, sf).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda p: F.transform(F.slice("v", p * 3 + 1, 3), lambda x: x * 8))).alias("part", "z"))
    return parts.select("id", "part", quantise.finite_scalar(F.col("z"), [8, 5, 5]).alias("code"))


@query("codebook_ema", f"with a as (select n.code, i as pos, avg(e.embedding[i]::double) as m from {_NEAR} n join embeddings e on e.vec_id = n.id, (select unnest(range(1, 65)) as i) where rn = 1 group by 1, 2) select code, pos - 1 as pos, round(0.99 * b.embedding[pos]::double + 0.01 * m, 6) as value from a join embeddings b on b.vec_id = code")
def _(spark, sf):
    v = vectors(spark, sf)
    return quantise.ema_step(quantise.assign(v, _book(v)), _book(v)).select("code", "pos", r6("value"))


_CD = "(code - coalesce(lag(code) over (partition by id // 50 order by id), 0))"


@query("code_delta", f"select id, case when d >= 0 then 2 * d else -2 * d - 1 end as d from (select id, ({_CD} + 128 + 256) % 256 - 128 as d from {_NEAR} where rn = 1)")
def _(spark, sf):
    return T.code_delta(_placed_codes(spark, sf), ["g"], ["id"], "code").select("id", "d")


@query("uncode_delta", f"select id, code from {_NEAR} where rn = 1")
def _(spark, sf):
    d = T.code_delta(_placed_codes(spark, sf), ["g"], ["id"], "code").drop("code")
    return T.uncode_delta(d, ["g"], ["id"], "d").select("id", F.col("x").alias("code"))


def _placed_codes(spark, sf) -> DataFrame:
    v = vectors(spark, sf)
    return quantise.assign(v, _book(v)).select("id", "code", F.floor(F.col("id") / 50).alias("g"))


# ---- metrics --------------------------------------------------------------------------------------------------


def _recon(spark, sf) -> DataFrame:
    e = _events(spark, sf)
    return e.withColumn("y", series.rolling_mean(F.col("value"), _w_ev())).withColumn("d2", F.pow(F.col("value") - F.col("y"), 2))


_RECON = f"(select *, (value - y) ** 2 as d2 from (select *, {_ROLL} as y from events))"


@query("rmse", f"select round(sqrt(avg(d2)), 6) as rmse from {_RECON}")
def _(spark, sf):
    return _recon(spark, sf).agg(F.round(F.sqrt(F.avg("d2")), 6).alias("rmse"))


@query("rmse_per_feature", f"select event_type, round(sqrt(avg(d2)), 6) as rmse from {_RECON} group by event_type")
def _(spark, sf):
    return _recon(spark, sf).groupBy("event_type").agg(F.round(F.sqrt(F.avg("d2")), 6).alias("rmse"))


@query("weighted_mse", f"select round(sum(w * d2) / sum(w), 6) as mse from (select *, case when event_type = 'click' then 2.0 else 1.0 end as w from {_RECON})")
def _(spark, sf):
    w = F.when(F.col("event_type") == "click", 2.0).otherwise(1.0)
    return _recon(spark, sf).agg(F.round(F.sum(w * F.col("d2")) / F.sum(w), 6).alias("mse"))


@query("effective_dim", f"with v as (select pos, var_pop(x) as v from {_LONG} group by pos) select count(*) filter (v > 0.01) as active_dims, round(case when sum(v) = 0 then 0 else sum(v) ** 2 / sum(v * v) end, 6) as participation from v")
def _(spark, sf):
    v = _long(spark, sf).groupBy("pos").agg(F.var_pop("x").alias("v"))
    return v.agg(F.count_if(F.col("v") > 0.01).alias("active_dims"), F.round(F.when(F.sum("v") == 0, 0.0).otherwise(F.pow(F.sum("v"), 2) / F.sum(F.col("v") * F.col("v"))), 6).alias("participation"))


_LV = "(select id, pos, m, ln(s * s + 1e-6) as lv from (select label as id, pos, avg(x) as m, stddev_pop(x) as s from " + _LONG + " group by label, pos))"


def _normals(spark, sf) -> DataFrame:
    """Mean and log variance of each coordinate within a label."""
    per = _long(spark, sf).groupBy(F.col("label").alias("id"), "pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return per.select("id", "pos", "m", F.ln(F.col("s") * F.col("s") + 1e-6).alias("lv"))


@query("kl", f"select id, round(sum(-0.5 * (1 + lv - m * m - exp(lv))), 6) as kl from {_LV} group by id")
def _(spark, sf):
    n = _normals(spark, sf)
    return n.groupBy("id").agg(F.round(F.sum(M.kl_terms(F.col("m"), F.col("lv"))), 6).alias("kl"))


@query("kl_per_dim", f"select pos, round(avg(-0.5 * (1 + lv - m * m - exp(lv))), 6) as kl from {_LV} group by pos")
def _(spark, sf):
    n = _normals(spark, sf)
    return n.groupBy("pos").agg(F.round(F.avg(M.kl_terms(F.col("m"), F.col("lv"))), 6).alias("kl"))


@query("sparsity", f"select round(avg(abs(x)), 6) as sparsity from {_LONG}")
def _(spark, sf):
    return M.sparsity(_long(spark, sf)).select(r6("sparsity"))


@query("weighted_huber", f"select round(sum(w * case when abs(value - y) <= 1 then 0.5 * d2 else abs(value - y) - 0.5 end) / sum(w), 6) as loss from (select *, case when event_type = 'click' then 2.0 else 1.0 end as w from {_RECON})")
def _(spark, sf):
    w = F.when(F.col("event_type") == "click", 2.0).otherwise(1.0)
    return M.weighted_loss(_recon(spark, sf), F.col("value") - F.col("y"), w, "huber").select(r6("loss"))


@query("evaluation", f"select event_type, count(*) as n, round(sqrt(avg(d2)), 6) as rmse, round(100 * sqrt(avg(d2)) / (max(value) - min(value)), 6) as range_pct from {_RECON} group by event_type")
def _(spark, sf):
    return M.evaluate(_recon(spark, sf), "value", "y", ["event_type"]).select("event_type", "n", r6("rmse"), r6("range_pct"))


@query("combined_loss", f"select event_type, round(avg(d2) + 0.1 * 0.25 * avg(abs(y)) + 0.5 * avg(abs(value - y)), 6) as loss from {_RECON} group by event_type")
def _(spark, sf):
    """Reconstruction, a part whose weight is a quarter through its warm-up, and a weighted part."""
    parts = {"recon": F.avg("d2"), "size": F.avg(F.abs("y")), "abs": F.avg(F.abs(F.col("value") - F.col("y")))}
    weights = {"size": M.warmed(25, 100, 0.1), "abs": 0.5}
    return _recon(spark, sf).groupBy("event_type").agg(F.round(M.combined_loss(parts, weights), 6).alias("loss"))


_DFT = "(select user_id, win_id, k, sqrt(sum(x * cos(2 * pi() * k * t / 16)) ** 2 + sum(x * sin(2 * pi() * k * t / 16)) ** 2) as m from (select user_id, i // 16 as win_id, i % 16 as t, {x} as x, count(*) over (partition by user_id, i // 16) as n from (select *, row_number() {w} - 1 as i from {r})), (select unnest(range(0, 9)) as k) where n = 16 group by user_id, win_id, k)"


@query("spectral_mse", f"select round(avg((a.m - b.m) ** 2), 4) as mse from {_DFT.format(x='value', w=_W, r=_RECON)} a join {_DFT.format(x='y', w=_W, r=_RECON)} b using (user_id, win_id, k)")
def _(spark, sf):
    """Windows of 16 values against their rolling means."""
    rows = _recon(spark, sf).withColumn("i", F.row_number().over(_w_ev()) - 1)
    held = lambda c: F.array_sort(F.collect_list(F.struct("i", c)))[c]
    pairs = rows.groupBy("user_id", F.floor(F.col("i") / 16).alias("win_id")).agg(held("value").alias("x"), held("y").alias("z")).filter("size(x) = 16")
    return M.spectral_mse(pairs, "x", "z").select(F.round("mse", 4).alias("mse"))


@query("smoothness", f"select round(avg(d * d), 6) as smoothness from (select value - lag(value) {_W} as d from events)")
def _(spark, sf):
    d = _events(spark, sf).select((F.col("value") - F.lag("value").over(_w_ev())).alias("d"))
    return d.agg(F.round(F.avg(F.col("d") * F.col("d")), 6).alias("smoothness"))


@query("mse_multiscale", " union all ".join(f"select {s} as scale, round(avg(d * d), 6) as mse from (select avg(value - y) as d from (select *, row_number() {_W} - 1 as i from {_RECON}) group by user_id, i // {s})" for s in (1, 4, 16)))
def _(spark, sf):
    rows = _recon(spark, sf).withColumn("i", F.row_number().over(_w_ev()) - 1).withColumn("scale", F.explode(F.array(F.lit(1), F.lit(4), F.lit(16))))
    d = rows.groupBy("scale", "user_id", F.floor(F.col("i") / F.col("scale")).alias("b")).agg(F.avg(F.col("value") - F.col("y")).alias("d"))
    return d.groupBy("scale").agg(F.round(F.avg(F.col("d") * F.col("d")), 6).alias("mse"))


@query("cost_model", "select event_type, round(raw, 9) as raw_gb, round(raw * 0.023 + raw * 4 * 0.004, 9) as monthly, round((raw - small) * (0.023 + 4 * 0.004), 9) as monthly_savings, round(12 * (raw - small) * (0.023 + 4 * 0.004), 9) as yearly_savings from (select event_type, count(*) * 4 / 1e9 as raw, (count(*) + 16) / 1e9 as small from events group by event_type)")
def _(spark, sf):
    """Prices of keeping values as float32, and what 8-bit codes with their two scales save."""
    n = _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    return M.costs(n.select("event_type", (F.col("n") * 4).alias("raw"), (F.col("n") + 16).alias("small")), "raw", "small").select("event_type", *(F.round(c, 9).alias(c) for c in ("raw_gb", "monthly", "monthly_savings", "yearly_savings")))


# ---- anomalies ------------------------------------------------------------------------------------------------


@query("anomaly_recon", f"with s as (select user_id, sqrt(avg(d2)) as rmse from {_RECON} group by user_id) select user_id, round(least(1.0, greatest(0.0, rmse / (2 * cut))), 6) as score, (rmse > cut)::int as flag from s, (select quantile_cont(rmse, 0.95) as cut from s)")
def _(spark, sf):
    s = _recon(spark, sf).groupBy("user_id").agg(F.sqrt(F.avg("d2")).alias("rmse"))
    return mining.thresholded(s, "rmse").select("user_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rmse") / (2 * F.col("cut")))), 6).alias("score"), "flag")


@query("anomaly_knn", """with k as (select id, avg(d) as m from (select q.vec_id as id, list_distance(q.embedding::double[], b.embedding::double[]) as d, row_number() over (partition by q.vec_id order by list_distance(q.embedding::double[], b.embedding::double[]), b.vec_id) as rn
    from embeddings q, embeddings b) where rn <= 5 group by id) select id, round(least(1.0, m / (2 * cut)), 6) as score, (m > cut)::int as flag from k, (select quantile_cont(m, 0.95) as cut from k)""")
def _(spark, sf):
    v = vectors(spark, sf)
    near = similarity.knn(v.select("id", "v"), v.select(F.col("id").alias("qid"), F.col("v").alias("q")), 5, "euclidean")
    m = near.groupBy(F.col("qid").alias("id")).agg(F.avg(F.sqrt("score")).alias("m"))
    return mining.thresholded(m, "m").select("id", F.round(F.least(F.lit(1.0), F.col("m") / (2 * F.col("cut"))), 6).alias("score"), "flag")


# ---- codec, mining --------------------------------------------------------------------------------------------

_BLOCKS = f"select user_id, win_id, len(v) * 4 as raw_bytes from (select user_id, i // 16 as win_id, list(value) as v from (select user_id, value, row_number() {_W} - 1 as i from events) group by user_id, i // 16)"


def _blocks(spark, sf) -> DataFrame:
    i = F.row_number().over(_w_ev()) - 1
    rows = _events(spark, sf).select("user_id", F.floor(i / 16).alias("win_id"), F.struct(i.alias("i"), F.col("value").cast("float").alias("x")).alias("r"))
    return rows.groupBy("user_id", "win_id").agg(F.array_sort(F.collect_list("r"))["x"].alias("values"))


_EXACT_SQL = f"select user_id, win_id, len(v) * 4::bigint as raw_bytes, true as ok, round(v[1]::double, 6) as first, round(v[-1]::double, 6) as last, round(list_sum([x::double for x in v]), 4) as total from (select user_id, i // 16 as win_id, list(value::float order by i) as v from (select user_id, value, row_number() {_W} - 1 as i from events) group by user_id, i // 16)"

for _mode in codec.MODES:

    @query(f"codec_roundtrip_{_mode}", _EXACT_SQL if _mode in codec.EXACT else f"select user_id, win_id, raw_bytes::bigint as raw_bytes, true as ok from ({_BLOCKS})")
    def _(spark, sf, mode=_mode):
        b = _blocks(spark, sf)
        back = codec.decompress(codec.compress(b.withColumn("was", F.col("values")), mode))
        span = F.array_max("was") - F.array_min("was")
        off = F.aggregate(F.zip_with("was", "values", lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda a, x: F.greatest(a, x))
        if mode not in codec.EXACT:
            allowed = {"quantized_8": 1 / 250}.get(mode, 1e-3)
            return back.select("user_id", "win_id", "raw_bytes", (off <= span * allowed + 1e-4).alias("ok"))
        v = F.col("values").cast("array<double>")
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        return back.select("user_id", "win_id", "raw_bytes", (off == 0).alias("ok"), F.round(v[0], 6).alias("first"), F.round(F.element_at(v, -1), 6).alias("last"), F.round(total, 4).alias("total"))


@query("quantized_8_values", f"""select user_id, win_id, [round(floor((x::double - lo) / greatest(hi - lo, 1e-10) * 255) / 255 * greatest(hi - lo, 1e-10) + lo, 3) for x in v] as v
    from (select *, list_min(v)::double as lo, list_max(v)::double as hi from (select user_id, i // 16 as win_id, list(value::float order by i) as v from (select user_id, value, row_number() {_W} - 1 as i from events) group by user_id, i // 16))""")
def _(spark, sf):
    """What the 8-bit mode gives back, value by value."""
    back = codec.decompress(codec.compress(_blocks(spark, sf), "quantized_8"), wide=True)
    return back.select("user_id", "win_id", V.rounded(F.col("values"), 3).alias("v"))


@query("compression_ratio")
def _(spark, sf):
    """Bytes and ratios of every mode over blocks of 16 values."""
    return M.compression_ratios(codec.sizes(_blocks(spark, sf)), ["mode"], F.col("raw_bytes"), blob_bytes=F.col("blob_bytes"))


@query("top_modes_report")
def _(spark, sf):
    """Modes by falling ratio, the first three with medals."""
    return M.report(QUERIES["compression_ratio"](spark, sf), "mode", "ratio")


@query("optimal_certificates")
def _(spark, sf):
    """Winner, sizes and gap of each block of the screened competition."""
    return codec.compress_optimal(_blocks(spark, sf), fast=True).drop("blob", "mode")


@query("transform_screening")
def _(spark, sf):
    """Each block's transforms by size."""
    return codec.candidates(_blocks(spark, sf))


@query("kmeans_labels")
def _(spark, sf):
    return mining.kmeans(vectors(spark, sf), 10)[0]


@query("kmeans_inertia")
def _(spark, sf):
    v = vectors(spark, sf)
    return mining.inertia(v, mining.kmeans(v, 10)[0].select("id", "label"))


@query("pca_explained")
def _(spark, sf):
    ratios = mining.pca(vectors(spark, sf), 8)[1]
    return spark.createDataFrame([(i, x) for i, x in enumerate(ratios)], "component int, explained double")


@query("pca_restored")
def _(spark, sf):
    """Error of each vector after its projection on the axes that hold 99 % of the variance."""
    v = vectors(spark, sf)
    axes = mining.fit_projection(v, 0.99)
    placed = v.select("id", "v", axes.project(F.col("v")).alias("z"))
    return placed.select("id", V.distance(F.col("v"), axes.restore(F.col("z"))).alias("error"))


_NEAR2 = "select a.vec_id as a, b.vec_id as b from embeddings a, embeddings b where (a.embedding[1]::double - b.embedding[1]::double) ** 2 + (a.embedding[2]::double - b.embedding[2]::double) ** 2 <= 0.05::double ** 2"
_DENSE = f"""with recursive p as materialized ({_NEAR2}), core as materialized (select a from p group by a having count(*) >= 5),
    l as materialized (select a, b from p semi join core using (a) where b in (select a from core)),
    r as (select a, a as label from core union select l.a, r.label from l join r on l.b = r.a),
    own as (select a, min(label) as label from r group by a),
    named as (select p.a as id, min(own.label) as label from p join own on own.a = p.b group by p.a)
    select vec_id as id, coalesce(own.label, named.label, -1) as label from embeddings left join own on own.a = vec_id left join named on named.id = vec_id"""


@query("dbscan", _DENSE)
def _(spark, sf):
    """Density clusters of the first two coordinates."""
    v = vectors(spark, sf).select("id", F.slice("v", 1, 2).alias("v"))
    return mining.dbscan(v, 0.05, 5)


@query("dbscan_inertia", f"with c as ({_DENSE}), x as (select c.label, embedding[1]::double as x, embedding[2]::double as y from c join embeddings on vec_id = id where c.label <> -1) select round(coalesce(sum(v), 0.0::double), 6) as inertia from (select (var_pop(x) + var_pop(y)) * count(*) as v from x group by label)")
def _(spark, sf):
    v = vectors(spark, sf).select("id", F.slice("v", 1, 2).alias("v"))
    return mining.inertia(v, mining.dbscan(v, 0.05, 5)).select(r6("inertia"))


@query("anomaly_iforest")
def _(spark, sf):
    return mining.isolation(vectors(spark, sf))


@query("anomaly_combined")
def _(spark, sf):
    """Mean of the neighbour and isolation scores."""
    v = vectors(spark, sf)
    near = QUERIES["anomaly_knn"](spark, sf).select("id", "score")
    return mining.combined({"near": near, "depth": mining.scaled_isolation(mining.isolation(v))})


# ---- tiers, frames, containers, store ---------------------------------------------------------------------------

_WIN16 = f"(select user_id, i // 16 as win_id, list(value::float order by i) as v from (select user_id, value, row_number() {_W} - 1 as i from events) group by user_id, i // 16 having count(*) = 16)"


def _tier_windows(spark, sf) -> DataFrame:
    """Full windows of 16 events with one id each."""
    b = _blocks(spark, sf).filter("size(values) = 16")
    return b.select(F.concat_ws("-", "user_id", "win_id").alias("win_id"), "values")


def _tier_model(w: DataFrame) -> tiers.Model:
    return tiers.fit(w, 16, 1, 4, top_codes=8, codes=16, levels=2)


@query("tier_lossless_values", f"select concat(user_id, '-', win_id) as win_id, [round(x::double, 6) for x in v] as v from {_WIN16}")
def _(spark, sf):
    """Windows from their codes and the bits in which they differ."""
    w = _tier_windows(spark, sf)
    m = _tier_model(w)
    return tiers.decode_lossless(tiers.encode_lossless(w, m), m).select("win_id", F.transform(F.col("values").cast("array<double>"), lambda x: F.round(x, 6)).alias("v"))


@query("tier_storage_values", f"select concat(user_id, '-', win_id) as win_id, [round(x::double, 6) for x in v] as v from {_WIN16}")
def _(spark, sf):
    """Windows from the storage tier."""
    w = _tier_windows(spark, sf)
    _, storage = tiers.tiered(w, _tier_model(w), "lossless_fast")
    return codec.decompress(storage).select("win_id", F.transform(F.col("values").cast("array<double>"), lambda x: F.round(x, 6)).alias("v"))


@query("tier_scales", f"select concat(user_id, '-', win_id) as win_id, round(list_avg([x::double for x in v])::float::double, 2) as mean, round(sqrt(list_var_pop([x::double for x in v]) + 1e-5)::float::double, 2) as scale from {_WIN16}")
def _(spark, sf):
    """The mean and scale that each window is kept with."""
    w = _tier_windows(spark, sf)
    c = tiers.encode(w, _tier_model(w))
    return c.select("win_id", F.round(F.col("means")[0].cast("double"), 2).alias("mean"), F.round(F.col("scales")[0].cast("double"), 2).alias("scale"))


@query("tier_stats")
def _(spark, sf):
    w = _tier_windows(spark, sf)
    m = _tier_model(w)
    return tiers.tier_stats(*tiers.tiered(w, m), m)


@query("tier_search")
def _(spark, sf):
    """Windows nearest to every hundredth one by what their codes stand for."""
    w = _tier_windows(spark, sf)
    m = _tier_model(w)
    c = tiers.encode(w, m)
    asked = c.filter(F.pmod(F.xxhash64("win_id"), F.lit(100)) == 0)
    return tiers.search(c, asked, m, 5, "values").select("qid", "id", "rnk", "score")


@query("tier_error", f"select count(*) as n, true as ok from {_WIN16}")
def _(spark, sf):
    """Whether what the codes stand for is nearer to the windows than their means are."""
    w = _tier_windows(spark, sf)
    m = _tier_model(w)
    near = tiers.decode_search(tiers.encode(w, m), m).withColumnRenamed("values", "y").join(w, "win_id")
    v = F.col("values").cast("array<double>")
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size("values")
    off = V.squared_distance(v, F.col("y").cast("array<double>"))
    return near.agg(F.count("*").alias("n"), (F.sum(off) < 0.5 * F.sum(V.squared_distance(v, F.transform(v, lambda x: mean)))).alias("ok"))


@query("frame_roundtrip", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority from orders")
def _(spark, sf):
    """A table packed column by column and unpacked."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    back = frames.decompress_frame(frames.compress_frame(o), o.schema)
    return back.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("frame_ratio")
def _(spark, sf):
    return frames.frame_ratio(table(spark, sf, "lineitem"), by_column=True)


@query("numeric_totals", "select count(*) as n, sum(o_orderkey)::bigint as o_orderkey, sum(o_custkey)::bigint as o_custkey, round(sum(o_totalprice), 2) as o_totalprice from orders")
def _(spark, sf):
    """Number columns of a table alone."""
    o = frames.numeric_columns(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    return o.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in o.columns if c != "o_totalprice"), F.round(F.sum("o_totalprice"), 2).alias("o_totalprice"))


@query("container_rows", "select vec_id as id, [round(x::double, 6) for x in embedding] as coordinates from embeddings where vec_id in (3, 77, 401, 99999999)")
def _(spark, sf):
    """Some rows of one block of a container."""
    path = scratch_path(spark, "container")
    v = vectors(spark, sf).select("id", F.col("v").alias("coordinates"), F.lit(1.0).alias("confidence"))
    files.write_container(v, path, source="embeddings")
    return files.read_container(spark, path, ["coordinates"], [3, 77, 401, 99999999]).select("id", V.rounded(F.col("coordinates")).alias("coordinates"))


def _stored(spark, sf, metric: str) -> store.VectorStore:
    s = store.VectorStore(spark, scratch_path(spark, "store"))
    s.create_index("e", 64, metric)
    e = table(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("values"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), F.lit(1).alias("seq"))
    s.upsert("e", rows)
    return s


for _m in _SCORES:

    @query(f"store_query_{_m}", f"select qid, id::varchar as id, rnk, score from ({_knn_sql(_m, 10, 'b.label in (1, 3, 5)').replace('b.embedding::double[]', 'b.embedding::float[]::double[]')})")
    def _(spark, sf, m=_m):
        """A stored index asked for the best vectors of some labels."""
        s = _stored(spark, sf, m)
        found = s.query("e", asked(vectors(spark, sf)), 10, where={"label": {"$in": [1, 3, 5]}})
        return found.select("qid", "id", "rnk", r6("score"))


@query("store_after_writes", "select label::varchar as label, count(*) as n from (select case when vec_id % 10 = 0 then 99 else label end as label from embeddings where vec_id % 50 <> 7) group by 1")
def _(spark, sf):
    """An index after an upsert that changes every tenth vector and a delete of every fiftieth."""
    s = _stored(spark, sf, "cosine")
    e = table(spark, sf, "embeddings")
    new = e.filter("vec_id % 10 = 0").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("values"), F.create_map(F.lit("label"), F.lit("99")).alias("metadata"), F.lit(2).alias("seq"))
    s.upsert("e", new)
    s.delete("e", [r[0] for r in e.filter("vec_id % 50 = 7").select(F.col("vec_id").cast("string")).collect()])
    return s.vectors("e").groupBy(F.col("metadata")["label"].alias("label")).agg(F.count("*").alias("n"))


@query("store_stats", "select coalesce(ns, 'all') as namespace, count(*) as vectors, sum(len(embedding) * 4)::bigint as raw_bytes from (select embedding, 'default' as ns from embeddings) group by rollup(ns)")
def _(spark, sf):
    return _stored(spark, sf, "cosine").stats("e").select(F.coalesce("namespace", F.lit("all")).alias("namespace"), "vectors", "raw_bytes")


@query("metadata_json", "select event_id, event_type, json_extract(props, '$.k')::int as k from events")
def _(spark, sf):
    """Metadata written as JSON text and read again."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    text = e.select("event_id", to_metadata(["event_type", "k"]).alias("m"))
    back = from_metadata(F.col("m"), "event_type string, k int")
    return text.select("event_id", back["event_type"].alias("event_type"), back["k"].alias("k"))


@query("masked_lookup", f"select n.id, [round(case when n.code % 5 = 0 then 0.0::double else x::double end, 6) for x in e.embedding] as cv from {_NEAR} n join embeddings e on e.vec_id = n.code where rn = 1")
def _(spark, sf):
    """Codewords of codes, some of which are masked as -1."""
    v = vectors(spark, sf)
    codes = quantise.assign(v, _book(v)).select("id", F.when(F.col("code") % 5 == 0, -1).otherwise(F.col("code")).alias("code"))
    return quantise.masked_lookup(codes, _book(v)).select("id", V.rounded(F.col("cv")).alias("cv"))


@query("codebook_revived", f"select b.vec_id as code, count(n.id) filter (where n.rn = 1) > 0 as used from embeddings b left join {_NEAR} n on n.code = b.vec_id and n.rn = 1 where b.vec_id < 16 group by 1")
def _(spark, sf):
    """Which codewords stay when those without a vector are replaced."""
    v = vectors(spark, sf)
    book = _book(v)
    new = quantise.revive(quantise.assign(v, book), book)
    same = F.forall(F.zip_with("cv", "old", lambda x, y: x == y), lambda x: x)
    return new.join(book.withColumnRenamed("cv", "old"), "code").select("code", same.alias("used"))


@query("cost_model_measured")
def _(spark, sf):
    """Prices before and after the screened competition."""
    b = codec.compress(_blocks(spark, sf), "optimal_fast")
    return M.costs(b.agg(F.sum("raw_bytes").alias("raw"), F.sum(F.octet_length("blob")).alias("small")), "raw", "small")


# ---- streaming ------------------------------------------------------------------------------------------------


@query("chunks_stream", f"select user_id as key, i // 8 as chunk, count(*) as n from (select user_id, row_number() {_W} - 1 as i from events) group by user_id, i // 8 having count(*) = 8")
def _(spark, sf):
    out = scratch_path(spark, "stream")
    # the state store provider holds for this stream's session alone
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = own.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    made = chunked(source, "user_id", "value", 8).select("key", "chunk", "n")
    run = made.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("key long, chunk long, n long").parquet(f"{out}/rows")


@query("chunks_rest", f"select user_id as key, max(i // 8) as chunk, count(*) as n, round(sum(value), 4) as total from (select user_id, value, row_number() {_W} - 1 as i, count(*) over (partition by user_id) as c from events) where i >= c // 8 * 8 group by user_id")
def _(spark, sf):
    """What a stream of chunks still holds back at the end."""
    rows = chunks.rest(_events(spark, sf), "user_id", _ORDER, "value", 8)
    return rows.select("key", "chunk", "n", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("chunks_joined", f"select user_id as key, row_number() {_W} - 1 as i, round(value::float::double, 4) as value from events")
def _(spark, sf):
    """Values of all chunks of a series after their blobs are decoded."""
    made = chunks.encoded(_blocks(spark, sf).select(F.col("user_id").alias("key"), F.col("win_id").alias("chunk"), "values"))
    return chunks.joined(chunks.decoded(made)).select("key", "i", F.round(F.col("value").cast("double"), 4).alias("value"))


@query("chunk_lists", f"select user_id as key, (count(*) + 15) // 16 as n from events group by user_id")
def _(spark, sf):
    """Chunks of a series packed in one list and taken out again."""
    made = chunks.encoded(_blocks(spark, sf).select(F.col("user_id").alias("key"), F.col("win_id").alias("chunk"), "values"))
    return files.listed_chunks(files.chunk_lists(made, ["key"], "chunk")).groupBy("key").agg(F.count("*").alias("n"))


@query("event_windows", "select event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, count(*) as n, round(sum(value), 3) as total from events group by 1, 2")
def _(spark, sf):
    made = windowed(table(spark, sf, "events"), "ts", "event_type", "value")
    return made.select("event_type", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n", F.round("total", 3).alias("total"))
