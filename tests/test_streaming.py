from loomspan.streaming.chunks import chunked, windowed


def test_stream_chunks_equal_the_batch_count(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(k, float(i)) for k in range(3) for i in range(7 + 5 * k)]
    spark.createDataFrame(rows, "k long, x double").repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, x double").parquet(f"{tmp_path}/in")
    q = chunked(stream, "k", "x", 4).writeStream.format("memory").queryName("chunks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(90)
    got = spark.table("chunks").groupBy("key").count().collect()
    assert {r.key: r["count"] for r in got} == {0: 1, 1: 3, 2: 4}


def test_rows_beyond_the_watermark_are_left_out(spark, tmp_path):
    kind = "ts timestamp, k string, x double"

    def deliver(*rows):
        df = spark.sql(" union all ".join(f"select timestamp'2024-01-01 {at}' as ts, '{k}' as k, {x}d as x" for at, k, x in rows))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        run = windowed(stream, "ts", "k", "x").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination(90)

    deliver(("00:10:00", "a", 1), ("00:50:00", "a", 2), ("00:59:00", "b", 4))
    deliver(("01:05:00", "a", 8), ("00:58:00", "a", 16))  # out of order, within ten minutes
    deliver(("03:00:00", "a", 32))
    deliver(("00:20:00", "a", 64), ("05:00:00", "a", 128))  # the first is too late
    got = {(r.k, str(r.start)[11:13]): (r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", "00"): (3, 19.0), ("b", "00"): (1, 4.0), ("a", "01"): (1, 8.0), ("a", "03"): (1, 32.0)}
