from pyspark.sql import functions as F

from tagloom.streaming import tags


def test_stream_counts_as_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", F.array("event_type", F.concat(F.lit("u"), F.col("user_id") % 3)).alias("tags"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counted = tags.tag_counts(stream, late="60 days")
    run = counted.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    batch = tags.tag_counts(spark.read.parquet(f"{tmp_path}/in"))
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_of_edits_as_batch(spark, tmp_path):
    """Undo and redo over many batches end where the batch operator ends."""
    from tagloom.operators import catalog
    from tagloom.plans.further import _steps
    from tagloom.streaming import edits

    steps = _steps(spark, "/root/testdata/sf0.001").withColumn("seq", F.unix_micros(F.col("seq").cast("timestamp")))
    bounds = steps.approxQuantile("seq", [0.0, 0.25, 0.5, 0.75, 1.0], 0.01)
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = steps.where((F.col("seq") >= int(low)) & ((F.col("seq") < int(high)) | F.lit(i == 3)))
        part.repartition(1).write.mode("append").parquet(f"{tmp_path}/in")
    conf, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = edits.replayed(stream, depth=5)
        run = out.writeStream.foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/log").outputMode("update").start()
        run.processAllAvailable()
        run.stop()
    finally:
        spark.conf.set(conf, before)
    found = spark.read.parquet(f"{tmp_path}/out").groupBy("item_id").agg(F.max_by(F.struct("state", "undos", "redos"), "n").alias("s")).select("item_id", "s.*")
    assert spark.read.parquet(f"{tmp_path}/out").select("n").distinct().count() == 4
    rows = lambda df: sorted((r.item_id, r.state, r.undos, r.redos) for r in df.collect())
    assert rows(found) == rows(catalog.replayed(steps, depth=5))


def test_idle_items_are_forgotten():
    """The timer moves with each batch, and clears an item's stacks."""
    import pandas as pd

    from tagloom.streaming import edits

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    class Handle:
        def __init__(self):
            self.value, self.timers = Value(), []
            self.getValueState = lambda name, schema: self.value
            self.listTimers, self.registerTimer, self.deleteTimer = lambda: iter(self.timers), self.timers.append, self.timers.remove

    class Now:
        def __init__(self, at):
            self.getCurrentProcessingTimeInMs = lambda: at

    handle, replay = Handle(), edits.Replay(depth=2, idle=50)
    replay.init(handle)
    step = lambda *rows: iter([pd.DataFrame(rows, columns=["seq", "kind", "state"])])
    list(replay.handleInputRows(("a",), step((2, "edit", "y"), (1, "edit", "x"), (3, "edit", "z"), (4, "edit", "w")), Now(100)))
    (last,) = replay.handleInputRows(("a",), step((5, "undo", None)), Now(120))
    assert last.to_dict("records") == [{"item_id": "a", "state": "z", "undos": 1, "redos": 1}] and handle.timers == [170]
    assert list(replay.handleExpiredTimer(("a",), Now(170), None)) == [] and not handle.value.exists()
