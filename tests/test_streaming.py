from sessionloom.operators import orphans
from sessionloom.streaming import counts_by_type, feed_orphans, session_lines


def test_lines_and_counts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"session","id":"s"}\n{"type":"message","id":"m","parentId":"s"}\nbad\n')
    q = counts_by_type(session_lines(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("line_counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.record_type: r.n for r in spark.table("line_counts").collect()} == {"session": 1, "message": 1}


def test_stream_feeds_orphan_state(spark, tmp_path):
    from test_orphans import SCHEMA, brute, sample

    rows = sample(9, 40)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    state = orphans.OrphanState(spark)
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(str(tmp_path / "in"))
    feed_orphans(stream, state, str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.table_name, r.record_key, r.ref_field) for r in state.pending().collect()} == brute(rows)


def test_restart_goes_on_with_stored_state(spark, tmp_path):
    """Two runs over one landing folder, with a fresh state object, and one batch delivered twice."""
    from test_orphans import SCHEMA, brute, sample

    rows, folder = sorted(sample(11, 60), key=lambda r: r[2]), tmp_path / "in"
    schema = spark.createDataFrame([], SCHEMA).schema
    for k, part in enumerate((rows[:35], rows[35:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        state = orphans.OrphanState(spark, str(tmp_path / "state"), buckets=4)
        assert state.seq == k
        feed_orphans(spark.readStream.schema(schema).parquet(str(folder)), state, str(tmp_path / "cp")).awaitTermination(240)
    state.advance(spark.createDataFrame(rows[35:], SCHEMA))
    state = orphans.OrphanState(spark, str(tmp_path / "state"), buckets=4)
    assert {(r.table_name, r.record_key, r.ref_field) for r in state.pending().collect()} == brute(rows)
