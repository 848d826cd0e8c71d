"""Streaming run-log fold and sink agree with the batch operators."""

import uuid

from mutscope.operators import runlog as R
from mutscope.session import ensure_checkpoint_dir, table
from mutscope.streaming import runlog_stream as RS
from tests.conftest import SF001


def test_run_state_stream_matches_batch(spark):
    batch = table(spark, SF001, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(SF001)
    name = f"state_{uuid.uuid4().hex[:8]}"
    q = (RS.run_state_stream(stream, "user_id", "ts", "event_id", ["event_type", "value"])
         .writeStream.outputMode("complete").format("memory").queryName(name).start())
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()}
    want = {tuple(r) for r in R.run_state(batch, "user_id", "ts", "event_id", ["event_type", "value"]).collect()}
    assert got == want


def test_sink_to_store_is_partitioned_and_complete(spark):
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    log = R.RunLog.bound(spark, SF001)
    rows = R.log_join(log, with_run=False).select("run_id", "round_id", "variant_id", "assay_score")
    src = base + "/src"
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = RS.sink_to_store(stream, base + "/store", "round_top_variant", base + "/ckpt", trigger_once=True)
    q.awaitTermination()
    back = spark.read.parquet(base + "/store/round_top_variant")
    assert back.count() == rows.count()
    assert "run_id" in back.columns
