"""What streams do when batches run again, runs go on, and keys fall silent."""

from __future__ import annotations

import time
from datetime import datetime

from furrow.session import scratch
from furrow.streaming import flows


def _keys(spark, path):
    return sorted(r.k for r in spark.read.parquet(path).collect())


def test_a_batch_that_runs_again_keeps_what_it_logged(spark):
    path = scratch(spark, "status")
    sink = flows.resume(path, "k", "good")
    first, second = (spark.createDataFrame([(k, True) for k in ks] + [(9, False)], "k long, good boolean") for ks in ((1, 2), (2, 3, 4)))
    sink(first, 0)
    for _ in range(3):
        sink(second, 1)
        assert _keys(spark, path) == [1, 2, 3, 4]
    sink(first, 0)
    assert _keys(spark, path) == [1, 2, 3, 4]


def _write(spark, path, rows):
    spark.createDataFrame(rows, "k long, ts timestamp, n long, failed boolean").coalesce(1).write.mode("append").parquet(path)


def test_a_run_goes_on_from_its_checkpoint_and_silent_keys_stall(spark):
    path, out, checkpoint = (scratch(spark, x) for x in ("in", "out", "checkpoint"))
    at = datetime(2024, 1, 1)
    for rows in ([(1, at, 1, True), (1, at, 2, True)], [(2, at, 3, False)]):
        _write(spark, path, rows)
        stream = flows.files_stream(spark, path, spark.read.parquet(path).schema)
        flows.run(flows.watchdog(stream, "k", "ts", "n", "failed", 3600.0, 2, silence="1s"), "append", flows.by_batch(out), checkpoint, timers=True)
        time.sleep(2)
    got = sorted((r.batch, r.k, r.longest, r.tripped, r.stalled) for r in spark.read.parquet(out).collect())
    assert (0, 1, 2, True, False) in got and (2 in {k for _, k, *_ in got})
    assert any(batch > 0 and k == 1 and stalled for batch, k, _, _, stalled in got)


def test_sessions_and_windows_keep_no_state_for_ever(spark):
    """They run in append and update mode, in which the watermark drops what is over."""
    import inspect

    from furrow.plans import q_streams

    assert '"complete"' not in inspect.getsource(q_streams)
