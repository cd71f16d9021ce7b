"""Streams run to their end over several batches; results lie in files, not on the driver."""

import time

import pytest

from leadlens.streaming import windows


@pytest.mark.parametrize("form", [windows.tumbling, windows.sliding_quota, windows.mx_state])
def test_batches_give_what_one_gives(spark, data, tmp_path, monkeypatch, form):
    given = in_order(spark, data, tmp_path, 3)
    order = lambda df: sorted(map(tuple, df.collect()))
    one = windows.run_to_end(spark, data, form)
    assert one.inputFiles()
    monkeypatch.setattr(windows, "FILES", 1)
    assert order(windows.run_to_end(spark, given, form)) == order(one)


def in_order(spark, data, tmp_path, n):
    """The events in files by time, the older written first."""
    events = spark.read.parquet(f"{data}/events.parquet")
    parts = events.selectExpr("*", f"ntile({n}) OVER (ORDER BY ts, event_id) AS part")
    for k in range(1, n + 1):
        parts.where(f"part = {k}").drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(1.1)  # a stream takes files by the second they were written in
    return str(tmp_path)


@pytest.mark.parametrize("form", [windows.tumbling, windows.mx_state])
def test_restart_goes_on_from_the_log(spark, data, tmp_path, monkeypatch, form):
    """A stream that stops and starts again over more files, and one whose last batch is repeated, give what one run gives."""
    monkeypatch.setattr(windows, "FILES", 1)
    monkeypatch.setattr(windows, "WHOLE", 2)
    order = lambda df: sorted(map(tuple, df.collect()))
    want = order(windows.run_to_end(spark, data, form))
    given, base = in_order(spark, data, tmp_path / "all", 4), f"file://{tmp_path}/base"
    files = sorted((tmp_path / "all" / "events.parquet").glob("*.parquet"), key=lambda f: f.stat().st_mtime)
    for f in files[2:]:
        f.rename(tmp_path / f.name)
    windows.run_to_end(spark, given, form, base)
    for f in files[2:]:
        (tmp_path / f.name).rename(f)
    last = max((tmp_path / "base" / "log" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    last.unlink()  # as if the driver had been lost before it could note the batch
    assert order(windows.run_to_end(spark, given, form, base)) == want
