"""Streams whose keys share states: a few states, whatever the number of keys, and the same rows as key by key."""

import datetime as dt
import random

from factloom.operators import facts
from factloom.streaming import incremental


def told(stream, at) -> int:
    """Rows of the state store after what has arrived is appended."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_agreement_of_many_keys_in_few_states(spark, tmp_path):
    schema, x = "detail_id long, attempt int, kind string, doc_count long", random.Random(3)
    big = 2**60 + 1  # a double doesn't hold it
    parts = [[(None if k == 0 else big + k, 3 * p + n, x.choice(["ok", "ok", "ok", "exception", "fetch_failed", None]), x.choice([0, 1, 2, None])) for k in range(500) for n in range(3)] for p in range(3)]
    for rows in parts:
        x.shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        states = told(incremental.agreement_stream(incremental.stream_of(spark, f"{tmp_path}/in", schema), 16), tmp_path)
    want, last = {}, {}
    for key, _, kind, n in sorted((r for rows in parts for r in rows), key=lambda r: r[1]):
        if kind == "exception" or key in want:
            continue
        if kind != "ok" or n is None:
            last.pop(key, None)
        elif last.get(key) == n:
            want[key] = n
        else:
            last[key] = n
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("detail_id", "outcome", "doc_count").collect()]
    assert len(got) == len(want) > 100
    assert set(got) == {(k, "PARSED_DOCS" if n else "PARSED_ZERO_DOCS", n) for k, n in want.items()}
    assert states <= 16


def test_outcomes_of_many_keys_in_few_states(spark, tmp_path):
    """Keys of a state end at their own times: some by silence while others of it still get attempts, and all by the last row."""
    schema, x, start = "detail_id long, attempt int, kind string, doc_count long, grid_present boolean, at timestamp", random.Random(4), dt.datetime(2024, 1, 1)
    big = 2**60 + 1
    row = lambda k, n: (big + k, n, x.choice(["ok", "ok", "exception", "fetch_failed"]), x.choice([0, 1, 2, None]), x.choice([True, False, None]), start + dt.timedelta(hours=k % 4, minutes=n))
    rows = [row(k, n) for k in range(400) for n in (1, 2, 3) if x.random() < 0.8]
    parts = [[r for r in rows if (r[0] - big) % 4 == h] for h in range(4)] + [[(None, None, None, None, None, start + dt.timedelta(days=1))]]
    early = None
    for part in parts:
        x.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        states = told(incremental.outcome_stream(incremental.stream_of(spark, f"{tmp_path}/in", schema), buckets=8), tmp_path)
        assert states <= 8  # a state for each key before
        if part is parts[2]:
            early = {r.detail_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert states == 0
    assert {r[0] for r in rows if (r[0] - big) % 4 == 0} <= early  # silent for two hours, although their states went on
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("detail_id", "outcome", "doc_count").collect()]
    clean = [(k, n, kind, c or 0, bool(g), at) for k, n, kind, c, g, at in rows]
    want = [tuple(r) for r in facts.agreement(spark.createDataFrame(clean, schema), 3).select("detail_id", "outcome", "doc_count").collect()]
    assert sorted(got) == sorted(want)
