"""Outcomes of a stream whose attempts come in any order, against the batch form."""

import datetime as dt
import random

import pytest

from factloom.operators import facts
from factloom.streaming import incremental

SCHEMA = "detail_id long, attempt int, kind string, doc_count long, grid_present boolean, at timestamp"
START = dt.datetime(2024, 1, 1)


def attempts(seed: int, keys: int = 120) -> list[tuple]:
    x, out = random.Random(seed), []
    for k in range(keys):
        for n in range(1, x.randint(1, 5) + 1):
            if x.random() < 0.9:  # some attempts never come
                out.append((k, n, x.choice(["ok", "ok", "ok", "exception", "fetch_failed"]), x.choice([0, 0, 1, 2]), x.random() < 0.5, START + dt.timedelta(minutes=n)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_and_batch_agree_on_shuffled_batches(spark, tmp_path, seed):
    rows = attempts(seed)
    random.Random(seed).shuffle(rows)
    cut = len(rows) // 3 + 1
    end = [(None, None, None, None, None, START + dt.timedelta(days=1))]
    for part in [rows[:cut], rows[cut : 2 * cut] + [(7, None, "ok", 1, True, START), (7, 9, "ok", 1, True, START)], rows[2 * cut :] + rows[:5], end]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = incremental.outcome_stream(incremental.stream_of(spark, str(tmp_path / "in"), SCHEMA))
        incremental.append_new(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("detail_id", "outcome", "doc_count").collect()]
    want = [tuple(r) for r in facts.agreement(spark.createDataFrame(rows, SCHEMA), 3).collect()]
    assert sorted(got) == sorted(want)
    assert {r[1] for r in got} == {"PARSED_DOCS", "PARSED_ZERO_DOCS", "GRID_ABSENT", "UNSTABLE", "PARSE_ERROR", "FETCH_FAILED"}


def test_what_waits_is_not_told():
    told = incremental.decided
    assert told({1: ("ok", 2, True), 3: ("ok", 2, True)}, 3, False) is None  # the second is still missing
    assert told({1: ("ok", 2, True), 3: ("ok", 2, True)}, 3, True) == ("PARSED_DOCS", 2)
    assert told({1: ("ok", 2, True), 2: ("fetch_failed", 0, False), 3: ("ok", 2, True)}, 3, False) == ("PARSED_DOCS", 2)
    assert told({1: ("ok", 0, False), 2: ("exception", 0, False), 3: ("ok", 0, False)}, 3, False) == ("PARSED_ZERO_DOCS", 0)
    assert told({1: ("ok", 1, True), 2: ("ok", 3, True), 3: ("ok", 2, True)}, 3, False) == ("UNSTABLE", 3)
    assert told({2: ("fetch_failed", 0, False)}, 3, True) == ("FETCH_FAILED", 0)


def test_no_attempts(spark):
    assert facts.agreement(spark.createDataFrame([], SCHEMA), 3).collect() == []
