"""State on streams: the latch, the event queue, and the word counts read from the state store."""

from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from conftest import SF_SMOKE
from pyspark.sql import functions as F

from lexitally.streaming import queries as Q, sinks, stateful
from lexitally.streaming.sources import stream_folder
from lexitally.plans.catalog import QUERIES

DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)


def us(t):
    return round(t.timestamp() * 1e6)


@pytest.mark.parametrize("parts", [1, 5])
def test_latch_and_queue_over_several_starts(spark, monkeypatch, parts):
    monkeypatch.setattr(Q, "PARTS", parts)
    fired = Q.q_stream_first_crossing(spark, SF_SMOKE).collect()
    assert len({r.run_key for r in fired}) == len(fired)          # the stream's own rows: once a run
    assert sorted(map(tuple, fired)) == sorted(map(tuple, QUERIES["q_first_crossing"](spark, SF_SMOKE).collect()))
    text = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert text(Q.q_stream_attach_events(spark, SF_SMOKE).collect()) == text(QUERIES["q_attach_events"](spark, SF_SMOKE).collect())


class Arriving:
    """A stream whose batches are given one by one, each in a start of its own."""

    def __init__(self, spark, tmp, schema, query):
        self.spark, self.tmp, self.schema, self.query = stateful.state_session(spark), tmp, schema, query
        self.seen = Counter()

    def __call__(self, rows):
        like = self.spark.createDataFrame(rows, self.schema)
        like.write.mode("append").parquet(f"{self.tmp}/in")
        sinks.run_append(self.query(stream_folder(self.spark, f"{self.tmp}/in", like)), f"{self.tmp}/out", f"{self.tmp}/ckpt")
        now = Counter(map(tuple, self.spark.read.parquet(f"{self.tmp}/out").collect()))
        new, self.seen = now - self.seen, now
        return sorted(new.elements(), key=str)


def test_latch_fires_once_and_ends_when_idle(spark, tmp):
    go = Arriving(spark, tmp, "run_key long, ts timestamp, progress double",
                  lambda s: stateful.first_crossings(s, 50.0, watermark="1 hour", idle_days=10))
    at = lambda d: DAY + timedelta(days=d)
    assert go([(1, at(0), 10.0), (1, at(2), 60.0), (1, at(1), 50.0), (1, at(1), 55.0), (2, at(1), 49.9), (None, at(1), 70.0)]) == [
        (1, us(at(1)), 55.0), (None, us(at(1)), 70.0)]
    assert go([(1, at(3), 90.0), (2, at(3), 51.0), (3, None, 99.0), (4, at(3), None)]) == [(2, us(at(3)), 51.0)]
    assert go([(1, at(4), 90.0), (2, at(4), 51.0)]) == []
    ckpt = f"{tmp}/ckpt"
    held = lambda: stateful.state_session(spark).read.format("statestore").option("stateVarName", "last").load(ckpt).count()
    assert held() == 3
    assert go([(5, at(40), 80.0)]) == [(5, us(at(40)), 80.0)]
    assert go([(6, at(41), 80.0)]) == [(6, us(at(41)), 80.0)]
    assert held() == 2                                            # the runs of the first days are gone


def test_queue_pops_one_event_a_tick_and_survives_restarts(spark, tmp):
    schema = "run_key long, ts timestamp, cpu double, mem_bytes double, event string"
    go = Arriving(spark, tmp, schema, lambda s: stateful.live_attach(s.where("event is null"), s.where("event is not null")))
    at = lambda m: DAY + timedelta(minutes=m)
    tick = lambda m, run=1: (run, at(m), 1.5, 2.0, None)
    event = lambda m, e, run=1: (run, at(m), None, None, e)
    row = lambda m, e, n=1, run=1: (run, us(at(m)), n, 1.5 * n, 2.0 * n, e)
    assert go([tick(0), event(1, "b"), event(1, "a"), event(1, "a"), tick(2), tick(2), event(3, "c"), tick(3, None)]) == sorted(
        [row(0, None), row(2, "a", 2), row(3, None, run=None)], key=str)
    assert go([event(4, "d", None), tick(4), tick(5)]) == [row(4, "a"), row(5, "b")]
    assert go([tick(6), tick(7), tick(8, None), event(8, "late")]) == sorted([row(6, "c"), row(7, None), row(8, "d", run=None)], key=str)
    assert go([tick(9, 2)]) == [row(9, None, run=2)]
    assert go([tick(10)]) == [row(10, "late")]


def test_state_holds_the_counts_before_and_after_the_restart(spark):
    got = defaultdict(dict)
    for start, word, n in Q.q_stream_wordcount_state(spark, SF_SMOKE).collect():
        assert word not in got[start]
        got[start][word] = n
    assert got[2] == {r.word: r.n for r in QUERIES["q_alpha_word_freq"](spark, SF_SMOKE).collect()}
    docs = spark.read.parquet(f"{SF_SMOKE}/documents.parquet").where(F.pmod("doc_id", F.lit(2)) == 0)
    from lexitally.operators.wordcount import word_freq
    assert got[1] == {r.word: r.n for r in word_freq(docs, "text").collect()}
