"""Values with a time to live: they end by a timer, without a newer event of their key."""
from datetime import datetime, timedelta

from tidegauge.session import scratch
from tidegauge.streaming import expiry as X
from tidegauge.streaming import streams as S

T0 = datetime(2024, 1, 1)
COLUMNS = ["event_id", "value"]


def run(spark, steps, delay="0 seconds"):
    """Each step is one file and one micro-batch of (user, hours, event, value)."""
    folder = scratch(spark, "arrivals")
    for rows in steps:
        d = spark.createDataFrame([(u, T0 + timedelta(hours=h), e, v) for u, h, e, v in rows], "user_id long, ts timestamp, event_id long, value double")
        d.coalesce(1).write.mode("append").parquet(folder)
    s = X.expiring_values(S.file_stream(spark, folder, d, files_per_batch=1), "ts", "user_id", ["ts", "event_id"], COLUMNS, 3 * 3600, delay)
    with X.rocks_state(spark):
        out = S.drain_to_table(s, "update", "expiring")
    served = {r["user_id"]: (r["event_id"], r["value"]) for r in X.current_values(out, "user_id", COLUMNS, 3 * 3600).collect()}
    return out, served


def test_a_value_expires_without_a_newer_event_of_its_key(spark):
    out, served = run(spark, [[(1, 0, 10, 0.5), (2, 0, 11, 1.5)], [(2, 2, 12, 2.5)], [(3, 4, 13, 3.5)], [(3, 4.5, 14, None)]])
    ended = {(r["user_id"], r["at"]) for r in out.where("not live").collect()}
    # user 1 ends at hour 3, moved by the others' events; user 2's first timer was replaced
    assert ended == {(1, int(datetime(2024, 1, 1, 3).timestamp() * 1e6))}
    assert served == {2: (12, 2.5), 3: (14, None)}


def test_ties_older_rows_and_comebacks(spark):
    out, served = run(spark, [[(1, 5, 10, 0.1), (1, 5, 12, 0.2), (1, 4, 99, 0.3)], [(1, 5, 11, 0.4), (2, 9, 20, 1.0)], [(2, 9.5, 21, 1.1)], [(1, 10, 30, 0.5)]], "1 hour")
    reports = [(r["live"], r["event_id"]) for r in out.where("user_id = 1").orderBy("batch", "at").collect()]
    assert reports == [(True, 12), (False, None), (True, 30)]  # the smaller event id of the same time changes nothing
    assert served == {1: (30, 0.5), 2: (21, 1.1)}
