"""The watch for silent sources, against a watch that looks at every tick."""

import datetime as dt
import random

import pytest

from meshlake.streaming import watch as H

START = 1_700_000_000
UTC = dt.timezone.utc


def stamp(t):
    return dt.datetime.fromtimestamp(t, UTC)


def ticking(messages, sources, now, threshold, tick, heartbeat):
    """One look after another, as a loop with a registry does it."""
    out, seen = [], {}
    for s, t in sorted(messages, key=lambda m: m[1]):
        seen.setdefault(s, []).append(t)
    out += [(s, "first_message", ts[0], 0.0) for s, ts in seen.items()]
    for s in {*seen, *sources}:
        alert = base0 = None
        first = min([*seen.get(s, []), *([sources[s]] if s in sources else [])])
        for at in range(-(-first // tick) * tick, now + tick, tick):
            heard = [t for t in seen.get(s, []) if t <= at]
            base = heard[-1] if heard else sources.get(s)
            if base is None:
                continue
            if at - base >= threshold:
                if at >= now:
                    continue
                if alert is None:
                    out.append((s, "stalled" if heard else "never_received", at, float(at - base)))
                    alert, base0 = at, base
                elif at - alert >= heartbeat:
                    out.append((s, "heartbeat", at, float(at - base)))
                    alert = at
            elif alert is not None:
                out.append((s, "recovered", at, float(next(t for t in heard if t > base0) - base0)))
                alert = None
    return sorted(out)


def rows(df):
    return sorted((r.source, r.event, int(r.at.replace(tzinfo=UTC).timestamp()), r.idle_secs) for r in df.collect())


@pytest.fixture(scope="module")
def story():
    rnd = random.Random(5)
    out, t = [], {"a": START, "b": START + 40, "late": START + 30_000}
    for s in t:
        while t[s] < START + 60_000:
            out.append((s, t[s]))
            t[s] += rnd.choice([0, 1, 7, 60, 60, 299, 300, 301, 900, 4000, 9000])
    out.append(("a", START + 60_001))
    return sorted(out, key=lambda m: m[1])


@pytest.mark.parametrize("per_trigger", [1, 3, 100])
def test_the_watch_says_the_same_at_any_trigger_size(spark, tmp_path, story, per_trigger):
    sources = {"a": START - 10, "silent": START + 100, "late": START}
    for i in range(0, len(story), len(story) // 6 + 1):  # files in the order of time; a time may lie in two of them
        part = [(s, stamp(t)) for s, t in story[i:i + len(story) // 6 + 1]]
        spark.createDataFrame(part, "source string, ingest_time timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("source string, ingest_time timestamp").option("maxFilesPerTrigger", per_trigger).parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([(s, stamp(t)) for s, t in sources.items()], "source string, since timestamp")
    H.watch_sources(src, str(tmp_path / "out"), str(tmp_path / "ck"), known, threshold=300, tick=60, heartbeat=1800)
    got = rows(H.alerts(spark, str(tmp_path / "out")))
    want = ticking(story, sources, max(t for _, t in story), 300, 60, 1800)
    assert got == want
    assert {e for _, e, _, _ in got} == {"first_message", "stalled", "heartbeat", "recovered", "never_received"}


def test_a_repeated_batch_says_nothing_twice(spark, tmp_path, story):
    root = str(tmp_path / "out")
    spark.createDataFrame([], H.STATE).write.parquet(root + "/state/batch=-1")
    df = lambda part: spark.createDataFrame([(s, stamp(t)) for s, t in part], "source string, ingest_time timestamp")
    half = len(story) // 2
    for i, part in ((0, story[:half]), (0, story[:half]), (1, story[half:]), (1, story[half:])):
        H.watch_batch(df(part), root, i, threshold=300, tick=60, heartbeat=1800)
    assert rows(H.alerts(spark, root)) == ticking(story, {}, max(t for _, t in story), 300, 60, 1800)


def test_late_nulls_and_empty(spark):
    none = spark.createDataFrame([], H.STATE)
    df = lambda part: spark.createDataFrame([(s, None if t is None else stamp(t)) for s, t in part], "source string, ingest_time timestamp")
    a, st = H.look(df([]), none, START)
    assert rows(a) == [] and st.count() == 0
    a, st = H.look(df([("a", START), (None, START), ("a", None)]), none, START + 1000)
    assert [e for _, e, _, _ in rows(a)] == ["first_message", "stalled"]
    late, st2 = H.look(df([("a", START + 10)]), st, START + 1001)  # heard late: counts from where the watch is
    assert [(e, i) for _, e, _, i in rows(late)] == [("recovered", 1000.0)]
    assert st2.first().alert is None and st2.first().last == START + 1000
    with pytest.raises(ValueError):
        H.look(df([]), none, START, threshold=10, tick=60)
