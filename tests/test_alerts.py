import datetime as dt
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from sieveline.streaming import alerts, monitor

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SCHEMA = "ts timestamp, service string, bad boolean"


def counts():
    return {"n_hit": F.count_if("bad"), "n": F.count("*")}


def firing():
    return 2 * F.col("n_hit") >= F.col("n")


def some_events(seed, minutes=600):
    """Events of three services, in runs of good and bad spells, with silent spells of one of them."""
    rnd, rows = random.Random(seed), []
    for service in ("a", "b", None):
        bad, silent = False, False
        for m in range(minutes):
            if rnd.random() < 0.08:
                bad = not bad
            if rnd.random() < 0.04 and service == "b":
                silent = not silent
            if not silent:
                rows += [(T0 + dt.timedelta(minutes=m, seconds=rnd.randrange(60)), service, rnd.random() < (0.95 if bad else 0.05)) for _ in range(rnd.randint(1, 4))]
    return sorted(rows, key=lambda r: r[0])


def plain(rows, step, hold, silent_fires=False):
    """Ended runs by the definition, window by window."""
    out = []
    for service in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == service]
        at = lambda r: (r[0] - T0) // step
        first, last = at(mine[0]), max(map(at, mine))
        run = []
        for w in range(first, last + 2):
            here = [r[2] for r in mine if at(r) == w]
            on = 2 * sum(here) >= len(here) if here else silent_fires
            if on and w <= last:
                run.append(w)
            elif run:
                out.append((service, T0 + run[0] * step, T0 + run[-1] * step, len(run), len(run) >= hold))
                run = []
    return out


def as_rows(found):
    return sorted((tuple(r) for r in found), key=repr)


def stream_of(spark, path, silent_fires=False):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return alerts.alerts(source, "5 minutes", ["service"], counts(), firing(), 3, delay="2 minutes", silent_fires=silent_fires)


def put(spark, path, rows):
    """Rows as one file more, later than those before."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)


def read_alerts(spark, path):
    rows = spark.read.parquet(path).select("service", "kind", F.unix_seconds("run_start").alias("a"), F.unix_seconds("run_end").alias("b"), "n_windows", "alerted").collect()
    return as_rows(rows)


def want_rows(rows, hold=3):
    step = dt.timedelta(minutes=5)
    runs = plain(rows, step, hold)
    seconds = lambda t: int(t.timestamp())
    return as_rows([(s, "ended", seconds(a), seconds(b), n, x) for s, a, b, n, x in runs] + [(s, "raised", seconds(a), seconds(a + (hold - 1) * step), hold, True) for s, a, _, _, x in runs if x])


def test_stream_of_alerts_over_a_restart(spark, tmp_path):
    rows = some_events(1)
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rnd = random.Random(2)
    parts = [rows[i : i + len(rows) // 6 + 1] for i in range(0, len(rows), len(rows) // 6 + 1)]
    for part in parts[:3]:
        put(spark, src, rnd.sample(part, len(part)))
    alerts.write_alerts(stream_of(spark, src), out, check).awaitTermination(240)
    halfway = read_alerts(spark, out)
    for part in parts[3:]:
        put(spark, src, rnd.sample(part, len(part)))
    # an event that is too late is dropped; the last one moves the watermark past all windows
    put(spark, src, [(T0 + dt.timedelta(minutes=1), "a", True)] * 50)
    put(spark, src, [(T0 + dt.timedelta(days=2), "z", False)])
    alerts.write_alerts(stream_of(spark, src), out, check).awaitTermination(240)
    got = read_alerts(spark, out)
    want = want_rows(rows)
    assert got == want and any(r[1] == "raised" for r in got)
    assert 0 < len(halfway) < len(want) and set(halfway) < set(want)
    # the batch form over the same events
    table = spark.createDataFrame(rows, SCHEMA)
    hours = table.groupBy(F.window("ts", "5 minutes").alias("w"), F.coalesce("service", F.lit("none")).alias("service")).agg(*[c.alias(k) for k, c in counts().items()])
    filled = monitor.spine(hours.select("service", F.col("w.start").alias("window_start"), "n_hit", "n"), "5 minutes", {"n_hit": 0, "n": 0}, by=["service"])
    batch = monitor.alert_runs(filled, (F.col("n") > 0) & firing(), 3, by=["service"])
    runs = batch.select(F.nullif("service", F.lit("none")).alias("service"), F.lit("ended"), F.unix_seconds("run_start"), F.unix_seconds("run_end"), "n_windows", "alerted")
    assert as_rows(runs.collect()) == [r for r in want if r[1] == "ended"]


def test_a_lost_sink_batch_is_written_once(spark, tmp_path):
    """The last commit is taken away, as if the driver had been lost before it: the batch is run again, with the same rows, once."""
    rows = some_events(5, 200)
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    half = len(rows) // 2
    put(spark, src, rows[:half])
    put(spark, src, rows[half:])
    put(spark, src, [(T0 + dt.timedelta(days=2), "z", False)])
    alerts.write_alerts(stream_of(spark, src), out, check).awaitTermination(240)
    first = read_alerts(spark, out)
    commits = sorted((tmp_path / "check" / "commits").iterdir(), key=lambda p: (p.name.lstrip(".").removesuffix(".crc").isdigit(), p.name))
    last = max(int(p.name) for p in commits if p.name.isdigit())
    kept = tmp_path / "kept"
    kept.mkdir()
    for name in (str(last), f".{last}.crc"):
        if (tmp_path / "check" / "commits" / name).exists():
            shutil.move(str(tmp_path / "check" / "commits" / name), str(kept / name))
    alerts.write_alerts(stream_of(spark, src), out, check).awaitTermination(240)
    assert read_alerts(spark, out) == first == want_rows(rows)


def test_silence_fires(spark, tmp_path):
    """An alert on absence: a series that sends nothing fires in each window that the watermark passes, until it sends again."""
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    put(spark, src, [(minute(1), "a", False), (minute(2), "z", False)])
    put(spark, src, [(minute(16), "z", False)])
    put(spark, src, [(minute(31), "z", False)])
    put(spark, src, [(minute(36), "a", False), (minute(37), "z", False)])
    put(spark, src, [(minute(60), "a", False), (minute(60), "z", False)])
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    found = alerts.alerts(source, "5 minutes", ["service"], counts(), F.col("n_hit") > 0, 3, delay="1 minute", silent_fires=True)
    alerts.write_alerts(found, out, check).awaitTermination(240)
    mine = [r for r in read_alerts(spark, out) if r[0] == "a"]
    at = lambda m: int(minute(m).timestamp())
    assert ("a", "raised", at(5), at(15), 3, True) in mine and ("a", "ended", at(5), at(30), 6, True) in mine


@pytest.mark.parametrize("width,ms", [("5 minutes", 300_000), ("1 hour", 3_600_000), ("30 seconds", 30_000), ("2 days", 172_800_000)])
def test_widths(width, ms):
    assert alerts.milliseconds(width) == ms
