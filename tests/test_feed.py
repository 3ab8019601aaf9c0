"""Changes, page feed, cache, windows and queue against plain replays."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.operators import queue, schedule, viewport
from gleaner.operators.flood import analyze_flood
from gleaner.operators.score import score
from gleaner.streaming import apply, cache, feed

T0 = datetime(2024, 1, 1)


def test_changes_are_written_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    put = lambda epoch, rows, **kw: apply.apply_changes(spark.createDataFrame(rows, "item_id string, pos int, t string"), path, epoch, order="pos", **kw)
    state = lambda: {tuple(r) for r in apply.read_state(spark, path).select("item_id", "pos", "t").collect()}
    assert apply.read_state(spark, path) is None
    first = [("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z"), (None, 1, "n")]
    assert put(0, first) == 3 and put(1, first) == 0 and "epoch=1" not in apply._folders(spark, path)
    assert put(2, [("a", 0, "late"), ("b", 2, "z"), ("c", 1, "c")]) == 1 and apply.changed_rows(spark, path, 1) is None
    assert put(3, [("a", 5, "w")]) == 1 and put(3, [("a", 5, "w")]) == 1  # a repeated epoch overwrites itself
    want = {("a", 5, "w"), ("b", 2, "z"), ("c", 1, "c"), (None, 1, "n")}
    assert state() == want
    apply.compact(spark, path, 3)
    assert state() == want and put(4, [("a", 5, "w")]) == 0 and put(5, [("d", 1, "d")], compact_after=1) == 1
    assert state() == want | {("d", 1, "d")} and not [n for n, k in apply._folders(spark, path).items() if n.startswith("epoch") and k <= 3]
    assert {tuple(r) for r in apply.read_state(spark, path, before=5).select("item_id").collect()} == {("a",), ("b",), ("c",), (None,)}


def test_only_the_buckets_of_a_batch_are_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    apply.apply_changes(spark.range(500).selectExpr("cast(id as string) AS item_id", "id AS v"), path, 0)
    few = apply.buckets_of(spark.createDataFrame([("7",)], "item_id string"), "item_id")
    plan = apply.read_state(spark, path, buckets=few)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_page_feed_equals_a_batch(spark, tmp_path):
    rng = random.Random(1)
    titles = ["Solid oak dresser with mirror", "Vintage brass reading lamp", "Temu garden chair set new", "Plain old wooden box"]
    rows = [(p, f"{p}-{k}", k, rng.choice(titles), "$20", "Bend, OR", "", f"seen {rng.randint(0, 3)}", None) for p in range(12) for k in range(9)]
    kind = "page_id long, item_id string, pos int, title string, price_text string, location_text string, seller_text string, visible_text string, url string"
    arrivals = [rows[::3], rows[1::3], rows[2::3], rows[:20]]
    written = []
    for k, part in enumerate(arrivals):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feed.page_feed(feed.listing_stream(spark, f"{tmp_path}/in", kind), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        names = apply._folders(spark, f"{tmp_path}/out/verdicts")
        written.append(f"epoch={k}" in names)
    cols = ["page_id", "item_id", "score", "action", "duplicate", "matches"]
    got = {str(r) for r in feed.read_verdicts(spark, f"{tmp_path}/out").select(*cols).collect()}
    want = {str(r) for r in score(analyze_flood(spark.createDataFrame(rows, kind), with_images=False)).select(*cols).collect()}
    assert got == want and written == [True, True, True, False]  # what arrives again changes nothing
    assert len({r.split("tier=")[1][:6] for r in got}) > 1  # floods came about between arrivals
    changed = spark.createDataFrame([(3, "3-0", 0, "Something else altogether now", "$7", "Bend, OR", "", "seen", None)], kind)
    n, verdicts = feed.rescore_pages(changed, f"{tmp_path}/out", 9)
    assert n == 1 and 1 <= verdicts <= 9 and {r["page_id"] for r in apply.changed_rows(spark, f"{tmp_path}/out/verdicts", 9).collect()} == {3}


def test_cache_of_a_stream(spark, tmp_path):
    cache.use_rocksdb(spark)
    rng = random.Random(2)
    kinds = list(cache.TTL_S)
    times = sorted(rng.randint(0, 40 * 3600) for _ in range(600))
    rows = [(rng.choice(["a", "b", "c"]), i, T0 + timedelta(seconds=s), rng.choice(kinds)) for i, s in enumerate(times)]
    edge = [("d", 1000, T0, "error"), ("d", 1001, T0, "verdict"), ("d", 1002, T0 + timedelta(seconds=60), "no-data"), ("d", 1003, T0 + timedelta(seconds=1859.999), "error"), ("d", 1004, T0 + timedelta(seconds=1860), "error")]
    rows = sorted(rows + edge, key=lambda r: (r[2], r[1]))
    schema = "item_id string, event_id long, ts timestamp, outcome string"
    for part in (rows[:100], rows[100:101], rows[101:400], rows[400:]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        feed.run_to_table(cache.cached(feed.listing_stream(spark, f"{tmp_path}/in", schema)), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    entries, want = {}, {}
    for item, i, ts, kind in rows:
        hit = item in entries and ts < entries[item]
        want[i] = hit
        if not hit:
            entries[item] = ts + timedelta(seconds=cache.TTL_S[kind])
    assert {r["event_id"]: r["hit"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
    assert [want[i] for i in range(1000, 1005)] == [False, True, False, True, False] and 50 < sum(want.values()) < 590


@pytest.mark.parametrize("span", [900, 30_000])
def test_first_sights(spark, span):
    rng = random.Random(span)
    items = [(rng.randint(0, 3), rng.choice([None, *range(60)]), t := rng.randint(-500, span), t + rng.randint(0, 3000), rng.choice(["allow", "hide", "dim"]), rng.choice([True, False, None, False])) for _ in range(150)]
    windows = [(rng.randint(0, 4), i, rng.randint(-300, span), rng.choice([1, 600, 901])) for i in range(60)]
    got = viewport.first_sights(
        spark.createDataFrame(items, "page_id long, item_id long, top long, bottom long, action string, fresh boolean"), spark.createDataFrame(windows, "page_id long, seq long, y long, height long")
    )
    want = {}
    for p, i, top, bottom, action, fresh in items:
        if i is None or action == "hide" or fresh:
            continue
        seen = [s for q, s, y, h in windows if q == p and not (bottom < y - 1.25 * h or top > y + 2.25 * h)]
        if seen:
            want.setdefault((p, i), []).append(min(seen))
    want = {k: min(v) for k, v in want.items()}
    at = {(q, s): (y, h) for q, s, y, h in windows}
    shown = lambda p, i, s: any(q == p and j == i and b > at[p, s][0] and t < at[p, s][0] + at[p, s][1] and a != "hide" and not f for q, j, t, b, a, f in items)
    assert {(r["page_id"], r["item_id"]): (r["seq"], r["on_screen"]) for r in got.collect()} == {k: (s, shown(*k, s)) for k, s in want.items()}


def replay(log):
    """A queue as a plain list."""
    waiting, running, cached, requested, completed, failed, out = [], [], {}, 0, 0, [], []
    for _, ts, kind, item, priority, outcome, since in log:
        effect, at, dropped = kind, None, 0
        alive = lambda i: i in cached and ts < cached[i]
        names = [i for i, _ in waiting]
        if kind == "request" and item is not None:
            at = item
            if alive(item):
                effect = "fresh"
            elif item in names:
                k = names.index(item)
                effect = "promoted" if priority else "waiting"
                waiting.pop(k)
                waiting.insert(0 if priority else k, (item, ts))
            else:
                effect, requested = "queued", requested + 1
                waiting.insert(0 if priority else len(waiting), (item, ts))
        elif kind == "prune" and since is not None:
            keep = [w for w in waiting if w[1] >= since]
            dropped = len(waiting) - len(keep)
            for _ in range(dropped):
                requested = max(completed, requested - 1)
            waiting = keep
        elif kind == "dispatch":
            while waiting and at is None:
                i, _ = waiting.pop(0)
                if not alive(i):
                    at = i
                    running.append(i)
        elif kind == "done" and running:
            at = running.pop(0)
            completed += 1
            cached[at] = ts + timedelta(seconds=cache.TTL_S[outcome or "no-data"])
            if (outcome or "no-data") != "verdict":
                failed = (failed + [at])[-10:]
        elif kind == "reset":
            requested, completed = len(waiting) + len(running), 0
        out.append((effect, at, dropped, requested, completed, len(waiting) + len(running), tuple(failed)))
    return out


def test_fetch_queue(spark):
    rng = random.Random(7)
    logs = {}
    for q in ("hot", "b", None):
        ts = T0
        logs[q] = []
        for i in range(1500 if q == "hot" else 200):
            ts += timedelta(seconds=rng.choice([0, 1, 30, 500]))
            kind = rng.choices(queue.KINDS, [6, 1, 2, 2, 0.2])[0]
            logs[q].append((i, ts, kind, rng.choice([None, *range(12)]), rng.choice([True, False, None]), rng.choice(["verdict", "no-data", "error", None]), rng.choice([None, ts - timedelta(seconds=900)])))
    rows = [(q, *r) for q, log in logs.items() for r in log]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "queue string, event_id long, ts timestamp, kind string, item long, priority boolean, outcome string, since timestamp").repartition(5)
    got = {(r["queue"], r["event_id"]): (r["effect"], r["item"], r["dropped"], r["requested"], r["completed"], r["pending"], tuple(r["failures"])) for r in queue.run_queue(df).collect()}
    assert got == {(q, r[0]): x for q, log in logs.items() for r, x in zip(log, replay(log))}
    assert len(Counter(x[0] for x in got.values())) >= 8 and max(x[2] for x in got.values()) > 0


def test_rolling_rate_is_sliced(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["u", "v"]), T0 + timedelta(seconds=rng.randint(0, 900))) for i in range(500)] + [(900, "u", None), (901, "u", None), (902, None, T0)]
    out = schedule.rolling_rate(spark.createDataFrame(rows, "id long, user string, ts timestamp"), "user")
    want = {i: sum(v == u and (s is None and t is None or s is not None and t is not None and timedelta() <= t - s <= timedelta(seconds=60)) for _, v, s in rows) for i, u, t in rows}
    assert {r["id"]: r["in_window"] for r in out.collect()} == want and out.columns == ["id", "user", "ts", "in_window"]
    plan = out._jdf.queryExecution().toString()
    assert "_slice" in plan.split("Exchange hashpartitioning(")[1].split(")")[0]
