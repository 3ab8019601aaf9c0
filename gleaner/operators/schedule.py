"""Freshness, rate limits and budgets of fetching, as relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VERDICT_TTL_S, NO_DATA_TTL_S, ERROR_TTL_S = 6 * 3600, 30 * 60, 60
RATE_BASE, RATE_MAX, RATE_MIN, RATE_STEP, RAISE_S = 120, 360, 60, 40, 15
ERROR_BACKOFF_S, RATE_BACKOFF_S, ERRORS_IN_A_ROW = 45, 90, 4


def freshness(cache: DataFrame, now) -> DataFrame:
    """``cache`` (outcome: verdict / no-data / error, fetched_at) with ``fresh`` at ``now``."""
    ttl = F.when(F.col("outcome") == "verdict", VERDICT_TTL_S).when(F.col("outcome") == "error", ERROR_TTL_S).otherwise(NO_DATA_TTL_S)
    age = F.unix_micros(now) - F.unix_micros("fetched_at")
    return cache.withColumn("fresh", age < ttl.cast("bigint") * 1_000_000)


def keep_newest(cache: DataFrame, most: int = 800, order: str = "fetched_at", tie: str = "event_id") -> DataFrame:
    """The ``most`` entries inserted last: a bounded top-k, never a sort of all rows into one task."""
    return cache.orderBy(F.desc(order), F.desc(tie)).limit(most)


def rolling_rate(requests: DataFrame, by: str, ts: str = "ts", seconds: int = 60) -> DataFrame:
    """``in_window``: requests of the same key within the ``seconds`` up to each request, itself and its own time included.

    A key's history is cut into slices as long as the window, and every request also visits the slice after its own: a slice then holds all that its
    windows reach back to, so that one key's requests spread over as many tasks as it has slices.
    """
    us, width = F.unix_micros(ts), seconds * 1_000_000
    own = F.floor(us / F.lit(width)).cast("long")
    visits = requests.withColumns({"_us": us, "_own": own}).withColumn("_slice", F.explode(F.array_distinct(F.array("_own", F.col("_own") + 1))))
    w = W.partitionBy(by, "_slice").orderBy("_us").rangeBetween(-width, 0)
    counted = visits.withColumn("in_window", F.count(F.lit(1)).over(w))
    return counted.where("_slice <=> _own").drop("_us", "_own", "_slice")


def budget(outcomes: DataFrame, by: str, ts: str = "ts", outcome: str = "outcome", tie: str = "event_id") -> DataFrame:
    """Additive increase, multiplicative decrease, folded over each key's outcomes in order of time.

    ``outcome``: ok, rate (a rate signal) or error. One row a key: final rate, errors, last pause's end
    (microseconds). A key's outcomes are one fetcher's log.
    """
    step_t = "struct<rate:int,errors:int,row:int,since:int,raised:bigint,until:bigint>"
    log = outcomes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.unix_micros(ts).alias("t"), F.col(tie).alias("k"), F.col(outcome).alias("o")))).alias("log"))
    start = F.struct(F.lit(RATE_BASE).alias("rate"), F.lit(0).alias("errors"), F.lit(0).alias("row"), F.lit(0).alias("since"), F.lit(0).cast("bigint").alias("raised"), F.lit(0).cast("bigint").alias("until")).cast(step_t)

    def step(a, e):
        due = e["t"] - a["raised"] >= RAISE_S * 1_000_000
        rise = due & (a["since"] == 0) & (e["t"] >= a["until"])
        ok = F.struct(
            F.when(rise, F.least(F.lit(RATE_MAX), a["rate"] + RATE_STEP)).otherwise(a["rate"]).alias("rate"), a["errors"].alias("errors"), F.lit(0).alias("row"),
            F.when(due, 0).otherwise(a["since"]).alias("since"), F.when(due, e["t"]).otherwise(a["raised"]).alias("raised"), a["until"].alias("until"),
        )
        is_rate = e["o"] == "rate"
        stop = F.when(is_rate, e["t"] + RATE_BACKOFF_S * 1_000_000).when(a["row"] + 1 >= ERRORS_IN_A_ROW, e["t"] + ERROR_BACKOFF_S * 1_000_000).otherwise(a["until"])
        bad = F.struct(
            F.when(is_rate, F.greatest(F.lit(RATE_MIN), F.floor(a["rate"] / 2).cast("int"))).otherwise(a["rate"]).alias("rate"), (a["errors"] + 1).alias("errors"),
            (a["row"] + 1).alias("row"), (a["since"] + 1).alias("since"), a["raised"].alias("raised"), stop.alias("until"),
        )
        return F.when(e["o"] == "ok", ok.cast(step_t)).otherwise(bad.cast(step_t))

    return log.select(by, F.aggregate("log", start, step).alias("s")).select(by, F.col("s.rate").alias("rate"), F.col("s.errors").alias("errors"), F.col("s.until").alias("paused_until"))


def queue_order(requests: DataFrame) -> DataFrame:
    """One entry an item: priority first, then order of request."""
    return requests.groupBy("item_id").agg(F.max("priority").alias("priority"), F.min("seq").alias("seq")).orderBy(F.desc("priority"), "seq")


def outcome_stats(log: DataFrame, by: str = "page_id") -> DataFrame:
    kinds = ("json", "dom", "no-data", "error", "pending")
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("requested"), *[F.count_if(F.col("outcome") == k).alias(k.replace("-", "_")) for k in kinds])
