"""The queue of fetches as a keyed fold over its log: each item waits once, what comes into view moves up, what left it is dropped.

The log is sorted by key and time within partitions and read as a stream: a task holds the waiting items and living entries of one key, never its log.
"""

from __future__ import annotations

from collections import OrderedDict, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.schedule import ERROR_TTL_S, NO_DATA_TTL_S, VERDICT_TTL_S
from gleaner.plans.shared import ship

KINDS = ("request", "prune", "dispatch", "done", "reset")
OUT = "queue {0}, event_id long, effect string, item long, dropped int, requested int, completed int, pending int, failures array<long>"
_TTL_US = {"verdict": VERDICT_TTL_S * 10**6, "no-data": NO_DATA_TTL_S * 10**6, "error": ERROR_TTL_S * 10**6}


class FetchQueue:
    """One key's queue: front first. Counters are those of the page view: what is pruned was never asked for, what runs over a reset still counts."""

    def __init__(self):
        self.waiting: OrderedDict[int, int] = OrderedDict()  # item: when it was last asked for
        self.running: deque[int] = deque()  # an item asked for again meanwhile may run twice
        self.until: dict[int, int] = {}
        self.requested = self.completed = 0
        self.failures: list[int] = []

    def fresh(self, item: int, us: int) -> bool:
        if us < self.until.get(item, us):
            return True
        self.until.pop(item, None)
        return False

    def request(self, us: int, item: int, priority: bool) -> str:
        if self.fresh(item, us):
            return "fresh"
        if item in self.waiting:
            self.waiting[item] = us
            if priority:
                self.waiting.move_to_end(item, last=False)
                return "promoted"
            return "waiting"
        self.waiting[item] = us
        if priority:
            self.waiting.move_to_end(item, last=False)
        self.requested += 1
        return "queued"

    def prune(self, since_us: int) -> int:
        gone = [i for i, us in self.waiting.items() if us < since_us]
        for i in gone:
            del self.waiting[i]
            self.requested = max(self.completed, self.requested - 1)
        return len(gone)

    def dispatch(self, us: int) -> int | None:
        while self.waiting:
            item, _ = self.waiting.popitem(last=False)
            if not self.fresh(item, us):
                self.running.append(item)
                return item
        return None

    def done(self, us: int, outcome: str) -> int | None:
        """The fetch that has run longest ends."""
        if not self.running:
            return None
        item = self.running.popleft()
        self.completed += 1
        self.until[item] = us + _TTL_US[outcome]
        if outcome != "verdict":
            self.failures = [*self.failures, item][-10:]
        return item

    def reset(self) -> None:
        self.requested, self.completed = len(self.waiting) + len(self.running), 0


def step(q: FetchQueue, us: int, kind: str, item, priority, outcome, since_us) -> tuple:
    effect, at, dropped = kind, None, 0
    if kind == "request" and item is not None:
        effect, at = q.request(us, item, bool(priority)), item
    elif kind == "prune" and since_us is not None:
        dropped = q.prune(since_us)
    elif kind == "dispatch":
        at = q.dispatch(us)
    elif kind == "done":
        at = q.done(us, outcome or "no-data")
    elif kind == "reset":
        q.reset()
    return effect, at, dropped, q.requested, q.completed, len(q.waiting) + len(q.running), list(q.failures)


def run_queue(log: DataFrame, by: str = "queue") -> DataFrame:
    """Every event of the log (queue, event_id, ts, kind, item, priority, outcome, since) with its effect and the counters after it.

    ``prune`` drops what was last asked for before ``since``; ``done`` ends the oldest running fetch with ``outcome`` (verdict, no-data or
    error). ``failures`` are the last ten items without a verdict.
    """
    ship(log.sparkSession)
    kind = log.schema[by].dataType.simpleString()
    rows = log.select(
        F.col(by).alias("queue"), F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), "kind", F.col("item").cast("long").alias("item"),
        F.col("priority").cast("boolean").alias("priority"), F.col("outcome").cast("string").alias("outcome"), F.unix_micros("since").alias("since_us"),
    )
    ordered = rows.repartition("queue").sortWithinPartitions("queue", "us", "event_id")

    def fold(batches):
        q, now = FetchQueue(), object()
        for b in batches:
            keys = b.column("queue").to_pylist()
            out = []
            for key, us, *rest in zip(keys, b.column("us").to_pylist(), *[b.column(c).to_pylist() for c in ("kind", "item", "priority", "outcome", "since_us")]):
                if key != now:
                    q, now = FetchQueue(), key
                out.append(step(q, us, *rest))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("queue"), b.column("event_id"), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]],
                                             names=["queue", "event_id", "effect", "item", "dropped", "requested", "completed", "pending", "failures"])

    return ordered.mapInArrow(fold, OUT.format(kind))
