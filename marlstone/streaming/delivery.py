"""Messages with retries: each delivery that fails is made again when it is due, and put aside after the last one.

What happens to messages comes as a stream of events (sent, failed, done); the deliveries to make come out.  State is kept for
each review: a map from message to its attempts, with a timer at the time each retry is due.  Events that come twice, as they
do when a source is at least once, change nothing the second time.  `replay` gives the same deliveries for a table of
messages of which it is known how often they failed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import ship

ship(__name__)

#: Seconds before the first retry, the most before any, and how many retries there are.
FIRST_DELAY, LONGEST_DELAY, RETRIES = 30, 300, 3
#: What comes in, and what comes out: the time is when the delivery is due, or when the message was put aside.
EVENT = "review_id string, message_id string, kind string, attempt int, at timestamp"
DELIVERY = "review_id string, message_id string, action string, attempt int, due timestamp"


def delay_after(attempt: int) -> int:
    """Seconds from a failed attempt (the first is 1) to the next."""
    return min(LONGEST_DELAY, FIRST_DELAY * 2 ** max(0, attempt - 1))


class Deliveries(StatefulProcessor):
    """Keeps for each message its attempts and when the next is due (0: one is under way)."""

    def __init__(self, retries: int = RETRIES, kept_ms: int = 86_400_000):
        self.retries, self.kept_ms = retries, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "message_id string", "attempts int, due bigint")
        # Messages that are through are remembered for a time, so that one sent again is known.
        self.through = handle.getMapState("through", "message_id string", "attempts int", ttlDurationMs=None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "attempt", "kind"])
        out = []
        for e in events.itertuples():
            message = (e.message_id,)
            if self.through.containsKey(message):
                continue
            state = self.waiting.getValue(message)
            if e.kind == "sent" and state is None:
                self.waiting.updateValue(message, (1, 0))
                out.append((key[0], e.message_id, "deliver", 1, e.at))
            elif state is None or state[0] != e.attempt or state[1]:
                continue  # of an attempt that is over
            elif e.kind == "done":
                self._end(message, state[0])
            elif e.kind == "failed" and state[0] > self.retries:
                self._end(message, state[0])
                out.append((key[0], e.message_id, "dead", state[0], e.at))
            elif e.kind == "failed":
                due = int(e.at.timestamp() * 1000) + 1000 * delay_after(state[0])
                self.waiting.updateValue(message, (state[0], due))
                self.handle.registerTimer(due)
        yield pd.DataFrame(out, columns=["review_id", "message_id", "action", "attempt", "due"])

    def _end(self, message: tuple, attempts: int) -> None:
        self.waiting.removeKey(message)
        self.through.updateValue(message, (attempts,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        for (message,), (attempts, due) in [*self.waiting.iterator()]:
            if 0 < due <= now:
                self.waiting.updateValue((message,), (attempts + 1, 0))
                out.append((key[0], message, "deliver", attempts + 1, pd.Timestamp(due, unit="ms")))
        yield pd.DataFrame(out, columns=["review_id", "message_id", "action", "attempt", "due"])

    def close(self) -> None:
        pass


def deliveries(events: DataFrame, retries: int = RETRIES, late: str = "0 seconds") -> DataFrame:
    """The deliveries to make (EVENT in, DELIVERY out).  Needs the RocksDB state store; retries go out once the watermark has passed their time."""
    keyed = events.withWatermark("at", late).groupBy("review_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Deliveries(retries), outputStructType=DELIVERY, outputMode="Append", timeMode="EventTime")


def waited(attempt: Column) -> Column:
    """Seconds from a message to its attempt, if all before it failed at once: 0, 30, 90, 210, ..."""
    return F.aggregate(F.sequence(F.lit(0), attempt - 1), F.lit(0.0), lambda total, k: total + F.when(k > 0, F.least(F.lit(float(LONGEST_DELAY)), FIRST_DELAY * F.pow(F.lit(2.0), k - 1))).otherwise(0.0)).cast("int")


def replay(messages: DataFrame, retries: int = RETRIES) -> DataFrame:
    """Deliveries of messages (review_id, message_id, at, failures: how many attempts fail), and where they end: done or dead."""
    attempts = F.least(F.col("failures") + 1, F.lit(retries + 1)).cast("int")
    each = messages.withColumn("attempt", F.explode(F.sequence(F.lit(1), attempts)))
    due = F.timestamp_seconds(F.unix_timestamp("at") + waited(F.col("attempt")))
    last = F.col("attempt") == attempts
    end = F.when(~last, F.lit("retried")).when(F.col("failures") > retries, F.lit("dead")).otherwise("done")
    return each.select("review_id", "message_id", "attempt", due.alias("due"), end.alias("end"))
