"""Limits in time as scans that no key can crowd: when each request may go, and who is shut out for the rest of a period.

Positions within a key come from ranges of the whole order (search.counted_rank); running values are taken within blocks
of positions and then over the blocks, so a key with a third of all events is dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import ship
from .search import counted_rank

ship(__name__)

#: Positions in a block.
BLOCK = 1024


def running_max(rows: DataFrame, keys: list[str], place: str, value: Column, name: str) -> DataFrame:
    """`rows` with the greatest value at or before their place within their keys."""
    blocks = rows.withColumns({"_v": value, "_b": F.floor(F.col(place) / BLOCK)})
    inner = F.max("_v").over(Window.partitionBy(*keys, "_b").orderBy(place))
    tops = blocks.groupBy(*keys, "_b").agg(F.max("_v").alias("_top"))
    before = F.max("_top").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(*keys, "_b", before.alias("_before"))
    return blocks.withColumn(name, inner).join(tops, [*keys, "_b"]).withColumn(name, F.greatest(name, "_before")).drop("_v", "_b", "_before")


def paced(requests: DataFrame, key: str, spacing_ms: int, most: int, period_ms: int = 60_000, ident: str = "event_id") -> DataFrame:
    """key, ident, n, start_ms: when each request (key, ident, at_ms) may go, in the order of arrival.

    A request waits until `spacing_ms` after the one before and, where `most` came before it, `period_ms` after the one that many
    places back: s(i) = max(t(i), s(i-1) + spacing, s(i-most) + period).  In the max-plus algebra that is a product of t with the
    longest ways from j to i, and of two requests m places apart the longest way is m div most periods and m mod most spacings.
    So with i = a * most + r, s(i) is a * P + r * spacing plus the greatest of t(j) - b * P - q * spacing over all j = b * most + q
    before, less P - most * spacing where q > r; maxima over b for each q, and over q within a block, are all that is needed.
    """
    step = max(period_ms, most * spacing_ms)
    rows = requests.select(F.col(key).alias("query_id"), F.col(ident).alias("ident"), F.col("at_ms").cast("bigint").alias("at_ms"))
    rows = counted_rank(rows, "n", "at_ms", "ident").withColumns({"a": F.floor((F.col("n") - 1) / most), "r": (F.col("n") - 1) % most})
    own = F.col("at_ms") - F.col("a") * step - F.col("r") * spacing_ms
    best = running_max(rows, ["query_id", "r"], "a", own, "m")  # the greatest at this place of its block and of all blocks before
    in_block = Window.partitionBy("query_id", "a").orderBy("r")
    upto = F.max("m").over(in_block)
    # What stands behind this place in its block, for the next block's same place; `most` rows at most.
    after = F.max("m").over(in_block.rowsBetween(1, Window.unboundedFollowing))
    best = best.withColumns({"upto": upto, "after": after})
    behind = best.select("query_id", (F.col("a") + 1).alias("a"), "r", F.col("after").alias("behind"))
    told = best.join(behind, ["query_id", "a", "r"], "left")
    start = F.col("a") * step + F.col("r") * spacing_ms + F.greatest("upto", F.col("behind") + most * spacing_ms - step)
    return told.select(F.col("query_id").alias(key), F.col("ident").alias(ident), "n", start.alias("start_ms"))


def penalised(attempts: DataFrame, key: str, most: int = 30, period_s: int = 60, ident: str = "event_id") -> DataFrame:
    """key, ident, blocked: attempts (key, ident, ts, failed) of a key that has failed `most` times in the period before them.

    Failures are counted by second first, so a period's running counts are sums of seconds, and only the attempts of one second
    are put in order.
    """
    second = F.unix_seconds("ts")
    rows = attempts.select(F.col(key).alias("k"), F.col(ident).alias("ident"), "ts", F.col("failed").cast("bigint").alias("bad"), second.alias("s"), F.floor(second / period_s).alias("p"))
    seconds = rows.groupBy("k", "p", "s").agg(F.sum("bad").alias("n"))
    before = F.sum("n").over(Window.partitionBy("k", "p").orderBy("s")) - F.col("n")  # a period has `period_s` of them
    within = F.sum("bad").over(Window.partitionBy("k", "p", "s").orderBy("ts", "ident")) - F.col("bad")
    told = rows.withColumn("within", within).join(seconds.select("k", "p", "s", before.alias("before")), ["k", "p", "s"])
    return told.select(F.col("k").alias(key), F.col("ident").alias(ident), (F.col("before") + F.col("within") >= most).alias("blocked"))


class PenaltyBox(StatefulProcessor):
    """Failures of a key in the current period; the state goes when the period ends."""

    def __init__(self, most: int, period_s: int):
        self.most, self.period_ms = most, period_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.periods = handle.getMapState("periods", "start bigint", "failures bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events, out = pd.concat(list(rows)).sort_values(["ts", "ident"]), []
        for e in events.itertuples():
            at = int(e.ts.timestamp() * 1000)
            period = (at - at % self.period_ms,)
            known = self.periods.getValue(period)
            failures = known[0] if known else 0
            blocked = failures >= self.most
            out.append((key[0], e.ident, blocked))
            if e.failed and not blocked:
                self.periods.updateValue(period, (failures + 1,))
                if not known:
                    self.handle.registerTimer(period[0] + self.period_ms)
        yield pd.DataFrame(out, columns=["k", "ident", "blocked"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.periods.removeKey((expiredTimerInfo.getExpiryTimeInMs() - self.period_ms,))
        yield pd.DataFrame(columns=["k", "ident", "blocked"])

    def close(self) -> None:
        pass


def penalty_stream(attempts: DataFrame, most: int = 30, period_s: int = 60) -> DataFrame:
    """k, ident, blocked for a stream of attempts (k bigint, ident bigint, ts, failed).  Needs the RocksDB state store."""
    keyed = attempts.withWatermark("ts", f"{period_s} seconds").groupBy("k")
    return keyed.transformWithStateInPandas(statefulProcessor=PenaltyBox(most, period_s), outputStructType="k bigint, ident bigint, blocked boolean", outputMode="Append", timeMode="EventTime")
