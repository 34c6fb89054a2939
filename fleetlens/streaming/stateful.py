"""Per-device state across micro-batches: risk counts and the action interval."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.functions.scores import half_up
from fleetlens.operators.control import MICROS, with_clamp
from fleetlens.operators.ordering import TIE_BREAK
from fleetlens.operators.risk import with_levels
from fleetlens.schema import ControlConfig, RiskConfig

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """The state store that stateful processors need; set per session."""
    spark.conf.set(STATE_STORE, ROCKSDB)


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order, kind="stable")


class SustainedCount(StatefulProcessor):
    """State per device: rows above the floor, and the current run below it."""

    def __init__(self, score: str, order: list[str], cfg: RiskConfig):
        self.score, self.order, self.cfg = score, order, cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "above long, below long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        above, below = self.run.get() if self.run.exists() else (0, 0)
        batch = _in_order(rows, self.order)
        counts = []
        for hit in (batch[self.score] >= self.cfg.score_floor).to_numpy():
            if hit:
                above, below = above + 1, 0
            else:
                below += 1
                if below >= self.cfg.clear_rows:
                    above = 0
            counts.append(above)
        self.run.update((above, below))
        yield batch.assign(sustained=counts)

    def close(self) -> None:
        pass


def live_risk(stream: DataFrame, score: str, health: str | None, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Risk levels of a stream, the same as the batch operator's."""
    use_rocksdb(stream.sparkSession)
    order = [c for c in ("timestamp", TIE_BREAK) if c in stream.columns]
    out = T.StructType([*stream.schema.fields, T.StructField("sustained", T.LongType())])
    counted = stream.groupBy("miner_id").transformWithStateInPandas(
        statefulProcessor=SustainedCount(score, order, cfg), outputStructType=out,
        outputMode="Append", timeMode="None",
    )
    return with_levels(counted, "sustained", health, cfg)


class ActionInterval(StatefulProcessor):
    """State per device: time of the last approved action."""

    def __init__(self, order: list[str], gap: int):
        self.order, self.gap = order, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        batch = _in_order(rows, self.order)
        approved, ago = [], []
        for t, limited, hot in zip(batch["at_us"], batch["rate_limited"], batch["too_hot"]):
            since = None if last is None else int(t) - last
            ok = not hot and (not limited or since is None or since >= self.gap)
            approved.append(ok)
            ago.append(since)
            if ok:
                last = int(t)
        if last is not None:
            self.last.update((last,))
        yield batch.assign(approved=approved, since_us=pd.array(ago, dtype="Int64"))

    def close(self) -> None:
        pass


def live_guard(actions: DataFrame, cfg: ControlConfig = ControlConfig()) -> DataFrame:
    """The safety guard on a stream of proposed actions."""
    use_rocksdb(actions.sparkSession)
    order = [c for c in ("timestamp", TIE_BREAK, "rule_no") if c in actions.columns]
    is_set = F.col("action").startswith("set_")
    hot = (F.col("temperature_c") >= cfg.shutdown_c) & (F.col("action") != "flag_maintenance")
    ready = actions.withColumns({
        "at_us": F.unix_micros(F.col("timestamp").cast("timestamp")),
        "rate_limited": is_set, "too_hot": F.coalesce(hot, F.lit(False)),
    })
    out = T.StructType([*ready.schema.fields, T.StructField("approved", T.BooleanType()),
                        T.StructField("since_us", T.LongType())])
    decided = ready.groupBy("miner_id").transformWithStateInPandas(
        statefulProcessor=ActionInterval(order, cfg.min_interval_s * MICROS), outputStructType=out,
        outputMode="Append", timeMode="None",
    )
    reason = F.when(F.col("too_hot"), F.format_string(
        f"Thermal shutdown: %.1fC >= {cfg.shutdown_c}C", half_up(F.col("temperature_c"), 1))
    ).when(~F.col("approved"), F.format_string(
        "Rate limited: last action %ds ago", F.floor(F.col("since_us") / MICROS + 0.5)))
    return with_clamp(decided.withColumn("rejection_reason", reason)).drop("at_us", "rate_limited", "too_hot", "since_us")
