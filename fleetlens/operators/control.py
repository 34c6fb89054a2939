"""Control actions: rules, the safety guard and the emergency stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.scores import half_up
from fleetlens.operators.kpi import with_spec
from fleetlens.operators.ordering import SLOT, TIE_BREAK, Series
from fleetlens.schema import (
    DEFAULT_FREQ_MAX_MHZ, DEFAULT_FREQ_MIN_MHZ, ControlConfig, DashboardControlConfig,
)

MICROS = 1_000_000


def with_freq_limits(df: DataFrame) -> DataFrame:
    limits = with_spec(df, {"__lo": "spec_freq_min_mhz", "__hi": "spec_freq_max_mhz"})
    return limits.withColumns({
        "freq_min_mhz": F.coalesce(F.col("__lo"), F.lit(DEFAULT_FREQ_MIN_MHZ)),
        "freq_max_mhz": F.coalesce(F.col("__hi"), F.lit(DEFAULT_FREQ_MAX_MHZ)),
        "has_spec": F.col("__lo").isNotNull(),
    }).drop("__lo", "__hi")


def _action(when, action, value, reason, priority):
    return F.when(when, F.struct(
        F.lit(action).alias("action"), value.cast("double").alias("value"),
        reason.alias("reason"), F.lit(priority).alias("priority"),
    ))


def _set_frequency(when, value, reason, priority):
    return _action(when, "set_frequency", value, reason, priority)


def thermal_rule(cfg: ControlConfig = ControlConfig()):
    t, f, lo = F.col("temperature_c"), F.col("clock_frequency_mhz"), F.col("freq_min_mhz")
    degrees = half_up(t, 1)
    critical = _set_frequency(
        t > cfg.critical_c, F.greatest(lo, f - cfg.step_mhz * 2),
        F.format_string("Thermal critical: %.1fC", degrees), "high")
    warning = _set_frequency(
        t > cfg.warning_c, F.greatest(lo, f - cfg.step_mhz),
        F.format_string("Thermal warning: %.1fC", degrees), "medium")
    return F.coalesce(critical, warning)


def energy_rule(cfg: ControlConfig = ControlConfig()):
    t, f, price = F.col("temperature_c"), F.col("clock_frequency_mhz"), F.col("energy_price")
    dollars = half_up(price, 3)
    cheap = _set_frequency(
        (price < cfg.cheap_usd) & (t < cfg.warning_c - cfg.cheap_margin_c),
        F.least(F.col("freq_max_mhz"), f + cfg.step_mhz * 0.5),
        F.format_string("Cheap energy: $%.3f/kWh", dollars), "low")
    expensive = _set_frequency(
        price > cfg.expensive_usd, F.greatest(F.col("freq_min_mhz"), f - cfg.step_mhz * 0.5),
        F.format_string("Expensive energy: $%.3f/kWh", dollars), "low")
    return F.coalesce(cheap, expensive)


def degradation_rule(cfg: ControlConfig = ControlConfig(), score: str = "anomaly_score", predicted: str = "predicted_failure"):
    fires = F.coalesce(F.col(predicted), F.lit(False)) | (F.col(score) > cfg.anomaly_flag)
    return _action(fires, "flag_maintenance", F.lit(1.0),
                   F.format_string("AI prediction: anomaly_score=%.2f", half_up(F.col(score), 2)), "high")


def te_floor_rule(cfg: ControlConfig = ControlConfig()):
    te = F.col("te_health")
    return _action((te > 0) & (te < cfg.te_floor), "flag_maintenance", F.lit(1.0),
                   F.format_string(f"TE floor breach: te_health=%.5f < {cfg.te_floor}", half_up(te, 5)), "medium")


def propose_actions(df: DataFrame, cfg: ControlConfig = ControlConfig(), rules: list | None = None) -> DataFrame:
    """All rules per row, in the order thermal, price, degradation, KPI floor."""
    df = with_freq_limits(df)
    rules = rules or [thermal_rule(cfg), energy_rule(cfg), degradation_rule(cfg), te_floor_rule(cfg)]
    fired = F.filter(F.array(*rules), lambda a: a.isNotNull())
    ids = [c for c in ("timestamp", TIE_BREAK, SLOT) if c in df.columns]
    return df.select(
        *ids, "miner_id", "temperature_c", "freq_min_mhz", "freq_max_mhz", "has_spec",
        F.posexplode(fired).alias("rule_no", "a"),
    ).select(
        *ids, "miner_id", "rule_no", "a.action", "a.value", "a.reason", "a.priority",
        "temperature_c", "freq_min_mhz", "freq_max_mhz", "has_spec",
    )


def dashboard_actions(df: DataFrame, cfg: DashboardControlConfig = DashboardControlConfig()) -> DataFrame:
    """Dashboard variant: emits only real changes; each device is flagged once.

    Rules see the row's own frequency (the thermal step of the same row is
    applied before the price step, nothing is carried to later rows).
    """
    df = with_freq_limits(df)
    t, f, price = F.col("temperature_c"), F.col("clock_frequency_mhz"), F.col("energy_price")
    lo, hi = F.col("freq_min_mhz"), F.col("freq_max_mhz")
    degrees, dollars = half_up(t, 1), half_up(price, 3)
    cooled = F.when(t > cfg.critical_c, F.greatest(lo, f - cfg.critical_step)).when(
        t > cfg.warning_c, F.greatest(lo, f - cfg.warning_step))
    now = F.coalesce(cooled, f)
    cheap = (price < cfg.cheap_usd) & (t < cfg.cheap_below_c)
    priced = F.when(cheap, F.least(hi, now + cfg.cheap_step)).when(
        price > cfg.expensive_usd, F.greatest(lo, now - cfg.expensive_step))

    def change(when, action, old, new, reason):
        return F.when(when, F.struct(
            F.lit(action).alias("action"), old.cast("double").alias("old_value"),
            new.cast("double").alias("new_value"), reason.alias("reason")))

    heat_text = F.when(t > cfg.critical_c, F.format_string("Thermal critical: %.1fC", degrees)).otherwise(
        F.format_string("Thermal warning: %.1fC", degrees))
    changes = F.filter(F.array(
        change(cooled.isNotNull() & (cooled != f), "REDUCE_FREQ", f, cooled, heat_text),
        change(cheap & (priced != now), "BOOST_FREQ", now, priced,
               F.format_string("Cheap energy: $%.3f/kWh", dollars)),
        change(~F.coalesce(cheap, F.lit(False)) & (price > cfg.expensive_usd) & (priced != now), "THROTTLE_FREQ",
               now, priced, F.format_string("Expensive energy: $%.3f/kWh", dollars)),
    ), lambda a: a.isNotNull())
    ids = [c for c in ("timestamp", TIE_BREAK) if c in df.columns] + ["miner_id"]
    steps = df.select(*ids, F.explode(changes).alias("a")).select(*ids, "a.*")
    # One flag per device: its first predicted row.  The aggregate keeps one
    # row per device and map task.
    order = F.struct(*[c for c in ids if c != "miner_id"])
    flags = (
        df.where(F.coalesce(F.col("predicted_failure"), F.lit(False)))
        .groupBy("miner_id").agg(F.min_by(F.struct(*ids, "anomaly_score"), order).alias("r"))
        .select(*[F.col(f"r.{c}").alias(c) for c in ids], F.lit("FLAG_MAINTENANCE").alias("action"),
                F.lit(0.0).alias("old_value"), F.lit(1.0).alias("new_value"),
                F.format_string("Anomaly score: %.4f", half_up(F.col("r.anomaly_score"), 4)).alias("reason"))
    )
    return steps.unionByName(flags)


def emergency_shutdown(df: DataFrame, cfg: ControlConfig = ControlConfig()) -> DataFrame:
    ids = [c for c in ("timestamp", TIE_BREAK) if c in df.columns]
    t = F.col("temperature_c")
    return df.where(t >= cfg.shutdown_c).select(
        *ids, "miner_id", F.lit("set_mode").alias("action"), F.lit(0.0).alias("value"),
        F.format_string(f"EMERGENCY: %.1fC >= {cfg.shutdown_c}C", half_up(t, 1)).alias("reason"),
        F.lit("critical").alias("priority"),
    )


# ---------------------------------------------------------------------------
# Safety guard
#
# Which action is approved depends on the last approved one, so a device is
# sequential - but a block of its actions only needs one number from the past:
# the time of the last approved action.  What a block makes of that number is a
# step function, kept as a sorted array of (accepts_upto, exit): an entry time
# up to the first ``accepts_upto`` that is not less leaves as that ``exit``, a
# later one passes through.  Composing two such functions is associative, so the
# blocks of a device are folded in two bounded levels, and every block is then
# walked on its own from its known entry time.  All of it are array functions:
# nothing runs in Python and nothing runs before the result is asked for.
# ---------------------------------------------------------------------------

GUARD_CHUNK = 256
GUARD_GROUP = 512
NEVER = -(2 ** 62)
ALWAYS = 2 ** 62
_STEPS = "array<struct<accepts_upto:bigint,exit:bigint>>"


def _passes(a: Column, last: Column, gap: int) -> Column:
    return ~a["limited"] | (a["t"] - last >= gap)


def _step_function(rows: Column, gap: int) -> Column:
    """What a block of rows (sorted by time) makes of the time of the last approved action before it."""
    limit = lambda a: F.when(a["limited"], a["t"] - gap).otherwise(F.lit(ALWAYS))
    # The first row that is approved whatever came before, and the rows in front of it, can be entry points.
    sure = F.array_position(F.transform(rows, lambda a: ~a["limited"] | (a["t"] >= F.get(rows, F.lit(0))["t"] + gap)), True)
    head = F.slice(rows, 1, F.when(sure > 0, sure.cast("int")).otherwise(F.size(rows)))
    fresh = F.filter(F.transform(head, lambda a, i: F.struct(i.alias("i"), limit(a).alias("accepts_upto"), a["t"].alias("t"))),
                     lambda x: (x["i"] == 0) | (x["accepts_upto"] > limit(F.get(rows, x["i"] - 1))))
    return F.transform(fresh, lambda x: F.struct(
        x["accepts_upto"].alias("accepts_upto"),
        F.aggregate(F.slice(rows, x["i"] + 2, F.size(rows)), x["t"],
                    lambda last, a: F.when(_passes(a, last, gap), a["t"]).otherwise(last)).alias("exit")))


def _leaves(steps: Column, entry: Column) -> Column:
    return F.coalesce(F.get(F.filter(steps, lambda x: x["accepts_upto"] >= entry), F.lit(0))["exit"], entry)


def _composed(first: Column, then: Column) -> Column:
    """The step function of two blocks in a row."""
    top = F.when(F.size(first) > 0, F.element_at(first, -1)["accepts_upto"]).otherwise(F.lit(NEVER - 1))
    through = F.transform(first, lambda x: F.struct(x["accepts_upto"].alias("accepts_upto"), _leaves(then, x["exit"]).alias("exit")))
    return F.concat(through, F.filter(then, lambda x: x["accepts_upto"] > top))


def _entered(parts: Column, entry: Column, kind: str) -> Column:
    """(at, entry) of consecutive blocks given as (at, steps), from the entry time of the first."""
    start = F.struct(entry.alias("now"), F.array().cast(f"array<struct<at:{kind},entry:bigint>>").alias("seen"))
    return F.aggregate(parts, start, lambda acc, p: F.struct(
        _leaves(p["steps"], acc["now"]).alias("now"),
        F.concat(acc["seen"], F.array(F.struct(p["at"].alias("at"), acc["now"].alias("entry")))).alias("seen")))["seen"]


def _walked(rows: Column, entry: Column, gap: int) -> Column:
    """(last, approved) of each row of a block."""
    start = F.struct(entry.alias("now"), F.array().cast("array<struct<last:bigint,approved:boolean>>").alias("seen"))

    def step(acc: Column, a: Column) -> Column:
        ok = _passes(a, acc["now"], gap)
        return F.struct(F.when(ok, a["t"]).otherwise(acc["now"]).alias("now"), F.concat(
            acc["seen"], F.array(F.struct(acc["now"].alias("last"), ok.alias("approved")))).alias("seen"))

    return F.aggregate(rows, start, step)["seen"]


def safety_guard(
    actions: DataFrame, cfg: ControlConfig = ControlConfig(), series: Series | None = None,
    chunk_rows: int = GUARD_CHUNK, group: int = GUARD_GROUP,
) -> DataFrame:
    """Approve, clamp or reject proposed actions, with the reason of a rejection.

    1. At or above the shutdown temperature only maintenance flags pass.
    2. A ``set_*`` action within the minimum interval of the device's last
       approved action (of any kind) is rejected.
    3. Frequencies are clamped to the hardware limits; ``final_reason`` says so.

    A block holds at most ``chunk_rows`` actions of one time slot; rows without a
    device or a time are one device and the first slot.
    """
    base = series or Series.of(actions)
    gap = cfg.min_interval_s * MICROS
    keys = [f"__k{i}" for i in range(len(base.keys))]
    too_hot = (F.col("temperature_c") >= cfg.shutdown_c) & (F.col("action") != "flag_maintenance")
    too_hot = F.coalesce(too_hot, F.lit(False))
    rejected = actions.where(too_hot).select(
        *actions.columns,
        F.lit(False).alias("approved"),
        F.format_string(f"Thermal shutdown: %.1fC >= {cfg.shutdown_c}C", half_up(F.col("temperature_c"), 1))
        .alias("rejection_reason"),
    )
    live = actions.where(~too_hot).select(
        *[F.col(c).alias(k) for c, k in zip(base.keys, keys)], F.struct(*[F.expr(e) for e in base.slots]).alias("__slot"),
        F.struct(*[F.col(c) for c in (*base.order, "rule_no")]).alias("__order"),
        F.coalesce(F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(0)).alias("t"),
        F.col("action").startswith("set_").alias("limited"), F.struct(*actions.columns).alias("a"))
    inside = Window.partitionBy(*keys, "__slot").orderBy("__order")
    live = live.withColumn("n", F.row_number().over(inside) - 1).withColumn("__part", F.floor(F.col("n") / chunk_rows))
    # The window's exchange serves the blocks too.
    rows = F.array_sort(F.collect_list(F.struct("n", "t", "limited", "a"))).alias("rows")
    blocks = live.groupBy(*keys, "__slot", "__part").agg(rows).select(*keys, F.struct("__slot", "__part").alias("at"), "rows")

    kind = blocks.schema["at"].dataType.simpleString()
    steps = blocks.select(*keys, "at", _step_function(F.col("rows"), gap).alias("steps"))
    along = Window.partitionBy(*keys).orderBy("at")
    grouped = steps.withColumn("g", F.floor((F.row_number().over(along) - 1) / group)).groupBy(*keys, "g").agg(
        F.array_sort(F.collect_list(F.struct("at", "steps"))).alias("parts"))
    folded = grouped.withColumn("steps", F.aggregate(
        "parts", F.array().cast(_STEPS), lambda acc, p: _composed(acc, p["steps"])))
    heads = folded.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("g").alias("at"), "steps"))).alias("groups"))
    heads = heads.select(*[F.col(k).alias(f"{k}h") for k in keys], F.inline(_entered(F.col("groups"), F.lit(NEVER), "bigint")).alias("gh", "from"))
    same = lambda mark: [F.col(k).eqNullSafe(F.col(f"{k}{mark}")) for k in keys]
    entries = folded.join(heads, [F.col("g") == F.col("gh"), *same("h")]).select(
        *[F.col(k).alias(f"{k}e") for k in keys], F.inline(_entered(F.col("parts"), F.col("from"), kind)).alias("ate", "entry"))

    ready = blocks.join(entries, [F.col("at").eqNullSafe(F.col("ate")), *same("e")])
    decided = ready.select(F.explode(F.arrays_zip("rows", _walked(F.col("rows"), F.col("entry"), gap).alias("seen"))).alias("x"))
    decided = decided.select("x.rows.a.*", F.col("x.rows.t").alias("__t"), F.col("x.seen.last").alias("__last"), F.col("x.seen.approved").alias("approved"))
    ago = (F.col("__t") - F.col("__last")) / MICROS
    checked = decided.select(
        *actions.columns, "approved",
        F.when(~F.col("approved"), F.format_string("Rate limited: last action %ds ago", F.floor(ago + 0.5)))
        .alias("rejection_reason"),
    )
    return with_clamp(rejected.unionByName(checked))


def with_clamp(decided: DataFrame) -> DataFrame:
    """Adds the value that is carried out, and the reason with the limits where they changed it."""
    lo, hi, value = F.col("freq_min_mhz"), F.col("freq_max_mhz"), F.col("value")
    clamps = F.col("approved") & (F.col("action") == "set_frequency") & F.col("has_spec")
    bounded = F.when(clamps, F.least(F.greatest(value, lo), hi)).otherwise(value)
    out = decided.withColumn("final_value", bounded)
    if "reason" not in decided.columns:
        return out
    note = F.format_string("%s (clamped to [%d, %d])", F.col("reason"), lo.cast("long"), hi.cast("long"))
    return out.withColumn("final_reason", F.when(clamps & (F.col("final_value") != value), note).otherwise(F.col("reason")))
