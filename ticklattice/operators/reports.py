"""Reports over trades, signals and trials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trade_stats(trades: DataFrame, *keys) -> DataFrame:
    """trades: gross, fee, slip, net, hold_s, notional. For each key: count, sums, win_rate, mean win over mean loss (rr; null
    without both), mean hold and net, and cost in bps of the notional."""
    net = F.col("net")
    rr = F.avg(F.when(net > 0, net)) / F.avg(F.when(net < 0, -net))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("gross", "fee", "slip", "net", "notional")), F.avg((net > 0).cast("int")).alias("win_rate"), rr.alias("rr"),
        F.avg("hold_s").alias("hold_s"), F.avg("net").alias("mean_net"), (F.sum(F.col("fee") + F.col("slip")) / F.greatest(F.sum("notional"), F.lit(1e-9)) * 1e4).alias("cost_bps"),
    )


def by_hour(trades: DataFrame, hour: Column) -> DataFrame:
    """trade_stats of each hour, 0 to 23, hours without trades included."""
    t = trade_stats(trades, hour.alias("hour"))
    hours = trades.sparkSession.range(24).withColumnRenamed("id", "hour")
    return hours.join(F.broadcast(t), "hour", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # t has 24 rows at most


def gross_of(net: Column, fee: Column, slippage_bps: Column, notional: Column, qty: Column, px: Column, other: float = 200.0) -> Column:
    """net + fee + slippage on the notional: given, else qty x px, else `other`."""
    return net + fee + slippage_bps * F.coalesce(notional, qty * px, F.lit(other)) / 1e4


def win_matrix(trades: DataFrame, hour: Column, scenario: Column, scenarios: tuple[str, ...]) -> DataFrame:
    """Share of winning trades by hour, a column for each scenario."""
    return trades.withColumn("hour", hour).withColumn("_s", scenario).groupBy("hour").pivot("_s", list(scenarios)).agg(F.avg((F.col("net") > 0).cast("int")))


def maker_shares(fills: DataFrame, maker: Column, entry: Column) -> DataFrame:
    """For each symbol the share of maker fills in all, entries and exits; turnover of both kinds, and expected by the probability
    p; median and 95th percentile of effective spreads (with linear interpolation)."""
    m = maker.cast("int")
    return fills.groupBy("symbol").agg(
        F.avg(m).alias("maker"), F.avg(F.when(entry, m)).alias("maker_entry"), F.avg(F.when(~entry, m)).alias("maker_exit"),
        F.sum(F.col("notional") * F.col("p")).alias("maker_turnover"), F.sum(F.col("notional") * (1 - F.col("p"))).alias("taker_turnover"),
        F.sum(F.when(maker, F.col("notional")).otherwise(0.0)).alias("by_makers"), F.sum(F.when(maker, 0.0).otherwise(F.col("notional"))).alias("by_takers"),
        F.percentile("slippage_bps", F.lit(0.5)).alias("spread_p50"), F.percentile("slippage_bps", F.lit(0.95)).alias("spread_p95"),
    )


def by_tier(fills: DataFrame, tier: Column, scenario: Column, scenarios: tuple[str, ...]) -> DataFrame:
    """For each tier: fills, turnover and its share, fees, cost in bps of the turnover (fees and slippage; of 1e-9 at least), and
    the shares of fills whose scenario is none of `scenarios` and whose fee is null or below 0."""
    rows = fills.withColumn("tier", tier)
    total = rows.agg(F.sum("notional").alias("_all"))
    wrong = lambda x: F.avg((~F.coalesce(x, F.lit(False))).cast("int"))
    g = rows.groupBy("tier").agg(
        F.count("*").alias("n"), F.sum("notional").alias("turnover"), F.sum("fee").alias("fee"), (F.sum(F.coalesce("fee", F.lit(0.0)) + F.col("notional") * F.col("slippage_bps") / 1e4) / F.greatest(F.sum("notional"), F.lit(1e-9)) * 1e4).alias("cost_bps"),
        wrong(scenario.isin(*scenarios)).alias("bad_scenario"), wrong(F.col("fee") >= 0).alias("bad_fee"),
    )
    return g.join(F.broadcast(total)).withColumn("share", F.col("turnover") / F.greatest("_all", F.lit(1e-9))).drop("_all")  # one row


def tally(rows: DataFrame, *keys: str, share_of: str | None = None) -> DataFrame:
    """Counts by keys, most common first by rank, and the share among rows with equal share_of (of all without it)."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = rows.groupBy(share_of).agg(F.count("*").alias("_all")) if share_of else rows.agg(F.count("*").alias("_all"))
    j = n.join(total, share_of) if share_of else n.join(F.broadcast(total))  # one row
    return j.withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def last_minutes(signals: DataFrame, minutes: int) -> DataFrame:
    """Signals and confirmed ones of each symbol's last minutes, minutes without any included."""
    at = F.expr("ts_ms div 60000")
    n = signals.groupBy("symbol", at.alias("minute")).agg(F.count("*").alias("signals"), F.count_if("confirm").alias("confirmed"))
    last = n.groupBy("symbol").agg(F.max("minute").alias("_last"))
    want = last.select("symbol", F.explode(F.sequence(F.col("_last") - (minutes - 1), F.col("_last"))).alias("minute"))
    return want.join(n, ["symbol", "minute"], "left").select("symbol", "minute", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("signals", "confirmed")))


def rank_scores(trials: DataFrame, up: dict[str, float], down: dict[str, float], penalties: list[tuple[Column, float]]) -> DataFrame:
    """score: weighted sum of each objective's rank score (the share of trials that are worse; for `down` those above), less
    the penalties that hold. Ranks come from counts of equal values, not of rows."""
    out = trials
    total = trials.agg(F.count("*").alias("_total"))
    parts = []
    for c, w in [*up.items(), *down.items()]:
        n = trials.groupBy(c).agg(F.count("*").alias("_c"))
        order = F.col(c) if c in up else F.desc(c)
        below = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # over distinct values of trials
        n = n.select(c, F.coalesce(F.sum("_c").over(below), F.lit(0)).alias(f"_below_{c}"))
        out = out.join(n, c)
        parts.append(w * F.col(f"_below_{c}"))
    out = out.join(F.broadcast(total))  # one row
    less = reduce(lambda a, b: a + b, (F.when(test, x).otherwise(0.0) for test, x in penalties), F.lit(0.0))
    score = reduce(lambda a, b: a + b, parts) / F.col("_total") - less
    return out.withColumn("score", score).select(*trials.columns, "score")


def merged_windows(metrics: DataFrame, key: str, sums: list[str], by_trades: list[str], worst: list[str]) -> DataFrame:
    """Metrics of several windows as one: sums, means weighted by trades, and the largest of what is worse the larger it is."""
    n = F.sum("trades")
    return metrics.groupBy(key).agg(n.alias("trades"), *(F.sum(c).alias(c) for c in sums), *((F.sum(F.col(c) * F.col("trades")) / n).alias(c) for c in by_trades), *(F.max(c).alias(c) for c in worst))


def walk_forward(days: DataFrame, train: int, test: int) -> DataFrame:
    """Folds of `train` days followed by `test` days, moving on by `test`, from the table's first day to the last whole fold: mean
    daily net of both parts for each symbol and fold, and the gap between them. A day goes to the folds that hold it."""
    ends = days.agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    j = days.join(F.broadcast(ends))  # one row
    whole = F.expr(f"(_last - _first + 1 - {train + test}) div {test}")  # the last fold's number; below 0: none
    low = F.greatest(F.lit(0), F.ceil((F.col("day") - F.col("_first") - (train + test - 1)) / test)).cast("long")
    high = F.least(F.expr(f"(day - _first) div {test}"), whole)
    j = j.where(F.expr(f"_last - _first + 1 >= {train + test}") & (low <= high)).withColumn("fold", F.explode(F.sequence(low, high)))
    tested = F.col("day") >= F.col("_first") + F.col("fold") * test + train
    g = j.groupBy("fold", "symbol").agg(F.avg(F.when(~tested, F.col("net"))).alias("train"), F.avg(F.when(tested, F.col("net"))).alias("test"))
    return g.withColumn("fold", F.col("fold").cast("int")).withColumn("gap", F.col("train") - F.col("test"))


def grid(spark, values: dict[str, list[float]], most: int | None = None) -> DataFrame:
    """Every combination of parameter values, a row each, numbered by a hash's order; with `most` the first of these. w_ofi and
    w_cvd, if both are there, are scaled to add up to 1 (equal ones then count once)."""
    out = spark.range(1).select()
    for c, v in values.items():
        out = out.withColumn(c, F.explode(F.array(*map(F.lit, v))))
    if {"w_ofi", "w_cvd"} <= set(values):
        total = F.col("w_ofi") + F.col("w_cvd")
        out = out.withColumns({c: F.round(F.col(c) / total, 9) for c in ("w_ofi", "w_cvd")}).distinct()
    key = F.md5(F.concat_ws("|", *(F.format_string("%.8f", F.col(c).cast("double")) for c in values)))
    order = F.row_number().over(Window.orderBy(key))  # a table of trials
    out = out.withColumn("trial", order)
    return out.where(F.col("trial") <= most) if most else out


def halved(trials: DataFrame, score: Column, eta: int) -> DataFrame:
    """One step of successive halving: the best 1 / eta of the trials by score, ties by trial, one at least."""
    n = trials.agg(F.count("*").alias("_n"))
    r = trials.withColumn("_r", F.row_number().over(Window.orderBy(score.desc(), "trial"))).join(F.broadcast(n))
    return r.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") / eta))).drop("_r", "_n")


def compared_metrics(a: DataFrame, b: DataFrame, key: str, metrics: list[str], tolerance: float) -> DataFrame:
    """key, metric, both values, relative difference and whether it is within the tolerance."""
    long = lambda x, to: x.select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(to)) for m in metrics))).alias("x")).select(key, "x.*")
    j = long(a, "a").join(long(b, "b"), [key, "metric"], "full_outer")
    rel = F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs("a"), F.abs("b"), F.lit(1e-9))
    return j.withColumn("relative", rel).withColumn("within", F.coalesce(rel <= tolerance, F.lit(False)))


def parity_score(rows: DataFrame, status: Column, price: Column, reason: Column) -> DataFrame:
    """For each symbol the mean of .5 status + .25 price + .25 reason agreement, and an alert level by it."""
    s = F.avg(0.5 * status.cast("int") + 0.25 * price.cast("int") + 0.25 * reason.cast("int"))
    out = rows.groupBy("symbol").agg(F.count("*").alias("n"), s.alias("score"))
    return out.withColumn("level", F.when(F.col("score") < 0.98, "critical").when(F.col("score") < 0.99, "warning").otherwise("ok"))


def last_of_each(rows: DataFrame, n: int, most: int) -> DataFrame:
    """The last n rows of each symbol, and of these the `most` latest."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts_ms"), F.desc("seq"))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r").orderBy(F.desc("ts_ms"), F.desc("seq"), "symbol").limit(most)


def quantiles(rows: DataFrame, value: str, *keys: str, qs: tuple[float, ...] = (0.05, 0.95, 0.99)) -> DataFrame:
    """Quantiles with linear interpolation, and those of |value| at 0.95."""
    return rows.groupBy(*keys).agg(*(F.percentile(value, F.lit(q)).alias(f"p{round(q * 100):02d}") for q in qs), F.percentile(F.abs(value), F.lit(0.95)).alias("abs_p95"), F.avg((F.abs(value) >= 2).cast("int")).alias("clip_rate"))


#: Rows of a table that is shown to people.
REPORT_ROWS = 10_000


def markdown(rows: DataFrame, title: str) -> str:
    """A report's table as Markdown; one of more than REPORT_ROWS rows is no report and raises."""
    head = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    few = rows.limit(REPORT_ROWS + 1).collect()
    if len(few) > REPORT_ROWS:
        raise ValueError(f"{title} has more than {REPORT_ROWS} rows")
    return "\n".join([*head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in few)]) + "\n"


def lag_samples(executions: DataFrame, lag: str, ok: Column, last: int = 100) -> DataFrame:
    """For each symbol: the mean lag of its last executions that have one, how many these are, and the share that succeeded of
    all. A symbol's executions are cut by time: only the last `last` of each part meet."""
    has = F.struct("ts_ms", "seq", F.col(lag).cast("double").alias("v"))
    tail = lambda x: F.slice(F.sort_array(x, asc=False), 1, last)
    part = executions.groupBy("symbol", F.expr("ts_ms div 3600000").alias("_part")).agg(tail(F.collect_list(F.when(F.col(lag).isNotNull(), has))).alias("_l"), F.count("*").alias("_n"), F.count_if(ok).alias("_ok"))
    later = Window.partitionBy("symbol").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_done", F.coalesce(F.sum(F.size("_l")).over(later), F.lit(0)))  # samples in later parts
    of = F.when(F.col("_done") < last, F.slice("_l", 1, F.greatest(F.lit(1), F.lit(last) - F.col("_done")).cast("int"))).otherwise(F.array().cast(part.schema["_l"].dataType))
    part = part.withColumn("_l", of).withColumn("_sum", F.aggregate("_l", F.lit(0.0), lambda a, x: a + x["v"]))
    g = part.groupBy("symbol").agg(F.sum("_sum").alias("_s"), F.sum(F.size("_l")).alias("samples"), (F.sum("_ok") / F.sum("_n")).alias("success_rate"))
    return g.select("symbol", F.try_divide("_s", "samples").alias("mean_lag"), "samples", "success_rate")


def executions(rows: DataFrame, meta_schema: str, symbols: list[str] | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Executions of the symbols and times asked for (end included) in order of exec_ts_ms, meta_json parsed as meta; null where
    it is no JSON of that kind. Written as JSON lines they are an export."""
    if symbols:
        rows = rows.where(F.col("symbol").isin(symbols))
    if start_ms is not None:
        rows = rows.where(F.col("exec_ts_ms") >= start_ms)
    if end_ms is not None:
        rows = rows.where(F.col("exec_ts_ms") <= end_ms)
    return rows.withColumn("meta", F.from_json("meta_json", meta_schema)).orderBy("exec_ts_ms")
