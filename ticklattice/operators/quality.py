"""Quality gates, deduplication and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import BLOCK, with_previous
from .decisions import reasons


def gate(rows: DataFrame, required: list[str], key: list[str], order: list[str], rules: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ok, bad, report): bad rows have reasons (missing_<column> for a null in a required column, those of rules that hold,
    duplicate for all but the first of a key); report counts rows and reasons."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    why = reasons(*((F.col(c).isNull(), f"missing_{c}") for c in required), *rules, (F.col("_n") > 1, "duplicate"))
    judged = rows.withColumn("_n", n).withColumn("reasons", why).drop("_n")
    ok, bad = judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)
    report = judged.select(F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("ok"))).otherwise(F.col("reasons"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return ok, bad, report


def keep_one(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Of rows with equal key the first in that order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def keep_last(rows: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    return keep_one(rows, key, F.desc(order))


def keep_first(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    return keep_one(rows, key, *map(F.col, order or ("seq",)))


def within_window(rows: DataFrame, row_id: str, window_ms: int = 1000) -> DataFrame:
    """Leaves out rows whose (symbol, ts_ms) an earlier row has, or whose row_id one of the last window_ms has. Rows without an
    id are told apart by their time alone."""
    first = keep_first(rows, ["symbol", "ts_ms"])
    own = F.concat_ws("\x00", F.col(row_id).cast("string"), "symbol")  # the row before with that id
    r = with_previous(first.withColumn("_of", F.col("symbol")).withColumn("symbol", own), ["ts_ms"]).withColumn("symbol", F.col("_of"))
    again = F.col(row_id).isNotNull() & (F.col("ts_ms") - F.col("_prev.ts_ms") <= window_ms)
    return r.where(~F.coalesce(again, F.lit(False))).select(*rows.columns)


def cleaned(rows: DataFrame, numbers: list[str], ids: list[str] = [], flags: list[str] = []) -> DataFrame:  # noqa: B006
    """Infinite and NaN numbers and texts that are none become null, missing ids -1, missing flags false."""
    for c in numbers:
        x = F.col(c).try_cast("double")
        rows = rows.withColumn(c, F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x))
    for c in ids:
        rows = rows.withColumn(c, F.coalesce(F.col(c).try_cast("long"), F.lit(-1).cast("long")))
    for c in flags:
        rows = rows.withColumn(c, F.coalesce(F.col(c).try_cast("boolean"), F.lit(False)))
    return rows


def order_faults(rows: DataFrame, order: str = "seq") -> DataFrame:
    """For each symbol: rows, rows without ts_ms, rows whose ts_ms is before that of the row before in `order` (a whole number),
    and the first three of these. A symbol's rows are cut by `order`, and summed up by those parts first."""
    r = rows.select("symbol", F.col("ts_ms").alias("_t"), F.col(order).cast("long").alias("ts_ms"))
    r = with_previous(r, ["_t"], order=(), width=BLOCK)
    bad = F.coalesce(F.col("_t") < F.col("_prev._t"), F.lit(False))
    three = lambda x: F.slice(F.array_sort(x), 1, 3)
    part = r.groupBy("symbol", F.expr(f"ts_ms div {BLOCK}").alias("_part")).agg(F.count("*").alias("rows"), F.count_if(F.col("_t").isNull()).alias("missing"), F.count_if(bad).alias("backward"), three(F.collect_list(F.when(bad, F.col("ts_ms")))).alias("_s"))
    return part.groupBy("symbol").agg(*(F.sum(c).alias(c) for c in ("rows", "missing", "backward")), F.array_join(three(F.flatten(F.collect_list("_s"))), ",").alias("first_three"))


def audit(rows: DataFrame, values: list[str]) -> DataFrame:
    """A row for each value column: rows, share missing, share zero, mean."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in values))).alias("x")).select("x.*")
    return long.groupBy("name").agg(F.count("*").alias("rows"), F.avg(F.col("v").isNull().cast("int")).alias("missing"), F.avg((F.col("v") == 0).cast("int")).alias("zero"), F.avg("v").alias("mean"))


def continuity(files: DataFrame, most_min: float = 5.0) -> DataFrame:
    """For each symbol's intervals (start_ms, end_ms): gaps between the latest end so far and the next start above most_min
    minutes, their minutes, and GOOD (none), FAIR (three at most) or POOR."""
    w = Window.partitionBy("symbol").orderBy("start_ms", "end_ms")  # a row for each file
    gap = (F.col("start_ms") - F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))) / 60_000
    g = files.withColumn("_gap", gap).groupBy("symbol").agg(F.count("*").alias("files"), F.count_if(F.col("_gap") > most_min).alias("gaps"), F.coalesce(F.sum(F.when(F.col("_gap") > most_min, F.col("_gap"))), F.lit(0.0)).alias("gap_min"))
    return g.withColumn("grade", F.when(F.col("gaps") == 0, "GOOD").when(F.col("gaps") <= 3, "FAIR").otherwise("POOR"))


def coverage(rows: DataFrame, kind: str, kinds: tuple[str, ...], least: float) -> DataFrame:
    """For each symbol and expected kind: share of rows, and missed if below least."""
    n = rows.groupBy("symbol").agg(F.count("*").alias("_n"), *(F.count_if(F.col(kind) == k).alias(k) for k in kinds))
    out = n.select("symbol", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), (F.col(k) / F.col("_n")).alias("share")) for k in kinds))).alias("x")).select("symbol", "x.*")
    return out.withColumn("missed", F.col("share") < least)


def robustness(rows: DataFrame, unknown: Column, *keys: str, most: float = 0.05, least: int = 10) -> DataFrame:
    """For each key: rows, share unknown, and what speaks against the figures (few_rows, many_unknown, or ok)."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(unknown.cast("int")).alias("unknown"))
    return g.withColumn("verdict", F.when(F.col("n") < least, "few_rows").when(F.col("unknown") > most, "many_unknown").otherwise("ok"))


def fingerprint(rows: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """For each key a number that depends on the rows' columns but not on their order: the sum of 60 bits of each row's SHA-256."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    bits = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*keys).agg(F.sum(bits).cast("string").alias("fingerprint"), F.count("*").alias("n"))


def gaps_before(rows: DataFrame) -> DataFrame:
    return with_previous(rows, ["ts_ms"]).withColumn("gap_ms", F.col("ts_ms") - F.col("_prev.ts_ms")).drop("_prev")
