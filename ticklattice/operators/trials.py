"""Trials by level and date, and skylines over many goals."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import settled
from .reports import halved, merged_windows


def budgets(least: int, most: int, eta: int) -> list[int]:
    """least, least x eta, ... up to most; eta is 2 at least."""
    out = []
    while least <= most:
        out.append(least)
        least *= max(2, eta)
    return out


def successive_halving(results: DataFrame, score: Column, sums: list[str], by_trades: list[str], worst: list[str], least: int = 1, most: int = 60, eta: int = 3) -> DataFrame:
    """Each level's trials with their metrics and score: trial, level (from 1), budget, score, trades and the metrics.

    results has a row for each trial and step (a column `step` from 0: its date, minute or window) with trades and metrics. A level
    merges a trial's steps below its budget (sums, means weighted by trades, the largest of what is worse so) and scores
    that; the best 1 / eta (one at least; ties by trial, trials without a step last) go on to the next, whose budget is eta
    times as large. Every level is kept in the checkpoint folder before the next begins."""
    left = settled(results.select("trial").distinct())
    levels, out = budgets(least, most, eta), None
    for i, budget in enumerate(levels):
        own = merged_windows(results.where(F.col("step") < budget).join(left, "trial", "left_semi"), "trial", sums, by_trades, worst)
        level = left.join(own.withColumn("score", score), "trial", "left").withColumn("level", F.lit(i + 1)).withColumn("budget", F.lit(budget))
        level = settled(level.select("trial", "level", "budget", "score", "trades", *sums, *by_trades, *worst))
        out = level if out is None else out.unionByName(level)
        if i + 1 < len(levels):
            left = settled(halved(level, F.coalesce("score", F.lit(float("-inf"))), eta).select("trial"))
    return out


def skyline(points: DataFrame, names: list[str], fewer: int = 8) -> DataFrame:
    """The distinct rows of points (doubles, larger is better, no nulls) that no other row equals or betters in all and betters
    in one.

    A row that betters another is before it in descending order of the columns, so each task goes over its rows in that order
    once and holds its own skyline alone. Skylines of tasks are merged `fewer` at a time, in rounds."""
    kinds = ", ".join(f"`{c}` double" for c in names)

    def own(batches):
        kept = np.zeros((0, len(names)))
        for b in batches:
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                part = part[~_beaten(part, kept)]
                part = part[~_beaten(part, part)]
                kept = np.concatenate([kept, part])
        yield pa.RecordBatch.from_arrays([pa.array(kept[:, i]) for i in range(len(names))], names=names)

    order = [F.desc(c) for c in names]
    out = points.select(*names).distinct()
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        out = settled(out.repartition(parts).sortWithinPartitions(*order).mapInArrow(own, kinds))
        if parts == 1:
            return out
        parts = max(1, parts // fewer)


def _beaten(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether another row is at least as good in all and better in one."""
    out = np.zeros(len(rows), bool)
    for at in range(0, len(others), 4096):
        o = others[at : at + 4096]
        ge = np.ones((len(rows), len(o)), bool)
        gt = np.zeros((len(rows), len(o)), bool)
        for i in range(rows.shape[1]):
            a, b = rows[:, i][:, None], o[:, i][None]
            ge &= b >= a
            gt |= b > a
        out |= (ge & gt).any(axis=1)
    return out


def front(rows: DataFrame, up: list[str], down: list[str]) -> DataFrame:
    """Rows on the skyline of `up` (more is better) and `down` (less is better). Rows with a null goal go."""
    goals = [F.col(c).cast("double").alias(f"_g{i}") for i, c in enumerate(up)] + [(-F.col(c).cast("double")).alias(f"_g{len(up) + i}") for i, c in enumerate(down)]
    names = [f"_g{i}" for i in range(len(goals))]
    r = rows.select("*", *goals).dropna(subset=names)
    best = skyline(r, names).toDF(*(f"_b{n}" for n in names))
    same = reduce(lambda a, b: a & b, (F.col(n) == F.col(f"_b{n}") for n in names))
    return r.join(best, same, "left_semi").drop(*names)
