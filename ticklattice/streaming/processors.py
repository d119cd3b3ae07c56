"""Order flow, fusion and divergences of endless streams, with the batch operators' rows.

Each is a processor with state by symbol. Rows that arrive in any order within the
watermark's delay wait in a list state until the watermark has passed them (a timer wakes
a symbol that gets no more rows), and are then taken in order of (ts_ms, seq). A processor
adds only what earlier rows determine; formulas are the column functions that the batch
operators use, applied to its output. State is restored from the query's checkpoint.

Processors need the RocksDB state store (see STORE). Rows behind the watermark are late and
dropped by Spark; rows without a time never pass it and are left out before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators import indicators, states
from . import timed

#: The setting that a session with these streams has.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _schema(text: str) -> StructType:
    return StructType.fromDDL(text)


def _plain(v):
    """A value as Python's own, NaN and NaT as None."""
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
        return None
    return v.item() if isinstance(v, np.generic) else v


class Ordered(StatefulProcessor):
    """Hands rows to take() in order of event time. Subclasses: own (the DDL of their value state), made (that of the columns
    they add), take(rows, state) -> (added columns as a DataFrame with the index of the rows that stay, new state)."""

    own, made = "", ""

    def __init__(self, columns: str):
        # types are read here, on the driver: tasks can't parse them
        self.columns, self.state_type, self.added = _schema(columns), _schema(self.own), _schema(self.made).names

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.value = handle.getValueState("own", self.state_type)
        self.names = self.columns.names

    def take(self, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        raise NotImplementedError

    def _passed(self, parts: list[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        mark = timer_values.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        if held:
            parts = [pd.DataFrame(held, columns=self.names), *parts]
        rows = pd.concat(parts, ignore_index=True)[self.names].sort_values(["ts_ms", "seq"], ignore_index=True)
        ready = int(np.searchsorted(rows["ts_ms"].to_numpy(np.int64), mark, "left"))
        rest = rows.iloc[ready:]
        self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(rest):
            self.waiting.put([tuple(map(_plain, r)) for r in rest.itertuples(index=False)])
            self.handle.registerTimer(int(rest["ts_ms"].iloc[0]) + 1)
        rows = rows.iloc[:ready]
        if len(rows):
            more, state = self.take(rows, tuple(self.value.get()) if self.value.exists() else None)
            self.value.update(tuple(map(_plain, state)))
            if len(more):
                yield pd.concat([rows.loc[more.index], more], axis=1)

    def handleInputRows(self, key, rows, timerValues):
        yield from self._passed(list(rows), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._passed([], timerValues)

    def close(self) -> None:
        pass


class PreviousBook(Ordered):
    """prev_*: time and quantities of the symbol's row before, and session_id."""

    levels = ("bid1_q", "ask1_q", "bid2_q", "ask2_q")
    own = "ts_ms long, " + ", ".join(f"{c} double" for c in levels) + ", session long"
    made = "prev_ts_ms long, " + ", ".join(f"prev_{c} double" for c in levels) + ", session_id long"

    def take(self, rows, state):
        out = rows[["ts_ms", *self.levels]].shift(1).astype(float)
        session = 0
        if state is not None:
            out.iloc[0] = [np.nan if v is None else v for v in state[:-1]]
            session = state[-1]
        at, was = rows["ts_ms"], out["ts_ms"]
        new = was.isna() | (at - was > indicators.SESSION_GAP_MS) | (at // indicators.DAY_MS != was // indicators.DAY_MS)
        out.columns = [f"prev_{c}" for c in out.columns]
        out["prev_ts_ms"] = out["prev_ts_ms"].astype("Int64")
        out["session_id"] = session + new.cumsum().astype("int64")
        last = rows.iloc[-1]
        return out, (last["ts_ms"], *(last[c] for c in self.levels), out["session_id"].iloc[-1])


class FusionSignals(Ordered):
    """fusion (0 in the warm-up) and signal of rows with score and consistency."""

    own = "n long, way int, run int, at long, last int"
    made = "fusion double, signal int"

    def __init__(self, columns: str, warm_up: int, limits: tuple):
        super().__init__(columns)
        self.warm_up, self.limits = warm_up, limits

    def take(self, rows, state):
        n, *machine = state or (0, 0, 0, None, 0)
        m = states.Denoiser(*self.limits, state=tuple(machine))
        score = np.where(n + np.arange(1, len(rows) + 1) <= self.warm_up, 0.0, rows["score"].to_numpy(float))
        signal = [m.step(*r) for r in zip(rows["ts_ms"].tolist(), score.tolist(), rows["consistency"].tolist(), strict=True)]
        return pd.DataFrame({"fusion": score, "signal": np.array(signal, np.int32)}, index=rows.index), (n + len(rows), *m.state)


class Pivots(Ordered):
    """A row for each price pivot with the pivot of its kind before: the rows that stay are those at which a pivot is known. The
    last 2 x reach rows are a list state of their own, the last pivots of both kinds value states."""

    own = "n long"
    made = "kind string, pivot_seq long, at_row long, price_now double, of_now double, before_row long, price_before double, of_before double"

    def __init__(self, columns: str, value: str, reach: int):
        super().__init__(columns)
        self.of, self.reach = value, reach
        self.tail_type, self.pivot_type = _schema("ts_ms long, seq long, price double, x double"), _schema("ts_ms long, at_row long, price double, x double")

    def init(self, handle) -> None:
        super().init(handle)
        self.tail = handle.getListState("tail", self.tail_type)
        self.last = {k: handle.getValueState(f"last_{k}", self.pivot_type) for k in ("high", "low")}

    def take(self, rows, state):
        n, reach = (state or (0,))[0], self.reach
        old = [tuple(r) for r in self.tail.get()] if self.tail.exists() else []
        new = list(zip(rows["ts_ms"].tolist(), rows["seq"].tolist(), rows["price"].astype(float).tolist(), rows[self.of].astype(float).tolist(), strict=True))
        both = old + new
        price = pd.Series([r[2] for r in both])
        top, low = (f(price.rolling(2 * reach + 1, center=True)).to_numpy() for f in (lambda r: r.max(), lambda r: r.min()))
        found, index = [], []
        first = n - len(old)  # rows before both[0]
        for c in range(reach, len(both) - reach):
            if c + reach < len(old):
                continue  # known before
            at, seq, p, x = both[c]
            for kind, edge in (("high", top[c]), ("low", low[c])):
                if p != edge:
                    continue
                was = tuple(self.last[kind].get()) if self.last[kind].exists() else None
                if was is not None and was[0] == at:
                    continue  # of pivots of one time the first counts
                row = first + c + 1
                self.last[kind].update((at, row, p, x))
                if was is not None:
                    found.append((kind, seq, row, p, x, was[1], was[2], was[3]))
                    index.append(rows.index[c + reach - len(old)])
        self.tail.put(both[-2 * reach :])
        return pd.DataFrame(found, columns=self.added, index=index), (n + len(new),)


def _run(rows: DataFrame, processor: Ordered) -> DataFrame:
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "at") + ", " + processor.made
    return rows.groupBy("symbol").transformWithStateInPandas(processor, _schema(schema), "Append", "EventTime")


def _columns(rows: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)


def order_flow(book: DataFrame, late: str = "10 seconds") -> DataFrame:
    """ofi and session_id of a stream of books, as indicators.order_flow."""
    book = book.where("ts_ms is not null")
    out = _run(timed(book, late), PreviousBook(_columns(book)))
    return out.withColumn("ofi", indicators.flow_change(lambda c: F.col(f"prev_{c}"))).select(*book.columns, "ofi", "session_id")


def fusion_signals(rows: DataFrame, late: str = "10 seconds", warm_up: int = 10, least: float = 1.0, drop_to: float = 0.6, streak: int = 2, cooldown_ms: int = 3000, boost: float = 0.7, throttle: float = 0.3) -> DataFrame:
    """fusion, consistency, fusion_label and signal of a stream of rows with z_ofi, z_cvd and lag_sec, as states.denoised of
    states.fused."""
    score, same = states.fusion_parts()
    r = rows.where("ts_ms is not null and z_ofi is not null and z_cvd is not null").withColumns({"score": score, "consistency": same})
    out = _run(timed(r, late), FusionSignals(_columns(r), warm_up, (least, drop_to, streak, cooldown_ms, boost, throttle)))
    return out.withColumn("fusion_label", states.fusion_label()).drop("score")


def divergences(rows: DataFrame, value: str, reach: int = 3, apart: int = 6, late: str = "10 seconds") -> DataFrame:
    """symbol, seq (of the pivot), known_seq, known_ms, divergence and score of a stream of rows with price and the indicator
    `value`, as indicators.divergences."""
    r = rows.where("ts_ms is not null").select("symbol", "ts_ms", "seq", "price", value)
    p = _run(timed(r, late), Pivots(_columns(r), value, reach)).where(F.col("at_row") - F.col("before_row") >= apart)
    c = F.col
    kind = indicators.divergence_kind(c("kind") == "low", c("price_now") - c("price_before"), c("of_now") - c("of_before"))
    score = indicators.divergence_score(c("price_before"), c("price_now"), c("of_before"), c("of_now"), c("at_row") - c("before_row"), reach)
    out = p.withColumn("divergence", kind).where("divergence is not null").withColumn("score", score)
    return out.select("symbol", c("pivot_seq").alias("seq"), c("seq").alias("known_seq"), c("ts_ms").alias("known_ms"), "divergence", "score")


class FirstSeen(StatefulProcessor):
    """Rows whose id their symbol has not had within the time to live (of processing time)."""

    def __init__(self, column: str, ttl_ms: int):
        self.column, self.ttl_ms, self.key_type, self.value_type = column, ttl_ms, _schema("id string"), _schema("one int")

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", self.key_type, self.value_type, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            fresh = ~part[self.column].duplicated().to_numpy() | part[self.column].isna().to_numpy()
            for i, x in enumerate(part[self.column].tolist()):
                if fresh[i] and x is not None and x == x:
                    name = (str(x),)
                    fresh[i] = not self.seen.containsKey(name)
                    if fresh[i]:
                        self.seen.updateValue(name, (1,))
            if fresh.any():
                yield part[fresh]

    def close(self) -> None:
        pass


def first_seen(rows: DataFrame, column: str = "trade_id", ttl: str = "2 hours") -> DataFrame:
    """The first row of each id of a symbol; an id is forgotten after the time to live, so state is bounded. Rows without an id
    all pass. Such a stream wakes without data, so a run over what is there (availableNow) ends only with
    spark.sql.streaming.noDataMicroBatches.enabled off."""
    ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    named = rows.withColumn("id_as_text", F.col(column).cast("string"))  # as text, whatever pandas makes of numbers among nulls
    return named.groupBy("symbol").transformWithStateInPandas(FirstSeen("id_as_text", ms), _schema(_columns(named)), "Append", "ProcessingTime").drop("id_as_text")
