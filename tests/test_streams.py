"""Streams over several micro-batches, out of order, with a restart from the checkpoint: the batch operators' rows."""

import random

import pytest
from pyspark.sql import functions as F

from ticklattice.operators import indicators, states
from ticklattice.streaming import processors

SCHEMA = "symbol string, ts_ms long, seq long, price double, v double, bid1_q double, ask1_q double, bid2_q double, ask2_q double, z_ofi double, z_cvd double, lag_sec double"


@pytest.fixture(autouse=True)
def store(spark):
    own = dict([processors.STORE, ("spark.sql.shuffle.partitions", "2")])
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def made(n=400, seed=3):
    rng, at, rows = random.Random(seed), 1_700_000_000_000, []
    for i in range(n):
        at += rng.choice([0, 10, 300, 900, 2500])
        q = [float(rng.randrange(1, 9)) for _ in range(4)]
        rows.append((rng.choice("AB"), at, i, float(100 + rng.randrange(-4, 5)), rng.uniform(-3, 3), *q, rng.choice([None, rng.uniform(-4, 4), rng.uniform(-4, 4)]), rng.uniform(-4, 4), rng.choice([0.0, 0.0, 1.0])))
    return rows


def streamed(spark, folder, rows, transform, cuts=(2, 1), shuffle=4000):
    """Feeds rows in files, out of order by up to `shuffle` ms; stops and restarts after cuts[0] files. A late row of each symbol
    ends the stream. Gives the rows written."""
    rng = random.Random(1)
    rows = sorted(rows, key=lambda r: r[1] + rng.uniform(0, shuffle))
    end = max(r[1] for r in rows) + 3_600_000
    files = sum(cuts)
    parts = [rows[i * len(rows) // files : (i + 1) * len(rows) // files] for i in range(files)]
    parts.append([(s, end + 1000 * k, 10**6 + 2 * k + j, *([1.0] * (len(rows[0]) - 3))) for k in range(2) for j, s in enumerate("AB")])
    source, at = f"{folder}/in", 0
    counts = []
    for cut in (cuts[0], cuts[1] + 1):
        for part in parts[at : at + cut]:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        at += cut
        stream = transform(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        counts.append(sum(p["numInputRows"] > 0 for p in q.recentProgress))
    assert counts[0] >= 2 and counts[1] >= 2  # several micro-batches before and after the restart
    return spark.read.parquet(f"{folder}/out").where("seq < 1000000")


def same(a, b, columns):
    key = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    return sorted(map(key, a.select(*columns).collect()), key=str) == sorted(map(key, b.select(*columns).collect()), key=str)


def test_order_flow_stream(spark, tmp_path):
    rows = made()
    got = streamed(spark, tmp_path, rows, processors.order_flow)
    want = indicators.order_flow(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == len(rows) and same(got, want, ["symbol", "seq", "ofi", "session_id"])


def test_fusion_stream(spark, tmp_path):
    rows = made(seed=5)
    got = streamed(spark, tmp_path, rows, processors.fusion_signals)
    want = states.denoised(states.fused(spark.createDataFrame(rows, SCHEMA)))
    assert same(got, want, ["symbol", "seq", "fusion", "consistency", "fusion_label", "signal"]) and got.where("signal <> 0").count() > 5


def test_divergence_stream(spark, tmp_path):
    rows = made(seed=7)
    got = streamed(spark, tmp_path, rows, lambda r: processors.divergences(r, "v", 2, 3))
    want = indicators.divergences(spark.createDataFrame(rows, SCHEMA), "price", "v", 2, 3).where("known_seq is not null")
    assert same(got.where("known_seq < 1000000"), want, ["symbol", "seq", "known_seq", "divergence", "score"]) and want.count() > 5


def test_first_seen_stream(spark, tmp_path):
    # a stream with a time to live wakes without data; a run over what is there ends only without such batches
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = [(s, t, q % 50, *r) for s, t, q, *r in made(200)]
    got = streamed(spark, tmp_path, rows, lambda r: processors.first_seen(r.withColumn("trade_id", F.when(F.col("seq") != 7, F.col("seq"))), "trade_id"))
    ids = {(r[0], r[2]) for r in rows if r[2] != 7}
    assert sorted((r.symbol, r.seq) for r in got.where("seq <> 7").collect()) == sorted(ids)
    assert got.where("seq = 7").count() == sum(r[2] == 7 for r in rows)  # no id: all pass
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
