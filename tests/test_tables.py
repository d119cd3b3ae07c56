"""Versioned tables, tree layouts with damaged parts, batch ledgers, counts on the way, trials by level, skylines."""

import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ticklattice.operators import ledger as L
from ticklattice.operators import trials
from ticklattice.sources import layouts, readers, sinks, versions
from ticklattice.streaming import ledger

TABLE = "symbol string, day int, id long, seq long, price double"


def table(spark, rows):
    return spark.createDataFrame(rows, TABLE)


def plain(df):
    return sorted(map(tuple, df.select("symbol", "day", "id", "seq", "price").collect()), key=str)


def test_upsert_replaces_partitions_and_keeps_readers_whole(spark, tmp_path):
    path, parts = str(tmp_path / "t"), ["symbol", "day"]
    first = [("A", 1, 1, 1, 1.0), ("A", 1, 2, 1, 2.0), ("A", 2, 3, 1, 3.0), (None, 1, 4, 1, 4.0), ("A", 1, 1, 0, 9.0)]
    assert versions.upsert(table(spark, first), path, ["symbol", "id"], parts) == 1
    assert plain(versions.read_version(spark, path)) == sorted(first[:4], key=str)
    before = versions.read_version(spark, path)  # a reader that has begun
    untouched = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t/data/symbol=A/day=2").rglob("*.parquet")}
    assert versions.upsert(table(spark, [("A", 1, 1, 2, 5.0), ("A", 1, 2, 0, 7.0), (None, 1, 5, 1, 6.0), ("B", 1, 6, 1, 8.0)]), path, ["symbol", "id"], parts) == 2
    want = [("A", 1, 1, 2, 5.0), ("A", 1, 2, 1, 2.0), ("A", 2, 3, 1, 3.0), (None, 1, 4, 1, 4.0), (None, 1, 5, 1, 6.0), ("B", 1, 6, 1, 8.0)]
    assert plain(versions.read_version(spark, path)) == sorted(want, key=str)
    assert plain(before) == plain(versions.read_version(spark, path, 1)) == sorted(first[:4], key=str)
    assert untouched == {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t/data/symbol=A/day=2").rglob("*.parquet")}
    # a write that broke off has left data, but no manifest: nobody sees it
    table(spark, [("A", 1, 1, 9, 0.0)]).withColumn("_version", F.lit(3)).write.mode("append").partitionBy("symbol", "day", "_version").parquet(f"{path}/data")
    assert plain(versions.read_version(spark, path)) == sorted(want, key=str)
    versions.vacuum(spark, path)
    assert versions.version(spark, path) == 2 and plain(versions.read_version(spark, path)) == sorted(want, key=str)


def test_upsert_tells_of_a_conflict(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.upsert(table(spark, [("A", 1, 1, 1, 1.0)]), path, ["id"], ["day"])
    monkeypatch.setattr(versions, "version", lambda *a: 0)  # as seen before another writer's first write
    with pytest.raises(versions.Conflict):
        versions.upsert(table(spark, [("A", 1, 1, 2, 2.0)]), path, ["id"], ["day"])


def test_manifest_counts_this_write_alone(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1_700_000_000_000 + i, i, 1.0, f"r{i}") for i in range(3)], "symbol string, ts_ms long, seq long, price double, row_id string")
    for _ in range(2):
        m = sinks.write_checked(rows, str(tmp_path), "prices", ["price"], [], ["price"]).collect()
        assert sum(r.rows for r in m) == 3
    assert spark.read.parquet(f"{tmp_path}/ready").count() == 6
    assert sinks.write_checked(rows.limit(0), str(tmp_path), "prices", ["price"], [], ["price"]).collect() == []


def trees(tmp_path):
    def parquet(path, symbol, at, n=40, group=10):
        path.parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"ts_ms": [at + i for i in range(n)], "price": [random.Random(at + i).random() for i in range(n)]} | ({"symbol": [symbol] * n} if symbol else {})), path, row_group_size=group, use_dictionary=False, compression="zstd")

    parquet(tmp_path / "raw/date=2024-01-01/hour=05/symbol=A/kind=trades/p.parquet", None, 0)
    parquet(tmp_path / "raw/date=2024-01-02/hour=05/symbol=B/kind=trades/p.parquet", None, 1000)
    parquet(tmp_path / "preview/date=2024-01-01/symbol=A/kind=book/p.parquet", "A", 2000)
    (tmp_path / "ready/trades/A").mkdir(parents=True)
    (tmp_path / "ready/trades/A/x.jsonl").write_text("\n".join([json.dumps({"ts_ms": 5, "price": 1.5}), "", "{oops", json.dumps([1]), json.dumps({"ts_ms": "no", "price": 2.5, "extra": 1}), json.dumps({"ts_ms": 7, "symbol": "Z"})]))
    (tmp_path / "raw/_temporary").mkdir()


SCHEMA = "symbol string, kind string, date string, layout string, ts_ms long, price double"


def test_layouts_and_their_paths(spark, tmp_path):
    trees(tmp_path)
    got = layouts.read_layout(spark, str(tmp_path), SCHEMA)
    assert {(r.layout, r.kind, r.symbol, r.date): r.n for r in got.groupBy("layout", "kind", "symbol", "date").agg(F.count("*").alias("n")).collect()} == {
        ("raw", "trades", "A", "2024-01-01"): 40, ("raw", "trades", "B", "2024-01-02"): 40, ("preview", "book", "A", "2024-01-01"): 40, ("ready", "trades", "A", None): 2, ("ready", "trades", "Z", None): 1}
    assert sorted((r.ts_ms, r.price) for r in got.where("layout = 'ready' and ts_ms is not null").collect()) == [(5, 1.5), (7, None)]
    assert layouts.read_layout(spark, str(tmp_path), SCHEMA, "auto").select("layout").distinct().collect()[0].layout == "preview"
    assert got.where("layout = 'raw' and symbol = 'B' and ts_ms between 1015 and 1024").count() == 10
    assert layouts.read_layout(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_filters_prune_files_and_row_groups(tmp_path, spark):
    trees(tmp_path)
    from pyspark.sql.types import StructType

    r = layouts.LayoutReader(StructType.fromDDL(SCHEMA), str(tmp_path), ["raw"], 1 << 30)
    left = list(r.pushFilters([layouts.EqualTo(("symbol",), "B"), layouts.GreaterThanOrEqual(("ts_ms",), 1015), layouts.LessThan(("ts_ms",), 1025)]))
    parts = r.partitions()
    assert len(left) == 3 and [p.known["symbol"] for p in parts] == ["B"]
    assert sum(b.num_rows for b in r.read(parts[0])) == 20  # two of four row groups


def test_a_damaged_row_group_costs_itself(spark, tmp_path):
    trees(tmp_path)
    p = tmp_path / "raw/date=2024-01-01/hour=05/symbol=A/kind=trades/p.parquet"
    column = pq.ParquetFile(p).metadata.row_group(2).column(1)
    data = bytearray(p.read_bytes())
    at = column.data_page_offset
    data[at : at + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    p.write_bytes(bytes(data))
    bad = tmp_path / "raw/date=2024-01-02/hour=05/symbol=B/kind=trades/p.parquet"
    bad.write_bytes(bad.read_bytes()[:-20])
    got = layouts.read_layout(spark, str(tmp_path), SCHEMA, "raw")
    assert sorted(r.ts_ms for r in got.collect()) == [*range(20), *range(30, 40)]


def test_large_files_are_shared_by_row_group(spark, tmp_path):
    trees(tmp_path)
    assert layouts.read_layout(spark, str(tmp_path), SCHEMA, "raw").count() == 80
    r = spark.read.format("ticklattice_layouts").schema(SCHEMA).option("path", str(tmp_path)).option("layouts", "raw").option("part", 500).load()
    assert r.rdd.getNumPartitions() > 2 and r.count() == 80


def test_a_replayed_batch_adds_no_row(spark, tmp_path):
    calls = []

    def fragile(batch, number):
        calls.append(number)
        ledger.batch_folder(f"{tmp_path}/b", "json")(batch, number)
        if calls.count(number) == 1 and number == 1:
            raise RuntimeError("lost after it has written")

    each = ledger.fan_out({"a": ledger.batch_folder(f"{tmp_path}/a"), "b": fragile}, f"{tmp_path}/ledger")
    each(spark.range(5), 0)
    with pytest.raises(RuntimeError):
        each(spark.range(7), 1)
    each(spark.range(7), 1)  # Spark runs it again: sink a is done, b is not
    each(spark.range(7), 1)
    each(spark.range(5), 0)
    assert calls == [0, 1, 1] and spark.read.parquet(f"{tmp_path}/a").count() == spark.read.json(f"{tmp_path}/b").count() == 12


def test_stream_into_two_sinks_with_a_restart(spark, tmp_path):
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(ledger.fan_out({"x": ledger.batch_folder(f"{tmp_path}/x"), "y": ledger.batch_folder(f"{tmp_path}/y", "json")}, f"{tmp_path}/l")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/x").count() == spark.read.json(f"{tmp_path}/y").count() == 30


def test_counts_in_the_same_pass(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1, 1.0), ("A", 5, None), ("B", 5, 1.0), ("A", 9, 1.0), (None, None, 1.0)], "symbol string, ts_ms long, price double")
    out, seen = readers.counted(rows, "read", ["price", "absent"], ["A"], 2, 9)
    assert out.count() == 2
    assert seen.get == {"total": 5, "kept": 2, "expected": 0, "missing_price": 1, "missing_absent": 2, "first_ms": 5, "last_ms": 9}


@pytest.mark.parametrize("goals", [2, 3, 4])
def test_skyline_equals_all_pairs(spark, goals):
    rng = random.Random(goals)
    points = [tuple(float(rng.randrange(12)) for _ in range(goals)) for _ in range(700)] + [(-float(10**9),) + (20.0,) * (goals - 1)] * 2
    names = [f"g{i}" for i in range(goals)]
    df = spark.createDataFrame([(*p, i) for i, p in enumerate(points)] + [(None,) * goals + (-1,)], ", ".join(f"{n} double" for n in names) + ", id long")
    beats = lambda a, b: all(x >= y for x, y in zip(a, b, strict=True)) and a != b
    want = {i for i, p in enumerate(points) if not any(beats(q, p) for q in points)}
    assert {r.id for r in trials.front(df, names, []).collect()} == want
    down = df.withColumn(names[0], -F.col(names[0]))
    assert {r.id for r in L.pareto(down, names[1:], names[:1], "id").collect()} == want


def test_halving_by_hand(spark):
    rows = [(t, s, 2, float(v), 1.0, float(v)) for t, vs in {"a": (1, 9, 9), "b": (5, 0, 0), "c": (4, 4, 4), "d": (4, 1, 1)}.items() for s, v in enumerate(vs)] + [("e", 2, 1, 100.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "trial string, step int, trades long, net double, fee double, worst double")
    got = {(r.level, r.trial): r.score for r in trials.successive_halving(df, F.col("net"), ["net"], ["fee"], ["worst"], 1, 4, 2).collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 5.0, (1, "c"): 4.0, (1, "d"): 4.0, (1, "e"): None, (2, "b"): 5.0, (2, "c"): 8.0, (3, "c"): 12.0}
    assert trials.budgets(1, 60, 3) == [1, 3, 9, 27]
