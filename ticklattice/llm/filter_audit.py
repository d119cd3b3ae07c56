"""What filters remove, alone and in every order, exact duplicates among them.

Four filters look at a text alone, in Spark's own functions: too few words (A), too
many of them repeated (B), too many capitals (C), symbols (D). The fifth (E) is for
texts that a document with a smaller id has as well, found by refining a partition:
documents are split by length in code points, then by the hash of one block after the
other (blocks grow fourfold, so a text has few), and classes of one id are dropped
after each split. Rows without texts go through that. Only texts of the classes that
are left are read again and compared whole: they are grouped by the text itself, summed
within tasks before the shuffle, and each row is held against the smallest id of its
text. Hash collisions make more texts to compare, never a wrong mark.

Then documents are counted by part, failed filters and labels: 32 masks a part and
label, from which all orders of the filters follow. A large group of copies is one row a
task before any shuffle, or the many side of a join that Spark splits.

Null text counts as empty, and so equals empty ones; a null lang is the part of the
empty string. A row without an id is never E, nor does it make others so; rows with one
id are not duplicates of each other. A doc_id's labels hold for each of its rows (1 if
any of its labels is); without labels neither good nor toxic. No documents, no rows.
Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import drop, stored

FILTERS = "ABCDE"
#: Code points of the first block; block k ends at FIRST * GROWTH^k. The last block reaches to the end of any text.
FIRST, GROWTH, BLOCKS = 256, 4, 12
#: So many classes of copies (8 bytes each) are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_CLASSES = 2_000_000


def text_mask(text: Column) -> Column:
    """The failed filters among A to D: bit 0 is A."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [n < 100, distinct * 100 < n * 80, F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 10, text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def block_hashes(text: Column) -> Column:
    """Hashes of the text's blocks; texts of one length have as many."""
    ends = [0, *(FIRST * GROWTH**k for k in range(BLOCKS - 1)), 1 << 31]
    each = [F.when(F.length(text) > a, F.xxhash64(F.substring(text, a + 1, b - a))) for a, b in zip(ends, ends[1:], strict=False)]
    return F.array_compact(F.array(*each))


def class_key(length: Column, blocks: Column) -> Column:
    """What refine() ends with for a text: its length and its blocks' hashes, chained."""
    return F.aggregate(blocks, length.cast("long"), lambda key, x: F.xxhash64(key, x))


def refine(rows: DataFrame) -> DataFrame:
    """key: the classes of rows (doc_id, length, blocks) with two ids or more after all splits."""
    state = rows.where("doc_id is not null").select("doc_id", F.col("length").cast("long").alias("key"), "blocks")
    at, before, done = 0, [], None
    while True:
        classes = stored(state.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key"), "class_keys")
        left = stored(state.join(classes, "key", "left_semi"), "classes")  # of two tables, so that Spark can split a large class
        before += [left, classes]
        ended = left.where(F.size("blocks") <= at).select("key").distinct()
        done = ended if done is None else done.unionByName(ended)
        state = left.where(F.size("blocks") > at).select("doc_id", F.xxhash64("key", F.col("blocks")[at]).alias("key"), "blocks")
        if state.isEmpty():
            break
        at += 1
    out = stored(done, "keys")
    drop(*before)
    return out


def audited(docs: DataFrame, hashes=block_hashes) -> DataFrame:
    """doc_id, part and mask (bit i: fails the i-th of FILTERS) for each row of docs."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select("doc_id", F.coalesce(docs["lang"], F.lit("")).alias("part"), text.alias("text"))
    seen = stored(rows.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), F.length("text").alias("length"), hashes(F.col("text")).alias("blocks")), "masks")
    keys = refine(seen)
    small = F.broadcast(keys) if keys.count() <= BROADCAST_CLASSES else keys
    key = class_key(F.col("length"), F.col("blocks"))
    again = rows.withColumn("length", F.length("text")).withColumn("blocks", hashes(F.col("text"))).withColumn("key", key)
    some = stored(again.join(small, "key", "left_semi").select("doc_id", "part", "key", "text"), "copies")
    first = stored(some.groupBy("key", "text").agg(F.min("doc_id").alias("first")).where("first is not null"), "first")
    copies = some.join(first, ["key", "text"], "left").select("doc_id", "part", (text_mask(F.col("text")) + F.when(F.col("first") < F.col("doc_id"), 16).otherwise(0)).alias("mask"))
    alone = seen.withColumn("key", key).join(small, "key", "left_anti").select("doc_id", "part", "mask")
    return alone.unionByName(copies)


def audit(docs: DataFrame, labels: DataFrame, hashes=block_hashes) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    n = audited(docs, hashes).join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))
    n = n.select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))  # 32 rows a part
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    each = n.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    bit = lambda at: f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {at}, 1)) - 1)"
    each = each.withColumn("own", F.expr(bit("step")))
    earlier = F.expr(f"aggregate(filter(sequence(1, 5), i -> i < step), 0, (all, i) -> all | {bit('i')})")
    each = each.withColumn("earlier", F.col("mask").bitwiseAND(earlier) != 0)
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    here = fails & ~F.col("earlier")
    total = lambda when, c="n": F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    share = F.expr("n * (120 div greatest(1, bit_count(mask)))")  # a document goes to each of its filters in as many orders
    return each.groupBy("part", "filter_order", "step").agg(
        total(~F.col("earlier") & ~fails).alias("kept"), total(here).alias("removed"), total(fails & F.col("earlier")).alias("redundant"), total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"), F.coalesce(F.sum(F.when(fails, share)), F.lit(0)).cast("long").alias("shapley"),
    )


def op_query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)


#: The same rows in DuckDB's SQL, over views named documents and labels.
SQL = """
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as words, min(doc_id) over (partition by t) as lowest from d),
m as (select doc_id, part, (case when len(words) < 100 then 1 else 0 end) | (case when 100 * len(list_distinct(words)) < 80 * len(words) then 2 else 0 end)
        | (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 4 else 0 end) | (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
        | (case when lowest < doc_id then 16 else 0 end) as mask from w),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id),
n as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join l on l.doc_id = m.doc_id group by part, mask),
x as (select unnest(string_split('ABCDE', '')) as f),
o as (select a.f || b.f || c.f || d.f || e.f as o from x a, x b, x c, x d, x e where length(regexp_replace('ABCDE', '[' || a.f || b.f || c.f || d.f || e.f || ']', '', 'g')) = 0),
s as (select o, i as step, 1 << (instr('ABCDE', o[i]) - 1) as own, cast(coalesce(list_sum(list_transform(range(1, i), lambda j: 1 << (instr('ABCDE', o[j]) - 1))), 0) as bigint) as before
      from o, (select unnest(range(1, 6)) as i)),
j as (select part, o, step, n, good, toxic, own, mask, mask & own <> 0 as fails, mask & before <> 0 as gone from n, s)
select part, o as filter_order, cast(step as integer) as step, cast(sum(case when not gone and not fails then n else 0 end) as bigint) as kept,
       cast(sum(case when fails and not gone then n else 0 end) as bigint) as removed, cast(sum(case when fails and gone then n else 0 end) as bigint) as redundant,
       cast(sum(case when mask = own then n else 0 end) as bigint) as unique_fails, cast(sum(case when fails and not gone then good else 0 end) as bigint) as good_lost,
       cast(sum(case when fails and not gone then toxic else 0 end) as bigint) as toxic_lost, cast(sum(case when fails then n * (120 // bit_count(mask)) else 0 end) as bigint) as shapley
from j group by part, o, step
"""
