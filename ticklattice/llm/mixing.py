"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words. Each source's target is its share of a total by weight, but at most
`most` times its size; what that leaves over is shared again by weight. Documents of
a source are put in the order of a hash of their id; the mix takes all of them as
often as the target holds the source's size whole, then once more in that order
until the source's exact budget (the target without its fraction) is reached: the
last document is taken in part.

The order is made in buckets of the hash (of doc_id and size, so that rows without
an id or with one id spread too): words are summed by bucket before the shuffle,
prefix sums of buckets come from a window over one row per bucket, and only documents
of one bucket are sorted together, so a source with a third of all rows is spread
like the others. Null text has size 0, the null source is a source of its
own, equal doc_ids are ordered by size, and an empty table gives no rows. Other
columns are ignored by mix() and kept by mixed_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Leading hexadecimal digits of the hash that make a bucket: 4096 buckets of each source.
DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size -> also target. A row for each source.

    Sources reach their limit in the order of limit / weight. With the first k at
    their limits, the others get `level` times their weight; k is the smallest for
    which no other is above its limit (the level falls if more are put there, so it is the largest that fits).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    s = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", (F.col("source_size") * most).cast("double"))
    s = s.withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def _measured(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")))
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), *more)
    return rows.select("doc_id", "source", "size", key.alias("_key"), *more).withColumn("_bucket", F.substring("_key", 1, DIGITS))


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, *more: str) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the document), and the columns in `more`."""
    all_docs = _measured(docs, seed, *more)
    buckets = _measured(docs, seed).groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    goals = targets(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words")
    placed = placed.join(goals, placed["source"].eqNullSafe(goals["source"])).select(placed["source"].alias("_s"), placed["_bucket"].alias("_b"), "_before", "source_size", "target")
    rows = all_docs.join(placed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target")).cast("long") - whole * F.col("source_size")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - start))
    taken = (whole * F.col("size") + last).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *more)


def mixed_documents(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself, in the columns of docs: a document stands in it as often as it is taken; where it is taken in part,
    its text ends after the last word taken (the white space before it stays as it was), and n_chars, if docs has it, is that
    text's length. A text without words is kept once."""
    columns = docs.columns
    kept = docs.select(F.struct(*[docs[c] for c in columns]).alias("_row"), "doc_id", "source", "text")
    rows = mix(kept, seed, weights, share, most, "_row")
    times = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).cast("int")
    copies = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).where((times > 0))
    part = F.col("taken") - (F.col("_copy") - 1) * F.col("size")
    text = F.col("_row")["text"]
    pieces = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"))
    first = F.array_join(F.slice(pieces, 1, F.greatest(part, F.lit(0)).cast("int")), "")
    partly = (F.col("size") > 0) & (part < F.col("size"))
    own = {"text": F.when(partly, first).otherwise(text)}
    if "n_chars" in columns:
        own["n_chars"] = F.when(partly, F.length(first)).otherwise(F.col("_row")["n_chars"]).cast(dict(docs.dtypes)["n_chars"])
    return copies.select(*[own.get(c, F.col("_row")[c]).alias(c) for c in columns])


#: The same rows in DuckDB's SQL, over a view named documents.
SQL = """
with z as (
  select doc_id, source, cast(coalesce(length(regexp_replace(regexp_replace(text, '[^\\x20\\x09-\\x0D]+', 'w', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g')), 0) as bigint) as size
  from documents),
d as (select *, md5('0:' || coalesce(cast(doc_id as varchar), '') || ':' || cast(size as varchar)) as k from z),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, cast(case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as double) as weight,
             cast(source_size * 2 as double) as lim from s),
r as (select *, lim / weight as ratio, cast(sum(source_size) over () as double) * cast(1.5 as double) as total from w),
v as (select *, (total - coalesce(sum(lim) over (order by ratio, source asc nulls last rows between unbounded preceding and 1 preceding), 0.0))
             / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, source asc nulls last rows between unbounded preceding and 1 preceding), 0.0)) as lev from r),
g as (select source, source_size, least(lim, coalesce(max(case when lev <= ratio then lev end) over () * weight, lim)) as target from v),
p as (select d.doc_id, d.size, g.source_size, g.target,
             coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as start,
             case when g.source_size > 0 then cast(floor(g.target / g.source_size) as bigint) else 0 end as whole
      from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
       cast(whole * size + greatest(0, least(size, cast(floor(target) as bigint) - whole * source_size - start)) as bigint) as taken
from p
"""


def op_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs)
