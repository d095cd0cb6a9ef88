"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is put in a fixed random order (a hash of its id). The
virtual finish time of its copy in epoch ``e`` is the source's cumulative size up to
and including it (``e`` whole passes before it) divided by the source's target. The
copies of all sources, sorted by finish time, are the mix; it is cut where the running
size reaches the total budget.

Cumulative sizes come from two levels of hash buckets inside each source (bucket
totals, offsets, then a running sum inside one bucket), so that a source with a third
of all rows is spread over many tasks. The cut comes from two levels of buckets of
finish time in the same way. DataFrame functions only.

Defined results: a null text has size 0, a null source is a source of its own that
sorts last, equal rows are ordered by id, then by a hash of the text (rows equal in all
of these are interchangeable), a source of size 0 gets target 0 and nothing is taken, an empty table gives
an empty mix. Further columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, materialise, packed

FINE = 1 << 20  # buckets of finish time per unit of virtual time


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _base(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    key = F.coalesce(col(id_col).cast("string"), F.lit(""))
    h = F.md5(F.concat(F.lit(seed + ":"), key))
    b = packed(docs, id=col(id_col), size=word_count(col(text_col)), h=h,
               t=F.xxhash64(col(text_col)),
               # sources by code point, null last
               src=F.when(col(source_col).isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), col(source_col))))
    return b.withColumns({"l1": F.substring("h", 1, 3), "l2": F.substring("h", 4, 3)})


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """``totals`` (src, source_size) with the target of each source: ``share`` of all
    sizes split by weight, a target stopping at ``max_epochs`` times its source's size
    and the excess reshared by weight among the others. Sources are capped in order of
    size / weight, so one pass over the (few) sources finds the level."""
    by_name = Window.orderBy("src")
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    ws = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("w", F.element_at(ws, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    t = t.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("w").over(after))
    # the first source that stays under its cap sets the level of all after it
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    t = t.withColumn("level", F.first(fits, ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.col("level") * F.col("w"))
    return t.select("src", "source_size", target.alias("target"), F.col("budget").alias("budget"))


def _finish(epoch: Column) -> Column:
    return F.when(F.col("target") > 0, (epoch * F.col("source_size") + F.col("cum")) / F.col("target")).otherwise(0.0)


def mixing_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, max_epochs: int = 3,
                seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """One row per document: ``row`` (the input row), ``id``, ``size``, ``source_size``,
    ``target`` and ``finish``, the virtual finish times of the copies in the mix."""
    base = _base(docs, seed, id_col, text_col, source_col)
    small = materialise(base.drop("row"), "mix-sizes")
    fine = small.groupBy("src", "l1", "l2").agg(F.sum("size").alias("n"))
    coarse = fine.groupBy("src", "l1").agg(F.sum("n").alias("n"))
    targets = source_targets(coarse.groupBy("src").agg(F.sum("n").alias("source_size")), weights, share, max_epochs)
    up_to = (Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("o1", F.sum("n").over(Window.partitionBy("src").orderBy("l1").rowsBetween(*up_to)))
    coarse = coarse.drop("n").join(targets, "src")
    fine = fine.withColumn("o2", F.sum("n").over(Window.partitionBy("src", "l1").orderBy("l2").rowsBetween(*up_to)))
    offsets = fine.drop("n").join(coarse, ["src", "l1"]).withColumn(
        "offset", F.coalesce("o1", F.lit(0)) + F.coalesce("o2", F.lit(0))).drop("o1", "o2")
    offsets = materialise(offsets, "mix-offsets")

    def placed(rows: DataFrame) -> DataFrame:
        inside = Window.partitionBy("src", "l1", "l2").orderBy("h", "id", "t").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        out = rows.join(offsets, ["src", "l1", "l2"]).withColumn("cum", F.col("offset") + F.sum("size").over(inside))
        return out.withColumn("finish", F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), _finish))

    cut = _cut(placed(small))
    if cut is None:  # an empty table, or sizes of 0 only
        kept = F.slice("finish", 1, 0)
    else:
        at = {c: F.lit(cut[c]).cast(base.schema[c].dataType).alias(c) for c in ("src", "h", "id", "t")}
        within = F.struct(*at) <= F.struct(*at.values())
        kept = F.filter("finish", lambda f: (f < F.lit(cut["finish"])) | ((f == F.lit(cut["finish"])) & within))
    return placed(base).withColumn("finish", F.when(F.col("size") > 0, kept).otherwise(F.slice("finish", 1, 0)))


def _cut(items: DataFrame) -> dict | None:
    """The last copy of the mix in the order (finish, source, hash, id): the copy up to
    which the running size of all copies stays within the budget. Bucket totals in two
    levels lead to one bucket of finish time; only its copies are sorted.

    The copies that finish by time 1 fit, as each source is then within its target; with
    the first later copy of every source the budget is used up, so that the cut lies no
    later than the last of those."""
    items = items.where("size > 0").select("src", "h", "id", "t", "size", "budget", F.explode("finish").alias("finish"))
    late = items.where("finish > 1").groupBy("src").agg(F.min("finish").alias("f")).agg(F.max("f").alias("f"))
    latest = late.collect()[0]["f"]
    if latest is not None:
        items = items.where(F.col("finish") <= F.lit(latest))
    items = items.withColumn("b", F.floor(F.col("finish") * FINE).cast("long"))
    items = items.withColumns({"b1": F.floor(F.col("b") / 1024), "b2": F.col("b") % 1024})
    fine = items.groupBy("b1", "b2").agg(F.sum("size").alias("n"), F.max("budget").alias("budget"))
    coarse = fine.groupBy("b1").agg(F.sum("n").alias("n"), F.max("budget").alias("budget"))
    # only the coarse buckets from time 1 on are ordered in one window
    head = coarse.where("b1 < 1024").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("head")).collect()[0]["head"]
    order = Window.orderBy("b1").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = coarse.where("b1 >= 1023").withColumn("last", F.lit(head) - F.first("n").over(order) * (F.first("b1").over(order) < 1024).cast("int")
                                                       + F.sum("n").over(order) - F.col("n"))
    first = tail.where("last <= budget").orderBy(F.desc("b1")).limit(1).collect()
    if not first:
        return None
    spent, b1 = first[0]["last"], first[0]["b1"]
    inner = Window.orderBy("b2").rowsBetween(Window.unboundedPreceding, -1)
    parts = fine.where(F.col("b1") == b1).withColumn("last", F.lit(spent) + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    part = parts.where("last <= budget").orderBy(F.desc("b2")).limit(1).collect()[0]
    near = items.where((F.col("b1") == b1) & (F.col("b2") == part["b2"]))
    run = Window.orderBy("finish", "src", "h", "id", "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("g", F.lit(part["last"]) + F.sum("size").over(run)).where("g <= budget")
    last = near.orderBy(F.desc("g")).limit(1).collect()
    if last:
        return last[0].asDict()
    # no copy of that bucket fits any more: cut at its lower edge
    return {"finish": (b1 * 1024 + part["b2"]) / FINE, "src": "", "h": "", "id": None, "t": 0}


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the input's columns, a document once for each copy taken, in
    order of virtual finish time (range-partitioned and sorted)."""
    columns = docs.columns
    plan = mixing_plan(docs, **options)
    out = plan.select("row", "h", "src", F.explode("finish").alias("at"))
    out = out.repartitionByRange("at", "src", "h").sortWithinPartitions("at", "src", "h")
    return out.select(*[F.col("row").getField(c).alias(c) for c in columns])


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = mixing_plan(docs)
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                       (F.col("size") * F.size("finish")).cast("long").alias("taken"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY src) - 1 AS k FROM d GROUP BY src),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             source_size * 3.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s),
r AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
q AS (SELECT *, first_value(CASE WHEN lv * w <= cap THEN lv END IGNORE NULLS)
             OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM r),
t AS (SELECT src, source_size, budget, CASE WHEN level IS NULL THEN cap ELSE level * w END AS target FROM q),
c AS (SELECT d.*, t.source_size, t.target, t.budget,
             sum(size) OVER (PARTITION BY d.src ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
      FROM d JOIN t USING (src)),
i AS (SELECT doc_id, src, h, size, budget,
             CASE WHEN target > 0 THEN CAST(e * source_size + cum AS DOUBLE) / target ELSE 0 END AS finish
      FROM c, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
g AS (SELECT doc_id, budget, sum(size) OVER (ORDER BY finish, src, h, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM i),
n AS (SELECT doc_id, count(*) AS copies FROM g WHERE g <= budget GROUP BY doc_id)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(c.size * coalesce(n.copies, 0) AS BIGINT) AS taken
FROM c LEFT JOIN n USING (doc_id)
"""
