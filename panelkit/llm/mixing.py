"""Operator 1: mixing sources to target weights by weighted fair queueing.

Within a source the documents are shuffled (by a hash of their id) and laid
end to end, epoch after epoch, up to ``epochs`` times.  A document's virtual
finish time is the number of words of its source up to and with it, divided by
the source's weight.  In order of finish time, over all sources, the mix takes
documents until the budget is full.  A source that is used up leaves the rest
to the others, which is the same as sharing its excess by weight.

Running sums over a source, or over the whole order, are taken in two steps: a
bucket's sum, then the rows inside it.  Buckets hold a bounded number of rows:
a source has one for each ``BUCKET_ROWS`` of its documents (in hash order),
and a bucket that copies of one key fill is dealt on by row number.  The finish
times are cut so that each piece takes about ``BUCKET_WORDS`` words.  Only the
piece in which the budget ends is ordered row by row.

Rows carry a number, given when the table is stored: it tells copies apart, and
texts and their times meet by it, whatever the ids are.

Edge cases: a null or empty text has size 0 and is never taken; null sources
are a source, last in order; a null id is shuffled by its text; repeated rows
are documents of their own; without words every target is 0; an empty table
gives an empty result; further columns pass through in ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C
from .registry import register

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
BUCKET_ROWS = 2_000
BUCKET_WORDS = 1_000_000
#: The order has so many pieces at most; they grow with the budget beyond.
MOST_PIECES = 50_000
SEED = "mix"


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: Column | None = None, epochs: int = EPOCHS) -> DataFrame:
    """``sizes`` (source, n, source_size; one row per source) with weight,
    target and ``finish``: the time at which the budget is full, the least v
    with ``sum(min(weight * v, epochs * source_size)) = budget``.  If sources
    are used up in the order of ``full``, the time follows from those before and
    after each of them; a guess that holds a used-up source for open comes out
    too early, so the time is the latest guess that its source allows.  The
    default budget is all words.  Windows here run over one row per source."""
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    nth = F.row_number().over(order) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.get(cycle, F.pmod(nth, F.lit(len(weights)))))
    every = Window.partitionBy()
    s = (s.withColumn("budget", (budget if budget is not None else F.sum("source_size").over(every)).cast("double"))
         .withColumn("full", F.lit(float(epochs)) * F.col("source_size") / F.col("weight")))
    before = Window.orderBy("full", "source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("full", "source").rowsBetween(0, Window.unboundedFollowing)
    spent = F.coalesce(F.sum(F.lit(epochs) * F.col("source_size")).over(before), F.lit(0))
    s = s.withColumn("v", (F.col("budget") - spent) / F.sum("weight").over(after))
    s = s.withColumn("finish", F.coalesce(F.max(F.when(F.col("v") <= F.col("full"), F.col("v"))).over(every),
                                          F.max("full").over(every)))
    target = F.least(F.col("weight") * F.col("finish"), F.lit(float(epochs)) * F.col("source_size"))
    return s.withColumn("target", target).select("source", "n", "source_size", "weight", "budget", "finish", "target")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` stored with a number for each row."""
    return C.cut_lineage(docs.withColumn(name, F.monotonically_increasing_id()))


def taken_epochs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, row_col: str | None = None) -> DataFrame:
    """One row per document: row (its number: ``row_col``, or one given here),
    id, source, key (of the shuffle), size, source_size, target, weight, upto
    (words of its source up to and with it) and ``times``: how often the mix
    takes it."""
    text = C.text_or_empty(text_col)
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.md5(text))))
    rows = docs.select(F.col(row_col) if row_col else F.lit(None).cast("long").alias("row"), F.col(id_col).alias("id"),
                       F.col(source_col).alias("source"), key.alias("key"), C.word_count(text_col).alias("size"))
    rows = C.cut_lineage(rows.withColumnRenamed(row_col, "row")) if row_col else numbered(rows, "row")
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    targets = C.cut_lineage(source_targets(sizes, weights, epochs=epochs).withColumn(
        "sid", F.row_number().over(Window.orderBy("source"))))

    # a source's running sum: buckets of its hash order, then the rows of a bucket
    small = targets.select(F.col("source").alias("_s"), "n", "sid")
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    pieces = F.ceil(F.col("n") / F.lit(BUCKET_ROWS))
    at = rows.join(small, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    at = at.withColumn("bucket", F.floor(share * pieces)).drop("n")
    held = at.groupBy("sid", "bucket").agg(F.count("*").alias("_n"))
    full = held.where(F.col("_n") > 4 * BUCKET_ROWS).withColumn("parts", F.ceil(F.col("_n") / F.lit(BUCKET_ROWS))).drop("_n")
    at = at.join(full, ["sid", "bucket"], "left").withColumn(
        "part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))).drop("parts")
    sums = at.groupBy("sid", "bucket", "part").agg(F.sum("size").alias("in_part"))
    run = Window.partitionBy("sid").orderBy("bucket", "part")
    sums = sums.withColumn("before", F.sum("in_part").over(run) - F.col("in_part")).drop("in_part")
    inside = (Window.partitionBy("sid", "bucket", "part").orderBy("key", "id", "size", "row")
              .rowsBetween(Window.unboundedPreceding, 0))
    lined = (at.join(sums, ["sid", "bucket", "part"]).withColumn("upto", F.col("before") + F.sum("size").over(inside))
             .drop("before", "bucket", "part")
             .join(targets.drop("n", "source", "budget", "finish"), "sid"))
    lined = C.cut_lineage(lined)

    # the order of all sources: finish times of every epoch that can come in
    epoch = F.explode(F.sequence(F.lit(1), F.lit(epochs)))
    slot = (lined.where("size > 0").withColumn("epoch", epoch)
            .withColumn("time", (F.col("upto") + (F.col("epoch") - 1) * F.col("source_size")) / F.col("weight")))
    budget, rate = targets.agg(F.sum("source_size"), F.sum("weight")).first()  # two numbers
    budget = budget or 0
    width = max(BUCKET_WORDS, budget / MOST_PIECES)
    slot = slot.withColumn("piece", F.floor(F.col("time") * F.lit(rate or 1.0) / F.lit(float(width))))
    filled = slot.groupBy("piece").agg(F.sum("size").alias("in_piece"))
    filled = filled.withColumn("upto_piece", F.sum("in_piece").over(Window.orderBy("piece")))
    # the first piece that goes over the budget (none: all is taken)
    edge, spent = filled.where(F.col("upto_piece") > F.lit(budget)).agg(
        F.min("piece"), F.min_by(F.col("upto_piece") - F.col("in_piece"), "piece")).first()
    early = slot if edge is None else slot.where(F.col("piece") < F.lit(edge))
    last = slot.where(F.lit(False) if edge is None else F.col("piece") == F.lit(edge))
    order = Window.partitionBy("piece").orderBy("time", "sid", "epoch", "key", "id", "size", "row").rowsBetween(
        Window.unboundedPreceding, 0)
    last = last.withColumn("sum", F.sum("size").over(order)).where(F.lit(spent or 0) + F.col("sum") <= F.lit(budget))
    times = early.select("row").unionByName(last.select("row")).groupBy("row").agg(F.count("*").alias("times"))
    return lined.join(times, "row", "left").select(
        "row", "id", "source", "key", "size", "source_size", "target", "weight", "upto",
        F.coalesce("times", F.lit(0)).cast("int").alias("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, in
    order of finish time (range-partitioned)."""
    free = lambda x: x if x not in docs.columns else free(x + "_")
    row, time, key = (free(x) for x in ("_row", "_time", "_key"))
    stored = numbered(docs, row)
    plan = taken_epochs(stored, id_col, text_col, source_col, row_col=row, **kw).where("times > 0")
    finish = F.transform(F.sequence(F.lit(0), F.col("times") - 1),
                         lambda e: (F.col("upto") + e * F.col("source_size")) / F.col("weight"))
    plan = plan.select(F.col("row").alias(row), finish.alias(time), F.col("key").alias(key))
    taken = stored.join(plan, row).withColumn(time, F.explode(time))
    return taken.repartitionByRange(F.col(time), F.col(key), F.col(row)).sortWithinPartitions(time, key, row).select(*docs.columns)


_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
  w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3] AS DOUBLE) AS weight,
    sum(source_size) OVER () AS budget FROM s),
  -- rounds of resharing: who gets more than three times its size stops there, the rest share again by weight
  r AS (SELECT 0 AS turn, source, source_size, weight, budget, false AS stopped FROM w
    UNION ALL
    SELECT turn + 1, source, source_size, weight, budget, stopped OR weight * rest / nullif(open, 0) > 3 * source_size
    FROM (SELECT *, budget - sum(CASE WHEN stopped THEN 3 * source_size ELSE 0 END) OVER () AS rest,
      sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () AS open FROM r)
    WHERE turn < (SELECT count(*) FROM w)),
  v AS (SELECT *, budget - sum(CASE WHEN stopped THEN 3 * source_size ELSE 0 END) OVER () AS rest,
      sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () AS open FROM r WHERE turn = (SELECT max(turn) FROM r)),
  t AS (SELECT *, CASE WHEN stopped THEN 3.0 * source_size ELSE weight * rest / open END AS target,
      row_number() OVER (ORDER BY source NULLS FIRST) AS sid FROM v),
  l AS (SELECT d.*, t.source_size, t.weight, t.sid, t.budget, t.target,
      sum(d.size) OVER (PARTITION BY t.sid ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
  e AS (SELECT l.*, k AS epoch, (upto + (k - 1) * source_size) / weight AS time FROM l, range(1, 4) r(k) WHERE size > 0),
  o AS (SELECT *, sum(size) OVER (ORDER BY time, sid, epoch, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM e),
  n AS (SELECT doc_id, count(*) AS times FROM o WHERE total <= budget GROUP BY doc_id)
SELECT l.doc_id, l.size, l.source_size, round(l.target, 3) AS target, CAST(coalesce(n.times, 0) * l.size AS BIGINT) AS taken
FROM l LEFT JOIN n ON l.doc_id = n.doc_id"""


@register("op1_weighted_mix", _SQL)
def op1_weighted_mix(spark, sf_dir):
    rows = taken_epochs(C.table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 3).alias("target"),
                       (F.col("times") * F.col("size")).cast("long").alias("taken"))
