"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame and SQL functions; one pass over the texts for their sizes, and sums per source after that.

* Targets share the size of all documents by weight. A source's target stops at three times its size; the
  excess goes to the others by weight until none is above. In order of size over weight, the sources at their
  limit come first, so running sums find the water level without repeating the sharing.
* A target of 1.7 times a source takes every document once, and 0.7 of the source a second time: documents in
  the order of a seeded hash until the sum comes nearest the target. The sum runs over hash ranges of a source, as many
  as the square root of all rows, then within the one where it ends, so no task sees a whole source in order. Of rows with
  the same id and text as many are taken as come nearest, counted per partition first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchkeeper.llm.text import prepare
from batchkeeper.session import materialize

# fixed value: words are runs of characters other than space and \t \n \v \f \r
WORD = r"[^\x20\x09-\x0D]+"
EPOCHS = 3
SEED = "mix-1"
#: Columns that :func:`mix` adds, and those it works with.
KEPT = ("source_size", "target", "repetitions", "taken")
OWN = (
    *KEPT, "weight", "whole", "again", "mix_source", "mix_cut", "mix_copies", "mix_wanted", "mix_row", "mix_last_source", "mix_last_row",
)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """``docs`` with ``mix_size`` (words) and ``mix_key`` (seeded hash of id and text). Columns of these names give way."""
    prepare(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return docs.withColumns({"mix_size": size, "mix_key": F.md5(name)})


def targets(sized: DataFrame, source_col: str = "source") -> DataFrame:
    """Per source: ``source_size``, its weight (1, 2, 3, repeating in code point order, null last) and its target."""
    sums = sized.groupBy(F.col(source_col).alias("mix_source")).agg(F.sum("mix_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last()))
    sums = sums.withColumn("place", place).withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("long"))
    sums = sums.withColumn("limit", EPOCHS * F.col("source_size"))
    order = Window.orderBy((F.col("limit") * 6 / F.col("weight")).cast("long"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    sums = sums.withColumn("left", left).withColumn("share", F.sum("weight").over(rest))

    def exact(c: str) -> Column:
        return F.col(c).cast("decimal(19,0)")

    full = exact("left") * exact("weight") > exact("limit") * exact("share")
    sums = sums.withColumn("full", full)
    # the water level is set at the first source that is not full
    level = [F.max(F.when(~F.col("full"), F.col(c))).over(whole).alias(c) for c in ("left", "share")]
    sums = sums.select("mix_source", "source_size", "weight", "limit", "full", *level)
    shared = F.col("left").cast("double") * F.col("weight") / F.col("share")
    return sums.select(
        "mix_source", "source_size", "weight",
        F.when(F.col("full"), F.col("limit").cast("double")).otherwise(shared).alias("target"),
    )


def _same_source(left: str, right: str) -> Column:
    return F.col(f"{left}.mix_source").eqNullSafe(F.col(f"{right}.mix_source"))


def repetitions(sized: DataFrame, source_col: str = "source") -> DataFrame:
    """Per source: how often every document is taken, and up to which key once more (none: null).

    Of the ``mix_copies`` rows with that last key, ``mix_wanted`` are taken once more.
    """
    rows = sized.select(F.col(source_col).alias("mix_source"), "mix_key", "mix_size")
    rows = materialize(rows, "sizes")  # narrow: the texts are not read again for it
    goals = targets(rows, "mix_source")
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    goals = goals.withColumn("whole", whole)
    goals = materialize(goals.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    rows = rows.where("mix_size > 0").withColumn("range", F.substring("mix_key", 1, range_digits(rows.count())))

    ranges = rows.groupBy("mix_source", "range").agg(F.sum("mix_size").alias("size"))
    upto = Window.partitionBy("mix_source").orderBy("range")
    ranges = ranges.withColumn("sum", F.sum("size").over(upto))
    ranges = ranges.alias("r").join(goals.alias("g"), _same_source("r", "g")).where("sum > extra and sum - size <= extra")
    ends = materialize(ranges.select("r.mix_source", "range", "extra", (F.col("sum") - F.col("size")).alias("before")), "ends")

    # the key where the sum goes beyond what is wanted; rows of one key have the same text, so the same size
    inside = rows.alias("d").join(ends.alias("e"), _same_source("d", "e") & (F.col("d.range") == F.col("e.range")))
    inside = inside.groupBy("d.mix_source", "mix_key", "before", "extra").agg(
        F.sum("mix_size").alias("size"), F.max("mix_size").alias("each"), F.count(F.lit(1)).alias("copies")
    )
    by_key = Window.partitionBy("mix_source").orderBy("mix_key")
    inside = inside.withColumn("sum", F.col("before") + F.sum("size").over(by_key)).where("sum > extra and sum - size <= extra")
    wanted = F.floor((F.col("extra") - F.col("sum") + F.col("size")) / F.col("each") + 0.5).cast("long")
    cuts = inside.select("mix_source", F.col("mix_key").alias("mix_cut"), F.col("copies").alias("mix_copies"), wanted.alias("mix_wanted"))
    out = goals.alias("g").join(cuts.alias("c"), _same_source("g", "c"), "left")
    return out.select("g.mix_source", "source_size", "weight", "target", "whole", "mix_cut", "mix_copies", "mix_wanted")


def _some_of_each(torn: DataFrame) -> DataFrame:
    """``torn`` with ``again`` for as many rows of a source as its ``mix_wanted``: rows alike in id and text, any will do.

    They are written with numbers first, as those of a second run may differ. The upper bits of a number are its
    partition's: counts per partition tell the one where the last row lies, and only its rows are put in order.
    """
    torn = materialize(torn.withColumn("mix_row", F.monotonically_increasing_id()), "torn")
    equal = torn.select("mix_source", "mix_wanted", "mix_row", F.shiftright("mix_row", 33).alias("part"))
    parts = equal.groupBy("mix_source", "mix_wanted", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("mix_source").orderBy("part"))
    parts = parts.withColumn("upto", upto).where("upto >= mix_wanted and upto - n < mix_wanted")
    parts = parts.select("mix_source", "part", (F.col("mix_wanted") - F.col("upto") + F.col("n")).alias("nth"))
    one = equal.alias("d").join(parts.alias("p"), _same_source("d", "p") & (F.col("d.part") == F.col("p.part")))
    place = F.row_number().over(Window.partitionBy("d.mix_source").orderBy("mix_row"))
    last = one.select("d.mix_source", "nth", "mix_row", place.alias("place")).where("place = nth")
    last = last.select(F.col("mix_source").alias("mix_last_source"), F.col("mix_row").alias("mix_last_row"))
    rows = torn.join(last, torn["mix_source"].eqNullSafe(last["mix_last_source"]))
    return rows.withColumn("again", F.col("mix_row") <= F.col("mix_last_row")).drop("mix_row", "mix_last_source", "mix_last_row")


def range_digits(n: int) -> int:
    """Hexadecimal digits of the ranges: about as many ranges as rows in one, and 4,096 at least."""
    return max(3, math.ceil(math.log(max(n, 1), 16) / 2))


def mix(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """What :func:`measured` gave, with ``source_size``, ``target``, ``repetitions`` and ``taken`` (words).

    Columns of ``docs`` that bear one of these names, or are called ``weight``, ``whole``, ``again``, ``mix_source``, ``mix_cut`` or
    another name in ``OWN``, give way to the new ones. Null texts have no words, very long ones all of theirs; null is a source of
    its own, the last. Sources without words have the target 0. Rows that share an id are drawn one by one, by their texts; of rows
    that share both, any are. An empty table gives none.
    """
    plan = materialize(repetitions(docs, source_col), "mix")
    docs = docs.drop(*[c for c in OWN if c != source_col])
    rows = docs.join(plan, docs[source_col].eqNullSafe(plan["mix_source"]), "left")
    at_cut = F.coalesce(F.col("mix_key") == F.col("mix_cut"), F.lit(False))
    up_to_cut = F.coalesce(F.col("mix_key") < F.col("mix_cut"), F.lit(False)) | (at_cut & (F.col("mix_wanted") > 0))
    torn = F.expr("mix_wanted > 0 and mix_wanted < mix_copies")
    if plan.where(torn).isEmpty():
        rows = rows.withColumn("again", up_to_cut)
    else:
        torn = at_cut & F.coalesce(torn, F.lit(False))
        rows = rows.where(~torn).withColumn("again", up_to_cut).unionByName(_some_of_each(rows.where(torn)))
    rows = rows.withColumn("repetitions", F.col("whole") + F.col("again").cast("long"))
    rows = rows.withColumn("taken", F.col("mix_size") * F.col("repetitions"))
    return rows.drop(*[c for c in OWN if c not in KEPT and c != source_col])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight,
             row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
o AS (SELECT *, (sum(source_size) OVER ()
                 - coalesce(sum(3 * source_size) OVER (ORDER BY source_size * 18 // weight, place
                                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT AS l,
             (sum(weight) OVER (ORDER BY source_size * 18 // weight, place
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS h FROM w),
f AS (SELECT *, l * weight > 3 * source_size * h AS full_up FROM o),
t AS (SELECT source, source_size,
             CASE WHEN full_up THEN (3 * source_size)::DOUBLE
                  ELSE (max(l) FILTER (NOT full_up) OVER ())::DOUBLE * weight / (max(h) FILTER (NOT full_up) OVER ())
             END AS target FROM f),
g AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM t),
b AS (SELECT d.doc_id, d.size, d.k, g.source, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS extra,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.k) AS own,
             row_number() OVER (PARTITION BY d.source, d.k) AS place
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN size = 0 OR upto <= extra THEN 1
                     WHEN place <= floor((extra - upto + own) / size + 0.5) THEN 1 ELSE 0 END AS again FROM b)
SELECT doc_id, size, source_size, target, size * (whole + again)::BIGINT AS taken FROM e
"""
