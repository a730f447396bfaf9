"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame operations only. Water-filling knows sources as one row each: those whose share goes beyond
``epochs`` times their size are clamped there, and what is left is dealt to the others by weight, until none is
above. The driver sees three sums a round. All of it is in whole numbers, so reruns agree to the word.

A source takes every document a whole number of times, and of one more pass as many words as
are missing: documents in the order of a seeded hash up to a last one, of which it takes a part. That
last one is found like a quantile, by radix: words are summed by the first digits of the hash (partial sums first,
so a source of a third of all rows costs no task more than its share), and only rows of the digits that
hold the cut are looked at again, until so few are left that they can be put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialize, spare, table

WEIGHTS, EPOCHS, SEED = (1, 2, 3), 3, 17
#: Hexadecimal digits of the hash that one round of the search looks at, and rows that are put in order at once.
DIGITS, FEW_ROWS = 3, 4096
#: Digits of a row's place in the order: the hash of its id and text, then the row's own number, for repeated rows.
HASH_DIGITS, ROW_DIGITS = 32, 15


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _place(seed: int) -> Column:
    """Where a row comes in its source's order. Equal rows come one after the other."""
    text, doc_id = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "doc_id"))
    row = F.lower(F.lpad(F.hex(F.monotonically_increasing_id()), ROW_DIGITS, "0"))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), doc_id, F.lit(":"), text)), row)


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 by source, sorted in ranges; only the ranges' counts meet in one task."""
    dealt = sources.repartitionByRange("_s").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("_s")) - 1), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return dealt.join(starts, "part").withColumn("rank", F.col("start") + F.col("at")).drop("part", "at", "start")


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` to sources (``size``, whole ``weight`` above 0): shares of the sum of sizes by weight, at most epochs times the size.

    Each round raises the level (words for a weight of 1), so sources are only ever clamped, never let go.
    """
    if epochs < 1:
        raise ValueError("sources must be allowed once at least, or nothing can make up the total")
    cap, w = F.col("size") * epochs, F.col("weight")
    by_weight = sources.agg(F.sum("size"), F.sum("weight"), F.count("*")).first()
    total, weights, n = (int(x or 0) for x in by_weight)
    level, clamped = (total, max(weights, 1)), 0
    while True:
        full = cap * F.lit(level[1]).cast("decimal(38,0)") <= w * F.lit(level[0]).cast("decimal(38,0)")
        taken, left, count = (int(x or 0) for x in sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, w)), F.count_if(full)).first())
        if count == clamped or count == n:
            break
        level, clamped = (total - taken, left), count
    return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise((w * F.lit(level[0])).cast("double") / F.lit(float(level[1]))))


def _cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``_s, cut, cut_words``: the row at which each source has ``part`` words, and how many are its own. Sources without a part have none."""
    running = lambda by: F.sum("size").over(Window.partitionBy("_s").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    holds = (F.col("upto") - F.col("size") < F.col("rest")) & (F.col("rest") <= F.col("upto"))
    bound = goals.where("part > 0").select("_s", F.lit("").alias("prefix"), F.col("part").alias("rest"))
    depth = 0
    while True:
        depth += DIGITS
        sums = rows.groupBy("_s", F.substring("_place", 1, depth).alias("digits")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        bound = (
            sums.join(bound.drop("prefix"), "_s").withColumn("upto", running("digits")).where(holds)
            .select("_s", F.col("digits").alias("prefix"), (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"), "n")
        )
        bound = materialize(bound, "bound")
        rows = materialize(rows.join(bound.select("_s", "prefix"), "_s").where(F.substring("_place", 1, depth) == F.col("prefix")).drop("prefix"), "undecided")
        if (bound.agg(F.max("n")).first()[0] or 0) <= FEW_ROWS or depth >= HASH_DIGITS + ROW_DIGITS:
            break
    last = rows.join(bound.select("_s", "rest"), "_s").withColumn("upto", running("_place")).where(holds)
    return last.select("_s", F.col("_place").alias("cut"), (F.col("rest") - F.col("upto") + F.col("size")).alias("cut_words"))


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, carry: Sequence[str] | None = None
) -> DataFrame:
    """The columns ``carry`` of every row (all but text unless given) and ``_mix``: a struct of size, source_size, target, copies, part.

    A document is taken ``copies`` times whole and ``part`` words of it once more; size counts its words.

    * Sources in the order of their code points, null last, have the weights in turn. Null is a source.
    * Null and empty texts have size 0; they are taken as often as others of their source and add no word.
      A source of size 0 has target 0 and is not taken.
    * A source takes round(target) words. Repeated rows come one after the other in its order.
      Rows that share a doc_id are told apart by their texts; a null doc_id is passed on.
    * A text of any length is one document. Columns are passed on, but for one named _mix, which is replaced.
    * An empty table gives an empty result.
    """
    carry = [c for c in (carry if carry is not None else [c for c in docs.columns if c.lower() != "text"]) if c.lower() != "_mix"]
    names = spare(docs, *[f"c{k}" for k in range(len(carry))])  # own names cannot clash with those of the search
    rows = materialize(
        docs.select(
            F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)] or [F.lit(0)]).alias("_row"),
            F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("z")).alias("_s"),
            words_in(F.col("text").cast("string")).alias("size"), _place(seed).alias("_place"),
        ),
        "sized",
    )
    sources = _ranked(rows.groupBy("_s").agg(F.sum("size").alias("size")))
    turn = F.get(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    goals = water_fill(materialize(sources.select("_s", "size", turn.cast("long").alias("weight")), "weighted"), epochs)
    goal, size = F.round("target").cast("long"), F.col("source_size")
    goals = goals.withColumnRenamed("size", "source_size").withColumn("copies", F.when(size > 0, F.floor(goal / size)).otherwise(0).cast("long"))
    goals = materialize(goals.withColumn("part", goal - F.col("copies") * size).drop("weight"), "goals")
    plan = materialize(goals.drop("part").join(_cuts(rows.select("_s", "size", "_place"), goals), "_s", "left"), "plan")
    part = F.when(F.col("_place") < F.col("cut"), F.col("size")).when(F.col("_place") == F.col("cut"), F.col("cut_words")).otherwise(0)
    # Both sides are tables: a plan too large to be sent along is joined by shuffles that split a hot source.
    return rows.join(plan, "_s").select(
        *[F.col(f"_row.{n}").alias(c) for c, n in zip(carry, names, strict=True)],
        F.struct("size", "source_size", "target", "copies", part.cast("long").alias("part")).alias("_mix"),
    )


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time that a document is taken; of the last one its first words, put together by single spaces."""
    taken = mix(docs, carry=[c for c in docs.columns if c.lower() != "_mix"], **options)
    kept = [c for c in taken.columns if c != "_mix"]
    (nth,) = spare(taken, "_nth")
    first_words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), 1, F.col("_mix.part").cast("int")), " ")
    whole = taken.where("_mix.copies > 0").withColumn(nth, F.explode(F.sequence(F.lit(1), F.col("_mix.copies").cast("int")))).select(*kept)
    rest = taken.where("_mix.part > 0")
    cut = F.when(F.col("_mix.part") < F.col("_mix.size"), first_words).otherwise(F.col("text"))
    return whole.unionByName(rest.select(*[cut.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in kept]))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), carry=["doc_id"])
    taken = F.col("_mix.size") * F.col("_mix.copies") + F.col("_mix.part")
    return mixed.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", taken.alias("taken"), "_mix.copies", "_mix.part")


OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'z') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k FROM documents),
src AS (SELECT s, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS w FROM d GROUP BY s),
lv AS (
  SELECT *, (SELECT sum(n) FROM src)::BIGINT - coalesce(sum(3 * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS num,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS den, row_number() OVER o AS k FROM src
  WINDOW o AS (ORDER BY 3.0 * n / w, s)),
cutoff AS (SELECT num, den, k FROM lv WHERE 3 * n * den > w * num ORDER BY k LIMIT 1),
goal AS (
  SELECT s, n, CASE WHEN c.k IS NULL OR lv.k < c.k THEN CAST(3 * n AS DOUBLE) ELSE CAST(w * c.num AS DOUBLE) / CAST(c.den AS DOUBLE) END AS target
  FROM lv LEFT JOIN cutoff c ON true),
part AS (SELECT *, CASE WHEN n > 0 THEN CAST(round(target) AS BIGINT) // n ELSE 0 END AS copies FROM goal),
run AS (SELECT *, sum(size) OVER (PARTITION BY s ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM d),
cut AS (
  SELECT *, greatest(0, least(size, CAST(round(target) AS BIGINT) - copies * n - (upto - size)))::BIGINT AS p FROM run JOIN part USING (s))
SELECT doc_id, size, n AS source_size, target, (size * copies + p)::BIGINT AS taken, copies::BIGINT AS copies, p AS part FROM cut
"""
