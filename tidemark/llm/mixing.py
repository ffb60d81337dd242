"""Mixing sources to target weights by exponential keys and prefix sums, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD
from tidemark.session import stage

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words.
SHARE = 1.5
#: No source gives more than so many times its own words.
MOST = 2
#: Documents of a source in one range of keys, about: what is sorted in one place.
RANGE_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for a usual mean length of words (3 to 12 characters), a quarter otherwise."""
    letters = (F.length(text) - size).cast("double")
    return F.when(letters.between(3.0 * size, 12.0 * size) & (size > 0), 1.0).otherwise(0.25)


def exponential_key(doc_id: Column, weight: Column) -> Column:
    """-ln(u) / weight with u from the digest of the id, so that reruns agree; a null id counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from one row per source.

    Sources are weighted in code point order, null last. Shares above ``most`` times a source's size stop there and the excess
    is shared again by weight. That is a water level: sources are taken by their cap per unit of weight, and the first whose
    share of what is left stays under its cap sets the level for all after it.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    given = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", given.cast("double")).withColumn("cap", most * F.col("source_size").cast("double"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rising = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing))
    level = (share * F.sum(F.col("source_size").cast("double")).over(everything) - before) / left
    levels = caps.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    water = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return levels.withColumn("water", water).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE, most: int = MOST, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """All columns of ``docs`` and ``__size``, ``__source_size``, ``__target``, ``__taken`` (words the mix takes, repeats counted).

    Every source gives its complete epochs first, whole; what is left of its target is filled by Efraimidis-Spirakis sampling:
    documents in the order of exponential keys scaled by quality weight, up to the document whose middle word passes the budget.
    A hot source is never sorted in one place: words are summed by ranges of the key, and only the range in which the budget
    ends is sorted. Ties go by id, size and text. A null id counts as the empty text, a null source as a source of its own.
    Words of texts without any are 0 and nothing is taken of them.
    """
    size = word_count(F.col(text_col))
    keyed = docs.withColumn("__size", size).withColumn("__key", exponential_key(F.col(id_col), quality_weight(F.col(text_col), F.col("__size"))))
    slim = stage(keyed.select(F.col(source_col).alias("source"), "__size", "__key"), "sizes")
    ranges = max(1, -(-slim.count() // range_rows))
    bucket = F.least(F.floor((1 - F.exp(-F.col("__key"))) * ranges), F.lit(ranges - 1)).cast("long")
    histogram = stage(slim.groupBy("source", bucket.alias("bucket")).agg(F.sum("__size").alias("words")), "ranges")
    goal = targets(histogram.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    running = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
    ends = histogram.withColumn("until", running).withColumnRenamed("source", "of")
    edge = (
        ends.join(goal, ends["of"].eqNullSafe(goal["source"]))
        .groupBy("of").agg(
            F.coalesce(F.min(F.when(F.col("until") > F.col("rest"), F.col("bucket"))), F.lit(ranges)).alias("__edge"),
            F.coalesce(F.max(F.when(F.col("until") <= F.col("rest"), F.col("until"))), F.lit(0)).alias("__before"),
        ).withColumnRenamed("of", "__of_edge")
    )
    plan = goal.join(edge, goal["source"].eqNullSafe(edge["__of_edge"])).select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        F.col("epochs").alias("__epochs"), F.col("rest").alias("__rest"), "__edge", "__before",
    )
    plan = stage(plan, "plan")
    placed = keyed.withColumn("__bucket", bucket).join(plan, F.col(source_col).eqNullSafe(F.col("__source")))
    clear = placed.filter(F.col("__bucket") != F.col("__edge")).withColumn("__more", F.col("__bucket") < F.col("__edge"))
    order = W.partitionBy("__source").orderBy("__key", F.col(id_col).asc_nulls_first(), "__size", F.col(text_col).asc_nulls_first())
    until = F.col("__before") + F.sum("__size").over(order.rowsBetween(W.unboundedPreceding, 0))
    fringe = placed.filter(F.col("__bucket") == F.col("__edge")).withColumn("__more", 2 * until - F.col("__size") <= 2 * F.col("__rest"))
    taken = (F.col("__epochs") + F.col("__more").cast("long")) * F.col("__size")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return clear.unionByName(fringe).select(*names, "__size", "__source_size", "__target", taken.alias("__taken"))


#: The same for the registered query, in DuckDB's dialect: one running sum per source instead of ranges.
SQL = f"""WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
keyed AS (
  SELECT *, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5) / {float(1 << 48)})
            / CASE WHEN size > 0 AND length(text) - size BETWEEN 3 * size AND 12 * size THEN 1.0 ELSE 0.25 END AS key
  FROM sized),
sizes AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM keyed GROUP BY source),
weighted AS (
  SELECT *, [{", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)}][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1] AS weight,
         {MOST} * source_size AS cap FROM sizes),
levels AS (
  SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
goal AS (
  SELECT source, source_size, least(cap, coalesce(
    (SELECT level FROM levels WHERE level <= cap / weight ORDER BY cap / weight, level LIMIT 1) * weight, cap)) AS target FROM levels),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM goal),
ordered AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, g.epochs, g.rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size, k.text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS until
  FROM keyed k JOIN rests g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST((epochs + CAST(2 * until - size <= 2 * rest AS INTEGER)) * size AS BIGINT) AS taken FROM ordered"""
