"""Mixing sources to target weights by capped water-filling.

Each source asks for its weight's share of a total. No source may give more than
``CAP`` times what it holds; what a full source cannot give is shared among the
others by weight until none is above its cap. In closed form: a source's target
is ``min(CAP * size, level * weight)`` with the one level that makes the targets
sum to the total, found from running sums over the sources in the order in which
they fill up.

A source's documents are then repeated ``floor(target / size)`` times, and a
seeded choice of them once more: in the order of a hash, as many as fit into what
is left of the target, and of the others the one whose size comes nearest to the
words still missing. The running sums over a source's documents are taken per
hash bucket; only the one bucket where the choice ends is ordered by document, so
a source may hold any share of the rows.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; a source of size 0 has target 0 and its documents are not taken;
repeated rows of one id are ordered by size and are otherwise alike; an empty table
gives an empty mix. Everything is built-in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsight.llm.common import seeded_hash, whole_text, words_of
from shopsight.session import materialize

#: Times that a document may be taken.
CAP = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
#: Hash buckets of a source are the leading bits of the 60-bit hash.
HASH_BITS, BUCKET_BITS = 60, 12


def with_size(df: DataFrame, text: str = "text", out: str = "size") -> DataFrame:
    """Add the number of words of the text."""
    return df.withColumn(out, F.size(words_of(whole_text(text))).cast("long"))


def source_targets(sized: DataFrame, share: float = 1.0) -> DataFrame:
    """One row per source: source, source_size, weight and target (words to take, double).

    ``sized`` has the columns source and size. The windows run over one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS)))
    weighted = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), turn + 1).cast("long"))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    exact = lambda c: c.cast("decimal(28,0)")
    total, weights = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    wanted = total if share == 1.0 else F.floor(total * share)
    left_words = wanted - CAP * F.coalesce(F.sum("source_size").over(fill), F.lit(0))
    left_weight = weights - F.coalesce(F.sum("weight").over(fill), F.lit(0))
    full = exact(CAP * F.col("source_size")) * exact(F.col("__left_weight")) < exact(F.col("__left_words")) * exact(F.col("weight"))
    filled = weighted.withColumns({"__left_words": left_words, "__left_weight": left_weight, "__wanted": wanted, "__weights": weights}).withColumn("__full", full)
    of_full = lambda c: F.sum(F.when(F.col("__full"), F.col(c)).otherwise(0)).over(everything)
    level = F.try_divide((F.col("__wanted") - CAP * of_full("source_size")).cast("double"), (F.col("__weights") - of_full("weight")).cast("double"))
    target = F.when(F.col("__full"), (CAP * F.col("source_size")).cast("double")).otherwise(F.coalesce(level * F.col("weight"), F.lit(0.0)))
    return filled.withColumn("target", target).select("source", "source_size", "weight", "target")


def _bucket() -> Column:
    return F.shiftright("__h", HASH_BITS - BUCKET_BITS)


def hashed(sized: DataFrame) -> DataFrame:
    return sized.withColumn("__h", seeded_hash(SEED, F.col("doc_id"))).withColumn("__b", _bucket())


def _fits_in_edge() -> Column:
    """Of rows in the edge bucket: whether all up to this one fit."""
    order = Window.partitionBy("source", "__b").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.coalesce((F.col("__b") == F.col("__edge")) & (F.col("__edge_before") + F.sum("size").over(order) <= F.col("__want")), F.lit(False))


def _joined(rows: DataFrame, plans: DataFrame) -> DataFrame:
    p = plans.withColumnRenamed("source", "__s").drop("weight")
    return rows.join(p, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")


def plan(narrow: DataFrame, targets: DataFrame) -> DataFrame:
    """How to take each source, a row each (``narrow`` is stored and has the columns of :func:`hashed`).

    source_size, target, ``__whole`` repetitions of all; ``__want`` words more:
    the buckets before ``__edge``, what fits of that bucket, and the document
    ``__fill``.
    """
    rate = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    plans = targets.withColumn("__whole", rate).withColumn("__want", F.col("target") - (F.col("__whole") * F.col("source_size")).cast("double"))
    plans = materialize(plans)
    sums = materialize(narrow.groupBy("source", "__b").agg(F.sum("size").alias("__words")))
    run = Window.partitionBy("source").orderBy("__b")
    sums = sums.withColumn("__after", F.sum("__words").over(run)).withColumn("__before", F.col("__after") - F.col("__words"))
    edges = (
        sums.join(plans.select(F.col("source").alias("__s"), "__want"), F.col("source").eqNullSafe(F.col("__s")))
        .where((F.col("__before") <= F.col("__want")) & (F.col("__want") < F.col("__after")))
        .select(F.col("__s").alias("__e"), F.col("__b").alias("__edge"), F.col("__before").alias("__edge_before"))
    )
    plans = materialize(plans.join(edges, F.col("source").eqNullSafe(F.col("__e")), "left").drop("__e"))

    left = F.col("__want") - F.col("__edge_before")
    edge_rows = _joined(narrow, plans).where(F.col("__b") == F.col("__edge")).withColumn("__fits", _fits_in_edge())
    filled = edge_rows.groupBy(F.col("source").alias("__s")).agg(F.max(left).alias("__left"), F.sum(F.when(F.col("__fits"), F.col("size")).otherwise(0)).alias("__used"))
    missing = materialize(filled.select(F.col("__s").alias("source"), (F.col("__left") - F.col("__used")).alias("__missing")))
    plans_missing = plans.join(missing.withColumnRenamed("source", "__e"), F.col("source").eqNullSafe(F.col("__e")), "left").drop("__e")
    later = _joined(narrow, plans_missing).where(F.col("__b") > F.col("__edge"))
    unfit = _joined(edge_rows.where(~F.col("__fits")).select(*narrow.columns), plans_missing)
    off = F.abs(F.col("size") - F.col("__missing"))
    nearest = later.unionByName(unfit).where(off < F.col("__missing")).groupBy(F.col("source").alias("__e"))
    fills = nearest.agg(F.min(F.struct(off.alias("off"), F.col("__h").alias("h"), F.col("doc_id").alias("id"), F.col("size").alias("size"))).alias("__fill"))
    return materialize(plans.join(fills, F.col("source").eqNullSafe(F.col("__e")), "left").drop("__e"))


def with_repeats(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Add source_size, target and ``repeats`` (how often the row is taken) to rows of :func:`hashed`."""
    fill = (F.col("__h") == F.col("__fill.h")) & F.col("doc_id").eqNullSafe(F.col("__fill.id")) & (F.col("size") == F.col("__fill.size"))
    joined = _joined(rows, plans).withColumn("__is_fill", F.coalesce(fill, F.lit(False)))
    looked_at = F.coalesce(F.col("__b") == F.col("__edge"), F.lit(False)) | F.col("__is_fill")
    clear = joined.where(~looked_at).withColumn("__more", F.coalesce(F.col("__b") < F.col("__edge"), F.lit(False)))
    split = joined.where(looked_at).withColumn("__more", _fits_in_edge())
    # of equal rows that could fill, one does
    spare = F.col("__is_fill") & ~F.col("__more")
    first = F.row_number().over(Window.partitionBy("source", spare).orderBy("__h", "doc_id", "size")) == 1
    split = split.withColumn("__more", F.col("__more") | (spare & first))
    return (
        clear.unionByName(split)
        .withColumn("repeats", F.col("__whole") + F.col("__more").cast("long"))
        .drop("__h", "__b", "__whole", "__want", "__edge", "__edge_before", "__fill", "__is_fill", "__more")
    )


def mix_report(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) of every document."""
    narrow = materialize(hashed(with_size(documents.select("doc_id", "source", "text")).drop("text")))
    rows = with_repeats(narrow, plan(narrow, source_targets(narrow)))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(documents: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns."""
    narrow = materialize(hashed(with_size(documents.select("doc_id", "source", "text")).drop("text")))
    rows = with_repeats(hashed(with_size(documents, out="size")), plan(narrow, source_targets(narrow)))
    copies = rows.where(F.col("repeats") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return copies.select(*documents.columns)


REPORT_SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 15) AS BIGINT) AS h
    FROM documents
),
sums AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
    FROM sized GROUP BY source
),
filling AS (
    SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
           coalesce(sum(source_size) OVER f, 0) AS s_before, coalesce(sum(weight) OVER f, 0) AS w_before
    FROM sums
    WINDOW f AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
clamped AS (
    SELECT *, {CAP} * source_size * (weights - w_before) < (total - {CAP} * s_before) * weight AS is_full FROM filling
),
leveled AS (
    SELECT *, CAST(total - {CAP} * sum(CASE WHEN is_full THEN source_size ELSE 0 END) OVER () AS DOUBLE)
              / CAST(weights - sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER () AS DOUBLE) AS water
    FROM clamped
),
targets AS (
    SELECT source, source_size, CASE WHEN is_full THEN CAST({CAP} * source_size AS DOUBLE) ELSE coalesce(water * weight, 0) END AS target
    FROM leveled
),
plans AS (
    SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM targets
),
placed AS (
    SELECT s.*, p.source_size, p.target, p.whole, p.target - CAST(p.whole * p.source_size AS DOUBLE) AS want,
           sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
    FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source
),
lacking AS (
    SELECT *, want - max(CASE WHEN so_far <= want THEN so_far ELSE 0 END) OVER (PARTITION BY source) AS missing FROM placed
),
filling_up AS (
    SELECT *, row_number() OVER (
               PARTITION BY source, so_far > want AND abs(size - missing) < missing
               ORDER BY abs(size - missing), h, doc_id NULLS FIRST, size) = 1
           AND so_far > want AND abs(size - missing) < missing AS fills
    FROM lacking
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN so_far <= want OR fills THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM filling_up
"""
