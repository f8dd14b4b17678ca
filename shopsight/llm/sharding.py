"""Extendible hashing: shards of bounded size, addressed by hash-prefix bits.

All rows begin in one bucket. A bucket whose rows exceed the byte limit splits on
the next bit of their hash; the others stay. The shards are the leaves, each
named by its prefix bits; the directory maps every prefix of the greatest depth
to its leaf.

Rows are summed per prefix before anything moves: a round counts the cells
``ROUND_BITS`` deeper than the buckets still open, sums them up to every depth
between, and settles each cell whose ancestors reach the limit; only rows of
cells that stay oversized enter the next round. Cells of the later rounds are about
as many as the rows, and their stored columns compress to a small part of what a
hash table of them takes, so their joins are sorted ones whatever size Spark
estimates: the driver holds no table. Rows with equal hashes cannot be
told apart by bits: a shard at the full depth may exceed the limit, and is marked.

Defined cases: a null text has no bytes; a null id hashes as a value of its own;
repeated rows share a shard; an empty table has no shards. Everything is built-in
column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.llm.common import seeded_hash, whole_text
from shopsight.session import materialize

HASH_BITS = 60
ROUND_BITS = 10
SEED = "shard-1"
#: Bytes of text a shard may hold: here 1 MB, on a cluster a file's size.
LIMIT = 1_000_000


def _prefix(depth: Column | int) -> Column:
    bits = F.lit(HASH_BITS) - (F.lit(depth) if isinstance(depth, int) else depth)
    return F.call_function("shiftright", F.col("h"), bits.cast("int"))


def shards(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add shard (prefix bits as text), depth, shard_rows, shard_bytes and over_limit to rows with the columns ``h`` and ``n_bytes``.

    ``rows`` is stored: it is read once a round.
    """
    spark = rows.sparkSession
    columns = rows.columns
    open_rows, settled, top = rows, None, 0
    while True:
        deep = min(top + ROUND_BITS, HASH_BITS)
        cells = open_rows.groupBy(_prefix(deep).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        cells = materialize(cells)
        depths = cells.withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(deep)))).withColumn(
            "prefix", F.call_function("shiftright", F.col("cell"), (F.lit(deep) - F.col("depth")).cast("int"))
        )
        sums = depths.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        fitting = sums.where((F.col("shard_bytes") <= limit) | (F.col("depth") == HASH_BITS))
        leaves = depths.select("cell", "depth", "prefix").join(fitting.hint("merge"), ["depth", "prefix"]).groupBy("cell")
        leaves = materialize(leaves.agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("leaf")))
        here = open_rows.withColumn("cell", _prefix(deep)).join(leaves.hint("merge"), "cell", "left")
        done = here.where(F.col("leaf").isNotNull()).select(*columns, "leaf.*")
        settled = done if settled is None else settled.unionByName(done)
        rest = here.where(F.col("leaf").isNull()).select(*columns)
        if deep == HASH_BITS or cells.join(leaves.hint("merge"), "cell", "left_anti").isEmpty():
            break
        open_rows, top = materialize(rest), deep
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    named = settled.withColumn("shard", bits).withColumn("over_limit", F.col("shard_bytes") > limit)
    return named.select(*columns, "shard", "depth", "shard_rows", "shard_bytes", "over_limit")


def directory(sharded: DataFrame) -> DataFrame:
    """One row per shard: its bits, depth, size, and the range of full-depth slots that lead to it.

    A slot is a prefix of the greatest depth; ``first_slot`` to ``last_slot`` of a
    shard are all the slots that start with its bits.
    """
    leaves = sharded.select("shard", "depth", "shard_rows", "shard_bytes", "over_limit").distinct()
    deepest = leaves.agg(F.max("depth")).scalar()
    start = F.coalesce(F.conv(F.nullif("shard", F.lit("")), 2, 10).cast("long"), F.lit(0))
    spare = (deepest - F.col("depth")).cast("int")
    first = F.call_function("shiftleft", start, spare)
    return leaves.withColumn("first_slot", first).withColumn("last_slot", first + F.call_function("shiftleft", F.lit(1).cast("long"), spare) - 1)


def document_shards(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_rows, shard_bytes and over_limit of every document."""
    rows = documents.select("doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), seeded_hash(SEED, F.col("doc_id")).alias("h"))
    return shards(materialize(rows), limit).drop("h")


REPORT_SQL = f"""
WITH docs AS (
    SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
           CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 15) AS BIGINT) AS h
    FROM documents
),
every_depth AS (
    SELECT docs.*, d.depth, h >> ({HASH_BITS} - d.depth) AS prefix
    FROM docs, (SELECT CAST(unnest(range(0, {HASH_BITS + 1})) AS INTEGER) AS depth) d
),
sums AS (
    SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM every_depth GROUP BY ALL
),
leaf AS (
    SELECT e.doc_id, e.n_bytes, e.h, min(e.depth) AS depth
    FROM every_depth e JOIN sums s USING (depth, prefix)
    WHERE s.shard_bytes <= {LIMIT} OR e.depth = {HASH_BITS}
    GROUP BY e.doc_id, e.n_bytes, e.h
)
SELECT l.doc_id, l.n_bytes, substr(lpad(bin(l.h), {HASH_BITS}, '0'), 1, l.depth) AS shard, l.depth,
       s.shard_rows, s.shard_bytes, s.shard_bytes > {LIMIT} AS over_limit
FROM leaf l JOIN sums s ON s.depth = l.depth AND s.prefix = l.h >> ({HASH_BITS} - l.depth)
"""
