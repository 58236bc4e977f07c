"""Sharding by proportional stratified interleaving.

Rows are shuffled inside each source by a seeded hash and ranked; the
fractional rank (rank - u) / n of a row says how far into its source it
stands, where u in [0, 1) is a hash of the source, so that many sources of a
row or two are spread as well. Sorting by fractional rank deals the sources
evenly over the whole order, so every contiguous cut of it holds each source
in proportion.

No source is ranked in one task: a rank is the number of rows in the earlier
slices of the hash range plus the rank inside the slice, and the same holds
for the final order. Slices are cut by equal hash or rank ranges, so a source
with a third of all rows has as many slices as any other, evenly filled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.storage import materialize

SHARDS = 40
#: Hex digits of the hash that name a slice: 16^3 slices a source, and as many of the final order.
SLICE_DIGITS = 3
OVERHEAD_BYTES = 16


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = 7, stratum: str = "source") -> DataFrame:
    """``(doc_id, size, text_crc32, stratum, shard, slot)`` of every row, under the law ``rows``: shard counts are at most one apart.

    Null sources are a source of their own. Repeated rows and equal ids each
    get a slot; ties are broken by doc_id, then by the text's checksum. With
    fewer rows than shards the last shards stay empty; an empty table gives
    no rows. Columns of the same name as those made here are not read.
    """
    slices = 16**SLICE_DIGITS
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("1"), F.col(stratum).cast("string")), F.lit("0")).alias("stratum"),  # null is none of the strings
        (F.octet_length(text).cast("bigint") + OVERHEAD_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("mix", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), F.col("text_crc32").cast("string"))))
    rows = materialize(rows.withColumn("slice", F.left("mix", F.lit(SLICE_DIGITS))), "shard-rows")  # narrow: texts are read once

    held = rows.groupBy("stratum", "slice").agg(F.count("*").alias("held"))
    by_slice = Window.partitionBy("stratum").orderBy("slice")
    offsets = held.select(
        "stratum",
        "slice",
        (F.sum("held").over(by_slice) - F.col("held")).alias("earlier"),
        F.sum("held").over(Window.partitionBy("stratum")).alias("n"),
    )
    inside = F.row_number().over(Window.partitionBy("stratum", "slice").orderBy("mix", "doc_id", "text_crc32"))
    ranked = rows.withColumn("inside", inside).join(offsets, ["stratum", "slice"])
    shift = F.conv(F.left(F.md5("stratum"), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    at = ((F.col("earlier") + F.col("inside")).cast("double") - shift) / F.col("n")
    ranked = ranked.withColumn("at", at).withColumn("cut", F.floor(F.col("at") * slices).cast("int"))
    ranked = materialize(ranked.drop("mix", "slice", "inside", "earlier", "n"), "shard-ranks")

    counts = ranked.groupBy("cut").agg(F.count("*").alias("in_cut"))
    starts = counts.select("cut", (F.sum("in_cut").over(Window.orderBy("cut")) - F.col("in_cut")).alias("before_cut"), F.sum("in_cut").over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("cut").orderBy("at", "stratum", "doc_id", "text_crc32"))
    placed = ranked.withColumn("place", place).join(starts, "cut").withColumn("position", F.col("before_cut") + F.col("place") - 1)
    shard = F.expr(f"(position * {shards}) div total")
    first = F.expr(f"(shard * total + {shards} - 1) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.when(F.left("stratum", F.lit(1)) == "1", F.expr("substring(stratum, 2)")).alias("stratum"), "shard", (F.col("position") - first).alias("slot")
    )
