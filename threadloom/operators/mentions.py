"""Mentions of known names in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T


def entity_mentions(texts: DataFrame, names: DataFrame, longest: int = 5) -> DataFrame:
    """``(id, name, at)``: first mention of each name in each text, whole words, the longest name where several overlap.

    Texts are cut to word n-grams that are joined to the names on an equal
    key, so no text is compared with all names. Texts are dealt out by id
    first, and only n-grams that are names are kept, sorted within their text.
    """
    keyed = names.select("name", T.name_norm(F.col("name")).alias("key")).withColumn("n", F.size(F.split("key", " "))).where("key <> ''")
    words = texts.select("id", "text").repartition("id").select("id", T.name_tokens(F.col("text")).alias("w"))
    grams = words.select("id", "w", F.posexplode("w").alias("at", "_")).select(
        "id", "at", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("at"))), lambda n: F.array_join(F.slice("w", F.col("at") + 1, n), " "))).alias("key")
    )
    hits = grams.join(keyed, "key").repartition("id")
    best = Window.partitionBy("id", "at").orderBy(F.desc("n"), "name")
    long = hits.withColumn("r", F.row_number().over(best)).where("r = 1")
    reach = F.max(F.col("at") + F.col("n")).over(Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    free = long.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("reach") <= F.col("at")))
    return free.groupBy("id", "name").agg(F.min("at").alias("at"))
