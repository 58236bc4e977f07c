"""Scans, maintenance and windows over records, facts and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators.packing import pack_batches


def records_scan(records: DataFrame, source: str | None = None, sources: Sequence[str] = (), kind: str | None = None, thread: str | None = None, since: Column | None = None, until: Column | None = None, changed_since: Column | None = None, sender: str | None = None, limit: int | None = None) -> DataFrame:
    """Filtered records by time, then id; ``since`` is inclusive, ``until`` and ``changed_since`` are not."""
    tests = [
        source and F.col("source") == source,
        sources and F.col("source").isin(*sources),
        kind and F.col("kind") == kind,
        thread and F.col("thread") == thread,
        None if since is None else F.col("ts") >= since,
        None if until is None else F.col("ts") < until,
        None if changed_since is None else F.col("changed_at") > changed_since,
        sender and F.col("sender") == sender,
    ]
    for test in tests:
        if isinstance(test, Column):
            records = records.where(test)
    ordered = records.orderBy("ts", "id")
    return ordered if limit is None else ordered.limit(limit)


def upsert_records(old: DataFrame, new: DataFrame, now: Column, content: Sequence[str]) -> DataFrame:
    """The next snapshot with ``action``: inserted, updated, unchanged or kept.

    ``old`` has id, the content columns, ingested_at and changed_at; the last
    of repeated new ids by ``seq`` counts. Content is compared by hash.
    """
    last = Window.partitionBy("id").orderBy(F.desc("seq"))
    fresh = new.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("id", *(F.col(c).alias(f"n_{c}") for c in content), F.sha2(F.to_json(F.struct(*content)), 256).alias("n_hash"))
    held = old.withColumn("o_hash", F.sha2(F.to_json(F.struct(*content)), 256))
    both = held.join(fresh, "id", "full_outer")
    action = F.when(F.col("o_hash").isNull(), "inserted").when(F.col("n_hash").isNull(), "kept").when(F.col("o_hash") != F.col("n_hash"), "updated").otherwise("unchanged")
    take = F.col("action").isin("inserted", "updated")
    return both.withColumn("action", action).select(
        "id",
        *(F.when(take, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in content),
        F.coalesce("ingested_at", now).alias("ingested_at"),
        F.when(take, now).otherwise(F.col("changed_at")).alias("changed_at"),
        "action",
    )


def last_write(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Newest value of each key (cursors, bookkeeping)."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias(value), F.max(at).alias(at))


def latest_per(records: DataFrame, key: str, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), tie)
    return records.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def newest_within_budget(items: DataFrame, key: str, size: Column, budget: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The newest rows of each key until ``budget`` is spent, one at least; ``omitted`` counts the rest."""
    newest = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    spent = F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    ranked = items.withColumn("_spent", spent).withColumn("_r", F.row_number().over(newest)).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    kept = ranked.where((F.col("_spent") <= budget) | (F.col("_r") == 1))
    return kept.withColumn("omitted", F.col("_n") - F.count("*").over(Window.partitionBy(key))).drop("_spent", "_r", "_n")


def merge_speaker_turns(turns: DataFrame, key: str, order: str) -> DataFrame:
    """Consecutive rows of one speaker become one row."""
    by = Window.partitionBy(key).orderBy(order)
    change = F.coalesce((F.lag("speaker").over(by) != F.col("speaker")).cast("int"), F.lit(1))
    runs = turns.withColumn("_c", change).withColumn("run", F.sum("_c").over(by))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "text"))), lambda x: x["text"]), " ")
    return runs.groupBy(key, "run", "speaker").agg(F.min(order).alias("start"), F.count("*").alias("lines"), joined.alias("text"))


def ack_after_request(lines: DataFrame, key: str) -> DataFrame:
    """Drops noise, and acknowledgements that don't follow a request of the other side."""
    by = Window.partitionBy(key).orderBy("ts", "id")
    marked = lines.withColumn("_class", T.classify_message(F.col("text"))).withColumn("_asked", T.is_request(F.lag("text").over(by)) & (F.lag("is_from_me").over(by) != F.col("is_from_me")))
    return marked.where((F.col("_class") == "content") | ((F.col("_class") == "ack") & F.coalesce("_asked", F.lit(False)))).drop("_class", "_asked")


def chunk_lines(lines: DataFrame, key: str, order: str, size: int = 8000, total: int = 90_000) -> DataFrame:
    """Lines of a transcript dealt to chunks of at most ``size`` characters, cut at ``total``."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cut = lines.withColumn("_len", F.length("text") + 1).withColumn("_sum", F.sum("_len").over(by)).where(F.col("_sum") <= total)
    return pack_batches(cut, key, [order], "_len", size, size).withColumnRenamed("batch", "chunk").withColumnRenamed("_len", "length")  # a line counts one at least


def latest_fact_wins(facts: DataFrame, key: str, fields: Sequence[str], date: str = "date", seq: str = "seq") -> DataFrame:
    """Newest value of each field that isn't empty; on one day the one applied later."""
    newest = F.struct(date, seq)
    return facts.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), newest)).alias(f) for f in fields))


def status_lifecycle(events: DataFrame, key: str) -> DataFrame:
    """The status of each fact: a later date wins, on one day a closing status does, then the one applied later."""
    closing = (F.col("status") != "open").cast("int")
    return events.groupBy(key).agg(F.max_by("status", F.struct("date", closing, "seq")).alias("status"), F.max("date").alias("status_date"), F.count("*").alias("mentions"))


def nearest_within(left: DataFrame, right: DataFrame, seconds: int = 180) -> DataFrame:
    """For each left (id, at) the right (rid, rat) with the smallest gap of at most ``seconds``; times are epoch seconds.

    A range join by buckets of the window's width: the left looks into its
    own and both neighbouring buckets, an equal join that splits evenly.
    """
    a = left.withColumn("_b", F.explode(F.array(*(F.floor(F.col("at") / seconds) + i for i in (-1, 0, 1)))))
    b = right.withColumn("_b", F.floor(F.col("rat") / seconds))
    near = a.join(b, "_b").where(F.abs(F.col("at") - F.col("rat")) <= seconds)
    return near.groupBy("id").agg(F.min(F.struct(F.abs(F.col("at") - F.col("rat")).alias("gap"), "rid")).alias("m")).select("id", F.col("m.rid").alias("rid"), F.col("m.gap").alias("gap"))


def duplicate_ordinal(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(order)))


def assign_sequence(rows: DataFrame, batch: str, order: str, start: int = 0) -> DataFrame:
    """Increasing numbers in (batch, order), without one global sort: offsets of batches plus ranks inside them."""
    counts = rows.groupBy(batch).agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.orderBy(batch)) - F.col("_n"))
    inside = F.row_number().over(Window.partitionBy(batch).orderBy(order))
    return rows.withColumn("_r", inside).join(starts.select(batch, "_start"), batch).withColumn("seq", F.col("_start") + F.col("_r") + start).drop("_r", "_start")


def exact_duplicates(notes: DataFrame, key: Sequence[str], keep: Sequence[Column]) -> DataFrame:
    """Rows of keys that occur more than once, with the row that is kept."""
    order = Window.partitionBy(*key).orderBy(*keep)
    n = F.count("*").over(Window.partitionBy(*key))
    marked = notes.withColumn("_n", n).where("_n > 1")
    return marked.withColumn("keep_id", F.first("id").over(order)).withColumnRenamed("_n", "copies")


def mention_promotion(mentions: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """Keys named in ``least`` separate items, or known already."""
    counts = mentions.groupBy("key").agg(F.count_distinct("item").alias("items"))
    return counts.join(known.select("key", F.lit(True).alias("known")), "key", "left").where((F.col("items") >= least) | F.col("known")).select("key", "items", F.coalesce("known", F.lit(False)).alias("known"))


def merge_contributions(old: DataFrame, new: DataFrame, key: str, arrays: Sequence[str] = (), most: int = 40) -> DataFrame:
    """Entities after new facts: fields by the latest fact, list fields as capped unions."""
    fields = [c for c in old.columns if c not in (key, "date", "seq", *arrays)]
    every = old.unionByName(new)
    latest = latest_fact_wins(every, key, fields)
    if not arrays:
        return latest
    lists = every.groupBy(key).agg(*(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(a)))), 1, most).alias(a) for a in arrays))
    return latest.join(lists, key)


def restore_run(current: DataFrame, changes: DataFrame, run_id: str, key: str = "id") -> DataFrame:
    """Rows as before a run: those it changed get their image from before, those it made go."""
    own = changes.where(F.col("run_id") == run_id)
    before = own.where("before is not null").select(key, F.col("before.*"))
    return current.join(own.select(key), key, "left_anti").unionByName(before.select(*current.columns))
