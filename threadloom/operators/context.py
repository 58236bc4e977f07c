"""What a batch is told about the world: seven kinds of entities, each ranked and held to a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most entries of each kind; the first people have details.
KNOWN = {"people": 300, "companies": 300, "projects": 200, "meetings": 20, "commitments": 80, "opportunities": 40, "answers": 40}
DETAILED, ALIASES = 120, 4


def _first(df: DataFrame, order: list[Column], kind: str, *fields: str) -> DataFrame:
    """One row with the first entries of a table as an array; the table is sorted by its own tasks and ``limit`` takes from each."""
    top = df.orderBy(*order).limit(KNOWN[kind]).select(*fields)
    keyed = top.withColumn("_r", F.row_number().over(Window.orderBy(*order)))  # at most a few hundred rows
    return keyed.agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.struct(*fields).alias("e")))), lambda x: x["e"]).alias(kind))


def _ranked(df: DataFrame, order: list[Column], kind: str, *fields: str) -> DataFrame:
    """The first entries of each batch as an array; ranks are cut before rows travel."""
    r = F.row_number().over(Window.partitionBy("batch").orderBy(*order))
    top = df.withColumn("_r", r).where(F.col("_r") <= KNOWN[kind])
    return top.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.struct(*fields).alias("e")))), lambda x: x["e"]).alias(kind))


def known_context(batches: DataFrame, participants: DataFrame, people: DataFrame, companies: DataFrame, projects: DataFrame, meetings: DataFrame, commitments: DataFrame, opportunities: DataFrame, answers: DataFrame) -> DataFrame:
    """One row a batch with an array of each kind of ``KNOWN``.

    People: those of the batch first, then the strongest; the first
    ``DETAILED`` carry aliases and company. Meetings: the newest with someone
    of the batch, or the newest of all where a batch names no one. Open
    commitments: those with someone of the batch, newest first. Open
    opportunities: with someone of the batch or with no one. Companies and
    projects by title, answers by time, are the same for all.

    ``participants`` (batch, person_id); ``people`` (id, title, strength,
    aliases, company); ``companies`` (title); ``projects`` (title, status,
    last_activity); ``meetings`` (id, title, date, people); ``commitments``
    (id, text, counterpart, date, due, status); ``opportunities`` (id, title,
    counterpart, date, status); ``answers`` (id, text, at). Nothing is paired
    but batches with what belongs to their people; what all share is one row.
    """
    who = participants.select("batch", "person_id").where("person_id is not null").distinct()
    strongest = [F.desc("strength"), F.asc("title"), F.asc("id")]
    fields = ("id", "title", "strength", "aliases", "company")
    everyone = _first(people, strongest, "people", *fields).withColumnRenamed("people", "strong")
    own = _ranked(who.join(people, who["person_id"] == people["id"]), strongest, "people", *fields).withColumnRenamed("people", "own")

    seen = meetings.select("id", "title", "date", F.explode("people").alias("person_id")).join(who, "person_id").select("batch", "id", "title", "date").distinct()
    newest = [F.desc("date"), F.asc("id")]
    met = _ranked(seen, newest, "meetings", "id", "title", "date")
    latest = _first(meetings, newest, "meetings", "id", "title", "date").withColumnRenamed("meetings", "latest")

    is_open = F.coalesce("status", F.lit("open")) == "open"
    due = commitments.where(is_open).join(who, commitments["counterpart"] == who["person_id"])
    owed = _ranked(due, newest, "commitments", "id", "text", "counterpart", "date", "due")

    chances = opportunities.where(is_open)
    theirs = _ranked(chances.join(who, chances["counterpart"] == who["person_id"]), newest, "opportunities", "date", "id", "title", "counterpart").withColumnRenamed("opportunities", "theirs")
    free = _first(chances.where("counterpart is null"), newest, "opportunities", "date", "id", "title", "counterpart").withColumnRenamed("opportunities", "free")

    shared = everyone
    for one in (_first(companies.select("title").distinct(), [F.asc("title")], "companies", "title"), _first(projects, [F.asc("title"), F.asc("status"), F.asc("last_activity")], "projects", "title", "status", "last_activity"), _first(answers, [F.desc("at"), F.asc("id")], "answers", "id", "text", "at"), latest, free):
        shared = shared.withColumn("_k", F.lit(1)).join(F.broadcast(one.withColumn("_k", F.lit(1))), "_k").drop("_k")  # one row each
    rows = batches.select("batch").distinct()
    for one in (own, met, owed, theirs):
        rows = rows.join(one, "batch", "left")
    rows = rows.withColumn("_k", F.lit(1)).join(F.broadcast(shared.withColumn("_k", F.lit(1))), "_k")

    none = lambda kind, like: F.coalesce(F.col(kind), F.slice(F.col(like), 1, 0))
    mine = none("own", "strong")
    ids = F.transform(mine, lambda p: p["id"])
    merged = F.slice(F.concat(mine, F.filter("strong", lambda p: ~F.array_contains(ids, p["id"]))), 1, KNOWN["people"])
    told = F.transform(merged, lambda p, i: F.struct(p["id"].alias("id"), p["title"].alias("name"), F.when(i < DETAILED, F.slice(F.filter(p["aliases"], lambda a: a != p["title"]), 1, ALIASES)).alias("aliases"), F.when(i < DETAILED, p["company"]).alias("company")))
    later = lambda x, y: F.when(x["date"].eqNullSafe(y["date"]), F.when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)).when(y["date"].isNull() | (x["date"] > y["date"]), -1).otherwise(1)
    chance = F.slice(F.array_sort(F.concat(none("theirs", "free"), "free"), later), 1, KNOWN["opportunities"])
    named = F.exists(F.coalesce("own", F.array().cast(rows.schema["strong"].dataType)), lambda p: p["id"].isNotNull())
    return rows.select("batch", told.alias("people"), "companies", "projects", F.when(named, none("meetings", "latest")).otherwise(F.col("latest")).alias("meetings"), F.coalesce("commitments", F.array().cast(rows.schema["commitments"].dataType)).alias("commitments"), chance.alias("opportunities"), "answers")
