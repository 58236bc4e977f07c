"""Landed payloads to records: one mapper a source, each a select over parsed columns.

All give id, source, kind, thread, ts, sender (handle, name), recipients,
title, text and a JSON ``meta``; a payload without an id or a time gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import handles as H
from threadloom.functions import text as T

PARTY = "struct<handle:string,name:string>"


def party(handle: Column, name: Column | None = None) -> Column:
    return F.struct(handle.alias("handle"), (F.lit(None).cast("string") if name is None else name).alias("name")).cast(PARTY)


def records_of(df: DataFrame, **columns: Column) -> DataFrame:
    empty = F.array().cast(f"array<{PARTY}>")
    wanted = {"id": None, "source": None, "kind": None, "thread": F.lit(None).cast("string"), "ts": None, "sender": F.lit(None).cast(PARTY), "recipients": empty, "title": F.lit(None).cast("string"), "text": F.lit(""), "meta": F.lit("{}")}
    return df.select(*((columns.get(n) if columns.get(n) is not None else default).alias(n) for n, default in wanted.items())).where("id is not null and ts is not null")


LISTS = ("items", "messages", "results", "files", "events", "threads", "data")


def landed_json(raw: DataFrame, item: str, column: str = "value") -> DataFrame:
    """Rows of ``item`` (a DDL type) from texts that are an array, an object with one list property, or a single object.

    The other keys of a wrapping object stay as JSON in ``context``.
    """
    v = F.trim(F.col(column))
    wrapper = ", ".join(f"{n}:array<{item}>" for n in LISTS)
    parsed = raw.select(v.alias("v"), F.from_json(v, f"array<{item}>").alias("a"), F.from_json(v, f"struct<{wrapper}>").alias("w"), F.from_json(v, item).alias("o"))
    inner = F.coalesce(*(F.col(f"w.{n}") for n in LISTS))
    every = F.when(F.col("v").startswith("["), F.col("a")).otherwise(F.coalesce(inner, F.array("o")))
    return parsed.select(F.when(inner.isNotNull() & ~F.col("v").startswith("["), F.col("v")).alias("context"), F.explode(every).alias("item"))


GCAL = "struct<id:string,summary:string,description:string,location:string,status:string,start:struct<dateTime:string,date:string>,end:struct<dateTime:string,date:string>,organizer:struct<email:string>,attendees:array<struct<email:string,displayName:string,responseStatus:string>>>"


def map_calendar_events(items: DataFrame) -> DataFrame:
    at = lambda c: F.try_to_timestamp(F.coalesce(F.col(f"{c}.dateTime"), F.col(f"{c}.date")))
    people = F.transform(F.coalesce("item.attendees", F.array().cast("array<struct<email:string,displayName:string,responseStatus:string>>")), lambda a: party(H.email_handle(a["email"]), a["displayName"]))
    return records_of(
        items,
        id=F.concat(F.lit("gcal:"), "item.id"),
        source=F.lit("gcal"),
        kind=F.lit("event"),
        ts=at("item.start"),
        sender=party(H.email_handle(F.col("item.organizer.email"))),
        recipients=people.cast(f"array<{PARTY}>"),
        title=F.col("item.summary"),
        text=F.concat_ws("\n", "item.description", "item.location"),
        meta=F.to_json(F.struct(at("item.end").alias("end"), F.col("item.status").alias("status"))),
    )


DRIVE = "struct<id:string,name:string,modifiedTime:string,text:string,owners:array<struct<emailAddress:string,displayName:string>>,lastModifyingUser:struct<emailAddress:string,displayName:string>>"


def map_drive_docs(items: DataFrame) -> DataFrame:
    who = F.coalesce(F.try_element_at("item.owners", F.lit(1)), F.col("item.lastModifyingUser"))
    return records_of(items.where("item.text is not null"), id=F.concat(F.lit("drive:"), "item.id"), source=F.lit("drive"), kind=F.lit("doc"), ts=F.try_to_timestamp("item.modifiedTime"), sender=party(H.email_handle(who["emailAddress"]), who["displayName"]), title=F.col("item.name"), text=T.clean_text(F.col("item.text")))


MEETING = "struct<id:string,title:string,start:string,duration:double,turns:array<struct<speaker:string,text:string>>,invitees:array<string>,summary:string,actions:array<string>>"


def map_meetings(items: DataFrame, source: str, seconds: float = 1.0) -> DataFrame:
    """A meeting tool's payload: transcript lines, people from its speakers or else its invitees; ``seconds`` is its unit of duration."""
    turns = F.coalesce("item.turns", F.array().cast("array<struct<speaker:string,text:string>>"))
    heard = F.array_distinct(F.filter(F.transform(turns, lambda t: t["speaker"]), lambda s: F.coalesce(s, F.lit("")) != ""))
    people = F.when(F.size(heard) > 0, heard).otherwise(F.coalesce("item.invitees", F.array().cast("array<string>")))
    return records_of(
        items,
        id=F.concat(F.lit(f"{source}:"), "item.id"),
        source=F.lit(source),
        kind=F.lit("meeting"),
        ts=F.try_to_timestamp("item.start"),
        recipients=F.transform(people, lambda p: party(H.make_handle(p), p)).cast(f"array<{PARTY}>"),
        title=F.col("item.title"),
        text=T.transcript_text(turns),
        meta=F.to_json(F.struct((F.col("item.duration") * seconds).cast("bigint").alias("duration_s"), F.col("item.summary").alias("summary"), F.slice(F.coalesce("item.actions", F.array().cast("array<string>")), 1, 30).alias("action_items"), (F.size(turns) == 0).alias("needs_transcript"))),
    )


#: Meeting tools and the unit of their durations in seconds.
MEETING_TOOLS = {"fathom": 1.0, "fireflies": 60.0, "granola": 1.0, "grain": 0.001, "readai": 1.0, "tldv": 1.0}


def map_calls(calls: DataFrame) -> DataFrame:
    """Rows of (key, handle, at, from_me, answered, seconds, service)."""
    direction = F.when(F.col("from_me"), "outgoing").when(F.col("answered") & (F.col("seconds") > 0), "incoming").otherwise("missed")
    return records_of(
        calls.withColumn("direction", direction),
        id=F.concat(F.lit("calls:"), F.col("key").cast("string")),
        source=F.lit("calls"),
        kind=F.lit("call"),
        thread=F.concat(F.lit("calls:"), "handle"),
        ts=F.col("at"),
        sender=party(F.col("handle")),
        text=F.format_string("%s %s call, %d s", F.initcap("direction"), F.col("service"), F.col("seconds")),
        meta=F.to_json(F.struct("direction", F.col("seconds").alias("duration_s"))),
    )


def contact_cards(cards: DataFrame) -> DataFrame:
    """Rows of (card, name, company, phone, mail) to one contact a card with its distinct handles."""
    rows = cards.groupBy("card").agg(F.min("name").alias("name"), F.min("company").alias("company"), F.array_sort(F.collect_set(H.phone_handle(F.col("phone")))).alias("phones"), F.array_sort(F.collect_set(H.email_handle(F.col("mail")))).alias("mails"))
    return rows.withColumn("handles", F.concat("phones", "mails"))


HEADER = r"^\[?(\d{1,4})[/.-](\d{1,2})[/.-](\d{1,4}),? (\d{1,2}):(\d{2})(?::\d{2})?(?: ?([APap])\.?[Mm]\.?)?\]?(?: -)? ([^:]{1,60}): (.*)$"


def chat_export_lines(lines: DataFrame) -> DataFrame:
    """Messages of exported chats from rows of (file, line, value): header lines begin one, other lines continue it."""
    from pyspark.sql import Window

    by = Window.partitionBy("file").orderBy("line")
    head = F.col("value").rlike(HEADER)
    marked = lines.withColumn("n", F.sum(head.cast("int")).over(by)).where("n > 0")
    part = lambda i: F.regexp_extract("value", HEADER, i)
    cut = marked.withColumn("t", F.when(head, part(8)).otherwise(F.col("value")))
    first = lambda c: F.min_by(c, "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n")
    return cut.groupBy("file", "n").agg(*(first(part(i)).cast("int").alias(f"p{i}") for i in (1, 2, 3)), first(part(4)).cast("int").alias("hour"), first(part(5)).cast("int").alias("minute"), F.lower(first(part(6))).alias("half"), first(part(7)).alias("sender"), text.alias("text"))


def infer_date_order(messages: DataFrame) -> DataFrame:
    """``(file, order)``: ymd with a four-digit first part; else what a part over twelve says; else the reading with fewer steps back in time; else dmy."""
    from pyspark.sql import Window

    by = Window.partitionBy("file").orderBy("n")
    dmy, mdy = F.col("p3") * 10_000 + F.col("p2") * 100 + F.col("p1"), F.col("p3") * 10_000 + F.col("p1") * 100 + F.col("p2")
    back = lambda d: (F.lag(d).over(by) > d).cast("int")
    sums = messages.withColumn("_d", back(dmy)).withColumn("_m", back(mdy)).groupBy("file").agg(F.max("p1").alias("a"), F.max("p2").alias("b"), F.sum("_d").alias("d"), F.sum("_m").alias("m"))
    order = F.when(F.col("a") > 31, "ymd").when(F.col("a") > 12, "dmy").when(F.col("b") > 12, "mdy").when(F.coalesce("m", F.lit(0)) < F.coalesce("d", F.lit(0)), "mdy").otherwise("dmy")
    return sums.select("file", order.alias("order"))


def vtt_cues(files: DataFrame) -> DataFrame:
    """Cues (file, cue, speaker, text) of WebVTT texts; the speaker is the voice tag or a name before a colon."""
    blocks = files.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), r"\n{2,}")).alias("cue", "b")).where(F.col("b").contains("-->"))
    body = F.trim(F.regexp_replace(F.regexp_extract("b", r"(?s)-->[^\n]*\n(.*)$", 1), r"\s+", " "))
    cut = blocks.withColumn("t", body)
    voice, name = F.regexp_extract("t", r"^<v ([^>]+)>", 1), F.regexp_extract("t", r"^([^:<]{1,60}): ", 1)
    return cut.select("file", "cue", F.coalesce(F.nullif(voice, F.lit("")), F.nullif(name, F.lit(""))).alias("speaker"), F.trim(F.regexp_replace(F.regexp_replace("t", r"^<v [^>]+>|</v>", ""), r"^[^:<]{1,60}: ", "")).alias("text"))


def derive_recaps(mails: DataFrame) -> DataFrame:
    """Meetings told by recap mails (id, ts, subject, text): provider, title and the bullets under an action heading."""
    provider = F.when(F.lower("subject").rlike("^(recap|notes) (of|for|from)"), "recap").when(F.lower("subject").rlike("meeting (summary|notes)"), "summary")
    title = F.regexp_extract("subject", r"(?i)^(?:recap|notes) (?:of|for|from):? (.+)$", 1)
    part = F.regexp_extract("text", r"(?is)action items:?\s*\n(.*)$", 1)
    return mails.withColumn("provider", provider).where("provider is not null").select("id", "ts", "provider", F.coalesce(F.nullif(title, F.lit("")), "subject").alias("title"), F.slice(F.regexp_extract_all(part, F.lit(r"(?m)^\s*[-*•]\s+(.+)$"), F.lit(1)), 1, 30).alias("action_items"))


def mime_messages(files: DataFrame) -> DataFrame:
    """(path, content) of mail files to their parts, in Arrow batches with Python's own mail parser."""
    schema = "path string, message_id string, sender string, recipients string, subject string, date string, text string, bulk boolean"

    def run(batches):
        import email
        import email.policy

        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                m = email.message_from_bytes(bytes(content), policy=email.policy.default)
                body = m.get_body(preferencelist=("plain", "html"))
                try:
                    text = body.get_content() if body else ""
                except (LookupError, KeyError):
                    text = ""
                bulk = bool(m["List-Id"] or m["List-Unsubscribe"]) or str(m["Precedence"] or "").lower() in ("bulk", "list", "junk") or str(m["Auto-Submitted"] or "no").lower() != "no"
                rows.append((path, *(str(m[h]) if m[h] else None for h in ("Message-ID", "From", "To", "Subject", "Date")), text, bulk))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "content").mapInPandas(run, schema)


SECTIONS = ("people", "companies", "projects", "meetings", "decisions", "commitments", "ideas", "opportunities", "knowledge")


def contributions(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts (batch, section, text, refs) with a text and one ref at least, and the rejected rest with a reason."""
    reason = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "text").when(F.size(F.coalesce("refs", F.array().cast("array<string>"))) == 0, "refs").when(~F.col("section").isin(*SECTIONS), "section")
    judged = items.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")
