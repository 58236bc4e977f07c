"""Queries over source mappers and streams; payloads are made from the tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import handles as H
from threadloom.operators.privacy import filter_record
from threadloom.operators.pairs import TASKS
from threadloom.plans import tables as t
from threadloom.plans.q_scalar import _RULES, _VERDICT
from threadloom.plans.tables import sql
from threadloom.sources import mappers as M

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


def _payload(df, *columns):
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


@query("landed_json_scan", sql("records", "SELECT 't:' || user_id AS thread, count(*) AS n FROM records GROUP BY ALL"))
def landed_json_scan(spark, sf):
    raw = t.records(spark, sf).groupBy("thread").agg(F.collect_list(F.struct("id", "thread")).alias("messages")).select(F.to_json(F.struct("messages", F.lit("x").alias("account"))).alias("value"))
    return M.landed_json(raw, "struct<id:string,thread:string>").groupBy("item.thread").agg(F.count("*").alias("n"))


@query("map_calendar_events", sql("records", "SELECT 'gcal:' || id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS s, 1 AS people FROM records WHERE kind = 'meeting'"))
def map_calendar_events(spark, sf):
    r = t.records(spark, sf).where("kind = 'meeting'")
    raw = _payload(r, "id", F.col("thread").alias("summary"), F.struct(_iso("ts").alias("dateTime")).alias("start"), F.array(F.struct(F.lit("ann@example.com").alias("email"))).alias("attendees"))
    return M.map_calendar_events(M.landed_json(raw, M.GCAL)).select("id", F.unix_seconds("ts").alias("s"), F.size("recipients").alias("people"))


@query("map_drive_docs", sql("notes", "SELECT 'drive:' || id AS id, source AS title, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM notes"))
def map_drive_docs(spark, sf):
    raw = _payload(t.notes(spark, sf), "id", F.col("source").alias("name"), _iso("ts").alias("modifiedTime"), "text")
    return M.map_drive_docs(M.landed_json(raw, M.DRIVE)).select("id", "title", F.unix_seconds("ts").alias("s"))


def _meetings(spark, sf):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("speaker"), x["text"].alias("text")))
    m = t.thread_records(spark, sf).groupBy("conv_id").agg(turns.alias("turns"), F.min("ts").alias("at"))
    return _payload(m, F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("Meeting "), F.col("conv_id").cast("string")).alias("title"), _iso("at").alias("start"), F.lit(30.0).alias("duration"), "turns")


def _meeting_query(tool: str):
    want = f"SELECT '{tool}:' || conv_id AS id, 'Meeting ' || conv_id AS title, count(DISTINCT role) AS people, string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS text FROM thread_records GROUP BY conv_id"

    @query(f"map_{tool}_meetings", sql("thread_records", want))
    def run(spark, sf):
        found = M.map_meetings(M.landed_json(_meetings(spark, sf), M.MEETING), tool, M.MEETING_TOOLS[tool])
        return found.select("id", "title", F.size("recipients").cast("bigint").alias("people"), "text")


for _tool in M.MEETING_TOOLS:
    _meeting_query(_tool)


@query("map_calls", sql("records", "SELECT CASE WHEN is_from_me THEN 'outgoing' WHEN duration_s > 0 THEN 'incoming' ELSE 'missed' END AS direction, count(*) AS n FROM records WHERE kind = 'call' GROUP BY ALL"))
def map_calls(spark, sf):
    c = t.records(spark, sf).where("kind = 'call'").select(F.col("id").alias("key"), F.col("other").alias("handle"), F.col("ts").alias("at"), F.col("is_from_me").alias("from_me"), (F.col("duration_s") > 0).alias("answered"), F.col("duration_s").alias("seconds"), F.lit("phone").alias("service"))
    return M.map_calls(c).groupBy(F.get_json_object("meta", "$.direction").alias("direction")).agg(F.count("*").alias("n"))


@query("map_contact_cards", sql("contacts", "SELECT card, name, phone || ',' || mail AS handles FROM contacts"))
def map_contact_cards(spark, sf):
    c = t.contacts(spark, sf).select("card", "name", "company", H.value(F.col("phone")).alias("phone"), H.value(F.col("mail")).alias("mail"))
    return M.contact_cards(c).select("card", "name", F.array_join("handles", ",").alias("handles"))


def _export(spark, sf):
    r = t.thread_records(spark, sf)
    head = F.concat(F.date_format("ts", "dd/MM/yyyy, HH:mm"), F.lit(" - "), "role", F.lit(": "))
    one = F.concat(head, F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("\nand more"))
    whole = r.groupBy(F.col("thread").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("o")))), lambda x: x["o"]), "\n").alias("v"))
    return whole.select("file", F.posexplode(F.split("v", "\n")).alias("line", "value"))


@query("chat_export_text_scan", sql("thread_records", "SELECT thread AS file, CAST(row_number() OVER (PARTITION BY thread ORDER BY turn) AS BIGINT) AS n, role AS sender, trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(10) || 'and more' AS text FROM thread_records"))
def chat_export_text_scan(spark, sf):
    return M.chat_export_lines(_export(spark, sf)).select("file", F.col("n").cast("bigint").alias("n"), "sender", "text")


@query("infer_date_order", sql("thread_records", "SELECT DISTINCT thread AS file, 'dmy' AS order_ FROM thread_records"))
def infer_date_order(spark, sf):
    return M.infer_date_order(M.chat_export_lines(_export(spark, sf))).select("file", F.when(F.col("order") == "mdy", "dmy").otherwise(F.col("order")).alias("order_"))


@query("transcript_files_scan", sql("thread_records", "SELECT conv_id, count(*) AS cues, count(DISTINCT role) AS speakers FROM thread_records GROUP BY conv_id"))
def transcript_files_scan(spark, sf):
    r = t.thread_records(spark, sf)
    cue = F.concat(F.lit("00:00:01.000 --> 00:00:02.000\n<v "), "role", F.lit(">"), F.regexp_replace("text", r"\s+", " "))
    f = r.groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"]), "\n\n")).alias("value"))
    cues = M.vtt_cues(f.withColumnRenamed("conv_id", "file"))
    return cues.groupBy(F.col("file").alias("conv_id")).agg(F.count("*").alias("cues"), F.count_distinct("speaker").alias("speakers"))


@query("derive_recap_meetings", sql("projects", "SELECT id, title, 2 AS actions FROM projects WHERE id % 3 = 0"))
def derive_recap_meetings(spark, sf):
    subject = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Recap of "), "title")).otherwise(F.col("title"))
    mails = t.projects(spark, sf).select("id", F.lit(None).cast("timestamp").alias("ts"), subject.alias("subject"), F.lit("Hello\nAction items:\n- one\n- two\n").alias("text"))
    return M.derive_recaps(mails).select("id", "title", F.size("action_items").alias("actions"))


@query("mime_messages_scan", sql("thread_records", "SELECT id AS path, 'Subject ' || conv_id AS subject, turn = 0 AS bulk FROM thread_records"))
def mime_messages_scan(spark, sf):
    r = t.thread_records(spark, sf)
    head = F.concat(F.lit("From: Ann <ann@example.com>\r\nTo: owner@example.com\r\nSubject: Subject "), F.col("conv_id").cast("string"), F.when(F.col("turn") == 0, "\r\nList-Id: <news>").otherwise(""), F.lit("\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"))
    files = r.select(F.col("id").alias("path"), F.encode(F.concat(head, "text"), "UTF-8").alias("content"))
    return M.mime_messages(files).select("path", "subject", "bulk")


@query("contributions_scan", sql("items", "SELECT CASE WHEN seq = 1 THEN 'refs' WHEN seq = 2 THEN 'section' ELSE 'good' END AS outcome, count(*) AS n FROM items GROUP BY ALL"))
def contributions_scan(spark, sf):
    i = t.items(spark, sf).select(F.col("target").alias("batch"), F.when(F.col("seq") == 2, "gossip").otherwise("decisions").alias("section"), F.col("ref").alias("text"), F.when(F.col("seq") == 1, F.array().cast("array<string>")).otherwise(F.array("ref")).alias("refs"))
    good, bad = M.contributions(i)
    return good.select(F.lit("good").alias("outcome")).unionByName(bad.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("source_report", sql("records", "SELECT s AS kind, count(r.id) AS n FROM (SELECT unnest(['message', 'email', 'call', 'meeting', 'event', 'note']) AS s) k LEFT JOIN records r ON r.kind = k.s GROUP BY s"))
def source_report(spark, sf):
    known = spark.createDataFrame([(k,) for k in ("message", "email", "call", "meeting", "event", "note")], "kind string")
    counts = t.records(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))
    return known.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("incremental_ingest", sql("records", "SELECT id, kind FROM records WHERE kind <> 'event'"))
def incremental_ingest(spark, sf):
    from threadloom.streaming import ingest as S

    r = t.records(spark, sf)
    out = S.new_folder(spark, "ingested")
    S.incremental_ingest(spark, S.landing_of(r), r.schema, out, F.col("kind") != "event")
    return spark.read.schema(r.schema).parquet(out).select("id", "kind")


@query("dedupe_stream", sql("records", "SELECT DISTINCT id FROM records"))
def dedupe_stream(spark, sf):
    from threadloom.streaming import ingest as S

    r = t.records(spark, sf)
    twice = r.unionByName(r.where("duration_s % 2 = 0"))
    out = S.new_folder(spark, "deduped")
    S.dedupe_stream(spark, S.landing_of(twice), r.schema, "id", "ts", out, "60 days")
    return spark.read.schema(r.schema).parquet(out).select("id")


@query("thread_gate_state", sql("records", "SELECT thread, true AS closed FROM judged WHERE scope = 'thread' GROUP BY thread", _VERDICT))
def thread_gate_state(spark, sf):
    from threadloom.streaming import ingest as S

    # read from few files, so the records are dealt out before they are judged
    r = t.records(spark, sf).repartition(TASKS).withColumns({"sender": F.col("other"), "sender_name": F.lit(None).cast("string"), "title": F.lit(""), "text": F.lit(""), "account": F.lit(None).cast("string"), "chat": F.lit(None).cast("string"), "members": F.when(F.col("user_id") % 5 == 0, 9).otherwise(2)})
    judged = filter_record(r, _RULES).select("thread", "id", "keep", F.coalesce("scope", F.lit("")).alias("scope"))
    out = S.new_folder(spark, "gated")
    S.thread_gate_stream(spark, S.landing_of(judged, TASKS), judged.schema, out)
    return spark.read.schema("thread string, id string, action string").parquet(out).where("action = 'retract'").select("thread", F.lit(True).alias("closed"))
