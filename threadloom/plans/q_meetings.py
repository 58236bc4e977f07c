"""Recorded meetings and dictations: files are made from conversations, a third with timed captions, a third with closed ones, a third with a recording only."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.plans import tables as t
from threadloom.plans.q_handed import shown
from threadloom.plans.tables import sql
from threadloom.sources import meetings as M

QUERIES, SQL = {}, {}

_SAID = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
#: Lines of a conversation as its files have them, and turns made of them.
_TURNS = f"""heard AS (SELECT conv_id, turn, role, {_SAID} AS said FROM thread_records),
said AS (SELECT * FROM heard WHERE said <> ''),
marked AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM said),
runs AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM marked),
turns AS (SELECT conv_id, run, any_value(role) AS role, min(turn) AS first, string_agg(said, ' ' ORDER BY turn) AS said FROM runs GROUP BY conv_id, run),
spoken AS (SELECT conv_id, string_agg(role || ': ' || said, chr(10) ORDER BY run) AS text FROM turns GROUP BY conv_id),
people AS (SELECT conv_id, string_agg('name:' || role || '|' || role, ';' ORDER BY first) AS names FROM (SELECT conv_id, role, min(turn) AS first FROM said WHERE role <> 'assistant' GROUP BY conv_id, role) GROUP BY conv_id),
convs AS (SELECT conv_id, min(ts) AS moment, max(turn) AS last, count(*) FILTER (role = 'user') AS chats FROM thread_records GROUP BY conv_id)"""

_ZOOM = """SELECT 'zoom_local:' || left(sha1(folder), 16) AS id, 'zoom_local' AS source, 'meeting' AS kind, 'meeting:zoom_local:' || left(sha1(folder), 16) AS thread, epoch_us(moment) AS ts_us, NULL AS sender, NULL AS sender_name,
  concat_ws(';', CASE WHEN kind < 2 THEN names END, CASE WHEN chats > 0 THEN 'name:guest ' || conv_id || '|Guest ' || conv_id END) AS recipients, false AS is_from_me, 'Meeting ' || conv_id AS title,
  CASE WHEN kind < 2 THEN coalesce(text, '') ELSE '' END AS text, NULL AS url,
  '{"item_id":"' || folder || '","folder":"' || folder || '","meeting_id":"' || (800000000 + conv_id) || '"' || CASE WHEN kind < 2 AND text IS NOT NULL THEN ',"transcript_source":"' || ['zoom', 'zoom_captions'][kind + 1] || '"' ELSE '' END
    || CASE WHEN kind = 0 AND text IS NOT NULL THEN ',"duration_s":' || (last_said * 4 + 3) ELSE '' END || CASE WHEN kind = 2 OR text IS NULL THEN ',"needs_transcript":true' ELSE '' END || CASE WHEN chats > 0 THEN ',"chat":"Guest ' || conv_id || ': see you"' ELSE '' END || '}' AS meta
FROM (SELECT c.*, CAST(c.conv_id % 3 AS INTEGER) AS kind, s.text, p.names, (SELECT max(turn) FROM said x WHERE x.conv_id = c.conv_id) AS last_said, strftime(moment, '%Y-%m-%d %H.%M.%S') || ' Meeting ' || c.conv_id || ' ' || (800000000 + c.conv_id) AS folder FROM convs c LEFT JOIN spoken s USING (conv_id) LEFT JOIN people p USING (conv_id))"""


def _lines(df, *text):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(*text).alias("x")))), lambda r: r["x"]), "\n\n")


def map_zoom_meetings(spark, sf):
    r = t.thread_records(spark, sf).withColumn("said", F.trim(F.regexp_replace("text", r"\s+", " ")))
    clock = lambda n: F.format_string("%02d:%02d:%02d.000", F.floor(n / 3600), F.floor(n / 60) % 60, n % 60)
    cue = (clock(F.col("turn") * 4), F.lit(" --> "), clock(F.col("turn") * 4 + 3), F.lit("\n<v "), F.col("role"), F.lit(">"), F.col("said"), F.lit("</v>"))
    head = (F.lit("["), F.col("role"), F.lit("] 10:00:00\n"), F.col("said"))
    c = r.groupBy("conv_id").agg(F.min("ts").alias("at"), _lines(r, *cue).alias("vtt"), _lines(r, *head).alias("cc"), F.count_if(F.col("role") == "user").alias("chats"))
    folder = F.concat(F.date_format("at", "yyyy-MM-dd HH.mm.ss"), F.lit(" Meeting "), "conv_id", F.lit(" "), F.lit(800_000_000) + F.col("conv_id"))
    kind = F.col("conv_id") % 3
    file = lambda name, value, keep: F.when(keep, F.struct(F.lit(name).alias("name"), value.alias("value")))
    chat = F.concat(F.lit("10:00:05 From Guest "), "conv_id", F.lit(" to Everyone : see you"))
    files = F.array_compact(F.array(file("audio.vtt", F.concat(F.lit("WEBVTT\n\n"), "vtt"), kind == 0), file("closed_caption.txt", F.col("cc"), kind == 1), file("audio.m4a", F.lit(""), F.lit(True)), file("chat.txt", chat, F.col("chats") > 0)))
    landed = c.select(folder.alias("folder"), F.col("at").alias("modified"), F.explode(files).alias("f")).select("folder", "modified", "f.*")
    return shown(M.zoom_records(landed, "assistant", "UTC"))


_WISPR = """SELECT 'wispr:' || conv_id AS id, 'wispr' AS source, 'meeting' AS kind, 'meeting:wispr:' || conv_id AS thread, epoch_us(moment) AS ts_us, NULL AS sender, NULL AS sender_name, 'name:guest ' || conv_id || '|Guest ' || conv_id || ';name:person|Person' AS recipients, false AS is_from_me, 'Talk ' || conv_id AS title,
  coalesce(text, '') AS text, NULL AS url, '{"item_id":"' || conv_id || '","summary":"about ' || conv_id || '","duration_s":' || (last * 60 + 30) || ',"speakers":["Owner","Person"]' || CASE WHEN text IS NULL THEN ',"needs_transcript":true' ELSE '' END || '}' AS meta
FROM (SELECT c.*, s.text FROM convs c LEFT JOIN (SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN 'Owner' WHEN 'user' THEN 'Person' ELSE 'Speaker 3' END || ': ' || said, chr(10) ORDER BY run) AS text FROM turns GROUP BY conv_id) s USING (conv_id)) WHERE conv_id % 5 <> 4
UNION ALL SELECT 'wispr:h:' || id, 'wispr', 'dictation', NULL, epoch_us(ts), 'mailto:owner@example.com', 'Owner', '', true, NULL, CASE turn % 3 WHEN 0 THEN 'edited ' || id WHEN 1 THEN 'formatted ' || id ELSE said END, NULL,
  '{"item_id":"' || id || '","app":"notes","duration_s":' || turn || '}' FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS said FROM thread_records) WHERE said <> '' OR turn % 3 < 2"""


def map_dictation_app(spark, sf):
    """Meetings with turns in files or inline by number, and dictations."""
    r = t.thread_records(spark, sf).withColumn("said", F.trim(F.regexp_replace("text", r"\s+", " ")))
    speaker = F.when(F.col("role") == "assistant", "spk_0").when(F.col("role") == "user", "spk_1").otherwise("speaker_3")
    row = F.to_json(F.struct(speaker.alias("speaker"), F.col("said").alias("text")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("x")))), lambda x: x["x"])
    c = r.groupBy("conv_id").agg(F.min("ts").alias("at"), F.max("turn").alias("last"), rows.alias("rows"))
    none = F.lit(None).cast("string")
    iso = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    people = F.to_json(F.array(F.struct(F.concat(F.lit("Guest "), F.col("conv_id").cast("string")).alias("name")), F.struct(F.lit("Owner").alias("name"))))
    meetings = c.select(
        F.col("conv_id").alias("id"),
        F.concat(F.lit(" Talk "), "conv_id").alias("title"),
        iso("at").alias("created"),
        none.alias("modified"),
        iso(F.timestamp_seconds(F.unix_seconds("at") + F.col("last") * 60 + 30)).alias("ended"),
        people.alias("participants"),
        none.alias("notes"),
        F.concat(F.lit("about "), "conv_id").alias("summary"),
        F.lit('{"spk_0":"Owner","spk_1":{"name":"Person"}}').alias("speaker_map"),
        none.alias("calendar_id"),
        F.when(F.col("conv_id") % 2 == 1, F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]"))).alias("transcript"),
        (F.col("conv_id") % 5 == 4).alias("deleted"),
    )
    even = c.where("conv_id % 2 = 0").withColumn("folder", F.col("conv_id").cast("string"))
    files = even.select("folder", F.lit("refined.ndjson").alias("name"), F.array_join("rows", "\n").alias("value")).unionByName(even.select("folder", F.lit("a.ndjson").alias("name"), F.lit('{"speaker":"x","text":"draft"}').alias("value")))
    history = r.select("id", F.col("said").alias("asr"), F.when(F.col("turn") % 3 < 2, F.concat(F.lit("formatted "), "id")).alias("formatted"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("edited "), "id")).alias("edited"), iso("ts").alias("at"), F.lit("notes").alias("app"), none.alias("url"), F.col("turn").cast("double").alias("duration"), F.lit(None).cast("int").alias("words"))
    return shown(M.dictation_meetings(meetings, files, "Owner").unionByName(M.dictations(history, (t.OWNER, "Owner"))))


QUERIES |= {"map_zoom_meetings": map_zoom_meetings, "map_dictation_app": map_dictation_app}
SQL |= {"map_zoom_meetings": sql("thread_records", _ZOOM, _TURNS), "map_dictation_app": sql("thread_records", _WISPR, _TURNS)}
