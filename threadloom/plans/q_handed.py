"""Queries over handed-over payloads, built by Spark as JSON from the tables in all shapes that the mappers take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.plans import tables as t
from threadloom.plans.tables import sql
from threadloom.sources import chats as C
from threadloom.sources import handed as M

QUERIES, SQL = {}, {}
ACCOUNT = "owner@example.com"


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


def shown(records):
    """All columns of records, in kinds that both engines compare alike."""
    people = F.array_join(F.transform("recipients", lambda p: F.concat(p["handle"], F.lit("|"), F.coalesce(p["name"], F.lit("")))), ";")
    return records.select(
        "id", "source", "kind", "thread", F.unix_micros("ts").alias("ts_us"), F.col("sender.handle").alias("sender"), F.col("sender.name").alias("sender_name"), people.alias("recipients"), "is_from_me", "title", "text", "url", "meta"
    )


def _coded(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", ""), "+/", "-_"), "=+$", "")


def _leaf(mime: str, text: Column) -> Column:
    return F.concat(F.lit(f'{{"mimeType":"{mime}","body":{{"data":"'), _coded(text), F.lit('"}}'))


def _tree(mime: str, *parts: Column) -> Column:
    return F.concat(F.lit(f'{{"mimeType":"{mime}","body":{{"size":0}},"parts":['), F.concat_ws(",", *parts), F.lit("]}"))


#: Shapes of mails, by the number of their message: plain, HTML, both, HTML far down beside attachments, flat.
_HTML_TEXT = r"trim(regexp_replace(regexp_replace(' Dear ' || chr(10) || ' ' || text || ' & co ', '[ \t]+', ' ', 'g'), '\n\s+', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"
_GMAIL = f"""SELECT 'gmail:' || id AS id, 'gmail' AS source, 'email' AS kind, 'email:' || thread AS thread, epoch_us(ts) AS ts_us,
  CASE role WHEN 'assistant' THEN 'mailto:owner@example.com' WHEN 'user' THEN 'mailto:person' || (conv_id % 40) || '@example.com' ELSE 'mailto:alerts@example.com' END AS sender,
  CASE role WHEN 'assistant' THEN 'Owner' WHEN 'user' THEN 'Person ' || (conv_id % 40) END AS sender_name,
  'mailto:ann@example.com|Ann;mailto:bo@example.com|' || CASE WHEN turn % 5 = 4 THEN '' ELSE ';mailto:cc@example.com|C' END AS recipients, role = 'assistant' AS is_from_me, 'About ' || conv_id AS title,
  CASE WHEN turn % 5 IN (1, 3) THEN {_HTML_TEXT} ELSE text END AS text, 'https://mail.google.com/mail/u/0/#all/' || id AS url,
  CASE WHEN turn % 5 = 4 THEN '{{"labels":[],"account":"owner@example.com"}}' ELSE '{{"labels":["INBOX","L' || turn || '"],"account":"owner@example.com"}}' END AS meta FROM thread_records"""


def _mails(spark, sf):
    """One landed text a conversation: its mails under ``messages``."""
    r = t.thread_records(spark, sf)
    html = F.concat(F.lit("<style>p { x }</style><p>Dear&nbsp;</p>\n <b>"), F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</b>&amp; co<script>x</script>"))
    plain, rich, pdf = _leaf("text/plain", F.col("text")), _leaf("text/html", html), F.lit('{"mimeType":"application/pdf","filename":"a.pdf","body":{"attachmentId":"x","size":9}}')
    far = _tree("multipart/alternative", rich)
    for _ in range(4):
        far = _tree("multipart/mixed", pdf, far)
    kind = F.col("turn") % 5
    payload = F.when(kind == 0, plain).when(kind == 1, rich).when(kind == 2, _tree("multipart/alternative", rich, plain, pdf)).otherwise(far)
    sender = F.when(F.col("role") == "assistant", "Owner <owner@example.com>").when(F.col("role") == "user", F.concat(F.lit('"Person '), F.col("conv_id") % 40, F.lit('" <person'), F.col("conv_id") % 40, F.lit("@example.com>"))).otherwise("alerts@example.com")
    title = F.concat(F.lit("About "), F.col("conv_id").cast("string"))
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    to = F.lit("Ann <ann@example.com>, bo@example.com")
    headers = F.to_json(F.array(header("subject", title), header("From", sender), header("TO", to), header("Cc", F.lit("C <CC@example.com>"))))
    labels = F.to_json(F.array(F.lit("INBOX"), F.concat(F.lit("L"), F.col("turn").cast("string"))))
    whole = F.concat(F.lit('{"id":"'), "id", F.lit('","threadId":"'), "thread", F.lit('","internalDate":"'), F.unix_millis("ts").cast("string"), F.lit('","labelIds":'), labels, F.lit(',"payload":'), F.expr("left(_p, length(_p) - 1)"), F.lit(',"headers":'), headers, F.lit("}}"))
    flat = F.to_json(F.struct("id", F.col("thread").alias("thread_id"), title.alias("subject"), sender.alias("from"), to.alias("to"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.col("text").alias("body")))
    one = r.withColumn("_p", payload).withColumn("m", F.when(kind == 4, flat).otherwise(whole))
    return one.groupBy("conv_id").agg(F.concat(F.lit('{"account":"x","messages":['), F.concat_ws(",", F.collect_list("m")), F.lit("]}")).alias("value"))


@query("map_gmail_messages", sql("thread_records", _GMAIL))
def map_gmail_messages(spark, sf):
    return shown(M.gmail_records(M.handed_items(_mails(spark, sf)), [t.OWNER], F.lit(ACCOUNT)))


_SLACK = """SELECT 'slack:' || room || ':' || stamp AS id, 'slack' AS source, 'message' AS kind, 'slack:' || room AS thread, epoch_us(ts) + 100 AS ts_us, CASE WHEN role = 'system' THEN 'name:the bot' ELSE 'slack:T1/' || role END AS sender,
  CASE role WHEN 'system' THEN 'The Bot' WHEN 'user' THEN 'Person ' || conv_id END AS sender_name, '' AS recipients, role = 'assistant' AS is_from_me, NULL AS title, text,
  CASE WHEN turn = 0 THEN 'https://chat.example.com/' || id END AS url,
  '{"channel":"' || room || '"' || CASE WHEN conv_id % 3 < 2 THEN ',"channelName":"room ' || conv_id || '"' ELSE '' END || CASE WHEN turn % 2 = 1 THEN ',"threadTs":"1.5"' ELSE '' END
    || CASE WHEN conv_id % 3 < 2 THEN ',"chat_name":"room ' || conv_id || '"' ELSE '' END || ',"is_group":' || (conv_id % 3 < 2) || CASE WHEN conv_id % 3 = 0 THEN ',"member_count":' || (2 + conv_id % 9) ELSE '' END || '}' AS meta
FROM (SELECT *, CASE WHEN conv_id % 3 = 2 THEN 'D' ELSE 'C' END || conv_id AS room, CAST(epoch(ts) AS BIGINT) || '.000100' AS stamp FROM thread_records)"""


@query("map_slack_messages", sql("thread_records", _SLACK))
def map_slack_messages(spark, sf):
    """A third of the conversations as channel reads with a wrapper, a third as messages that name their channel, a third as direct messages."""
    key = F.col("conv_id").cast("string")
    kind, room = F.col("conv_id") % 3, F.concat(F.when(F.col("conv_id") % 3 == 2, "D").otherwise("C"), key)
    name = F.concat(F.lit("room "), key)
    told = {
        "ts": F.concat(F.unix_seconds("ts").cast("string"), F.lit(".000100")),
        "user": F.when(F.col("role") != "system", F.col("role")),
        "username": F.when(F.col("role") == "system", "The Bot"),
        "user_profile": F.when(F.col("role") == "user", F.struct(F.concat(F.lit("Person "), key).alias("real_name"))),
        "text": F.col("text"),
        "thread_ts": F.when(F.col("turn") % 2 == 1, "1.5"),
        "permalink": F.when(F.col("turn") == 0, F.concat(F.lit("https://chat.example.com/"), "id")),
        "channel": F.when(kind > 0, room),
        "channel_name": F.when(kind == 1, name),
        "team": F.when(kind > 0, "T1"),
    }
    r = t.thread_records(spark, sf).withColumn("m", F.to_json(F.struct(*(c.alias(n) for n, c in told.items()))))
    listed = r.groupBy("conv_id").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("m")), F.lit("]")).alias("l"))
    around = (F.to_json(F.struct(F.struct(room.alias("id"), name.alias("name")).alias("channel"), F.lit("T1").alias("team"), (2 + F.col("conv_id") % 9).alias("num_members"))))
    wrapped = F.concat(F.expr("left(a, length(a) - 1)"), F.lit(',"messages":'), "l", F.lit("}"))
    raw = listed.withColumn("a", around).select(F.when(kind == 0, wrapped).otherwise(F.col("l")).alias("value"))
    return shown(M.slack_records(M.handed_items(raw), ["slack:T1/assistant"]))


_PASSED = """SELECT id, 'events' AS source, kind, thread, epoch_us(date_trunc('second', ts)) AS ts_us, other AS sender, NULL AS sender_name, 'mailto:owner@example.com|Owner' AS recipients, is_from_me, NULL AS title, 'took ' || duration_s AS text, NULL AS url,
  '{"duration_s":' || duration_s || ',"account":"owner@example.com"}' AS meta FROM records WHERE user_id % 7 <> 0"""


@query("full_record_passthrough", sql("records", _PASSED))
def full_record_passthrough(spark, sf):
    """Finished records pass unchanged but for the account; payloads that lack a text are left to the mappers."""
    r = t.records(spark, sf)
    owner = F.array(F.struct(F.lit(t.OWNER).alias("handle"), F.lit("Owner").alias("name")))
    text = F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("took "), F.col("duration_s").cast("string")))
    meta = F.struct("duration_s", F.lit("other@example.com").alias("account"))
    one = F.to_json(F.struct("id", "source", "kind", "thread", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.struct(F.col("other").alias("handle")).alias("from"), owner.alias("to"), "is_from_me", text.alias("text"), meta.alias("meta")))
    raw = r.select("user_id", one.alias("m")).groupBy("user_id").agg(F.concat_ws("\n", F.collect_list("m")).alias("value"))
    return shown(M.passed_through(M.handed_items(raw), F.lit(ACCOUNT)))


_EXPORT = """said AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM thread_records),
lines AS (SELECT conv_id, turn, role, ts, CASE WHEN s = '' THEN 'and more' ELSE s || chr(10) || 'and more' END AS body, 'room ' || conv_id AS key FROM said),
chats AS (SELECT conv_id, count(DISTINCT role) <> 1 AS grp, string_agg('"name:' || role || '"', ',' ORDER BY first) FILTER (role <> 'assistant') AS people FROM (SELECT conv_id, role, min(turn) AS first FROM lines GROUP BY conv_id, role) GROUP BY conv_id),
keyed AS (SELECT *, key || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') || '|' || role || '|' || body || '|' AS base FROM lines JOIN chats USING (conv_id)),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, base ORDER BY turn) AS n, left(sha1(key), 16) AS digest FROM keyed)"""
_EXPORTED = """SELECT 'whatsapp_export:' || left(sha1(base || '|' || n), 20) AS id, 'whatsapp_export' AS source, 'message' AS kind, 'whatsapp:export:' || digest AS thread, epoch_us(ts) AS ts_us,
  CASE WHEN role = 'assistant' THEN 'mailto:owner@example.com' ELSE 'name:' || role END AS sender, role AS sender_name, CASE WHEN grp THEN 'group:whatsapp_export:' || digest || '|Room ' || conv_id WHEN role = 'assistant' THEN 'name:room ' || conv_id || '|Room ' || conv_id ELSE '' END AS recipients,
  role = 'assistant' AS is_from_me, CASE WHEN grp THEN 'Room ' || conv_id END AS title, body AS text, NULL AS url,
  '{"chat_name":"Room ' || conv_id || '","export_file":"WhatsApp Chat with Room ' || conv_id || '.txt"' || CASE WHEN grp THEN ',"is_group":true,"participants":[' || coalesce(people, '') || ']' ELSE '' END || '}' AS meta FROM counted"""


@query("map_chat_export", sql("thread_records", _EXPORTED, _EXPORT))
def map_chat_export(spark, sf):
    """Conversations as export files, half in each style of heads, messages of two lines."""
    r = t.thread_records(spark, sf)
    clock = F.date_format("ts", "yyyy-MM-dd, HH:mm")
    head = F.when(F.col("conv_id") % 2 == 0, F.concat(clock, F.lit(" - "))).otherwise(F.concat(F.lit("["), F.date_format("ts", "yyyy/MM/dd, hh:mm:ss a"), F.lit("] ")))
    one = F.concat(head, "role", F.lit(": "), F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("\nand more"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("o")))), lambda x: x["o"]), "\n")
    files = r.groupBy("conv_id").agg(whole.alias("value")).select(F.concat(F.lit("WhatsApp Chat with Room "), F.col("conv_id").cast("string"), F.lit(".txt")).alias("file"), "value")
    return shown(C.export_records(files, (t.OWNER, "assistant"), "UTC"))
