"""Meetings from recorded files and from a dictation app: timed captions, speakers, chat and the choice of the best transcript.

A file is a row (folder, name, modified, value). Files are read by patterns and
cut with array expressions; only the runs of one speaker need an order, and
that is a window over one meeting's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import dates as D
from threadloom.functions import handles as H
from threadloom.functions import text as T
from threadloom.sources.handed import get
from threadloom.sources.mappers import PARTY

#: Most characters of a transcript, and of a meeting's chat.
TRANSCRIPT, CHAT = 200_000, 20_000
LINE = "array<struct<speaker:string,text:string,until:double>>"
#: Times of a caption, heads of closed captions and chat lines, names of folders.
CUE = r"^(?:([0-9]+):)?([0-9]{2}):([0-9]{2})[.,]([0-9]{3})\s+-->\s+(?:([0-9]+):)?([0-9]{2}):([0-9]{2})[.,]([0-9]{3})"
CAPTION = r"(?m)^[^\S\n]*\[(.+?)\]\s+[0-9]{1,2}:[0-9]{2}:[0-9]{2}[^\S\n]*$"
CHAT_LINE = r"(?im)^[^\S\n]*[0-9]{1,2}:[0-9]{2}:[0-9]{2}[^\S\n]+From[^\S\n]+(.+?)(?:[^\S\n]+to[^\S\n]+(?:.+?))?[^\S\n]*:[^\S\n]*(.*)$"
FOLDER = r"^([0-9]{4})-([0-9]{2})-([0-9]{2}) ([0-9]{2})\.([0-9]{2})\.([0-9]{2})\s*(.*?)(?:\s+([0-9]{9,12}))?$"


def read_files(spark, path: str) -> DataFrame:
    """Text files under folders as (folder, name, modified, value)."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    parts = F.split(F.regexp_replace("_metadata.file_path", r"^[a-z]+:/*", "/"), "/")
    return files.select(F.url_decode(F.element_at(parts, -2)).alias("folder"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def _lines(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), H.trim_space), lambda x: x != "")


def captions(value: Column) -> Column:
    """Cues of a WebVTT text: speaker (voice tag, or a name before a colon), text, and when they end in seconds."""

    def cue(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: x.rlike(CUE)), True).cast("int")
        head = F.element_at(lines, at)
        part = lambda i: F.regexp_extract(head, CUE, i).try_cast("double")
        until = F.coalesce(part(5), F.lit(0.0)) * 3600 + part(6) * 60 + part(7) + part(8) / 1000
        said = F.array_join(F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))), " ")
        voice, named = r"(?i)^<v\s+([^>]+)>(.*?)(?:</v>)?$", r"^([^:]{1,60}):\s+(.+)$"
        speaker = F.when(said.rlike(voice), F.regexp_extract(said, voice, 1)).when(said.rlike(named), F.regexp_extract(said, named, 1))
        body = F.when(said.rlike(voice), F.regexp_extract(said, voice, 2)).when(said.rlike(named), F.regexp_extract(said, named, 2)).otherwise(said)
        return F.struct(F.nullif(H.trim_space(speaker), F.lit("")).alias("speaker"), H.trim_space(F.regexp_replace(body, "<[^>]+>", "")).alias("text"), until.alias("until"))

    blocks = F.transform(F.split(F.regexp_replace(value, r"\r\n?", "\n"), r"\n{2,}"), _lines)
    timed = F.filter(blocks, lambda lines: F.exists(lines, lambda x: x.rlike(CUE)))
    return F.filter(F.transform(timed, cue), lambda c: c["text"] != "").cast(LINE)


def _headed(value: Column, head: str, make) -> Column:
    """Cuts a text at its head lines; ``make`` gets a head's line number and the text behind it."""
    plain = F.regexp_replace(value, r"\r\n?", "\n")
    bodies = F.split(plain, head, -1)
    return F.transform(F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))), make)


def closed_captions(value: Column) -> Column:
    """Lines of closed captions: a head with the speaker, then what they said."""
    heads = F.regexp_extract_all(F.regexp_replace(value, r"\r\n?", "\n"), F.lit(CAPTION), F.lit(1))
    made = _headed(value, CAPTION, lambda body, i: F.struct(H.trim_space(F.get(heads, i)).alias("speaker"), F.array_join(_lines(body), " ").alias("text"), F.lit(None).cast("double").alias("until")))
    return F.filter(made, lambda c: c["text"] != "").cast(LINE)


def chat_lines(value: Column) -> Column:
    """Messages of a saved chat; lines without a head go on with the message before."""
    plain = F.regexp_replace(value, r"\r\n?", "\n")
    senders, firsts = (F.regexp_extract_all(plain, F.lit(CHAT_LINE), F.lit(i)) for i in (1, 2))

    def message(body: Column, i: Column) -> Column:
        said = F.filter(F.concat(F.array(H.trim_space(F.get(firsts, i))), _lines(body)), lambda x: x != "")
        return F.struct(H.trim_space(F.regexp_replace(F.get(senders, i), r"\s+", " ")).alias("speaker"), F.array_join(said, "\n").alias("text"), F.lit(None).cast("double").alias("until"))

    return F.filter(_headed(value, CHAT_LINE, message), lambda c: c["text"] != "").cast(LINE)


def turns(lines: DataFrame, key: str) -> DataFrame:
    """``(key, text)`` of lines (key, n, speaker, text): consecutive lines of one speaker are one turn, a turn a line."""
    by = Window.partitionBy(key).orderBy("n")
    new = ~F.lag("speaker").over(by).eqNullSafe(F.col("speaker")) | (F.row_number().over(by) == 1)
    runs = lines.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(by))
    joined = lambda order, text, sign: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), sign)
    said = runs.groupBy(key, "_run").agg(F.first("speaker").alias("speaker"), joined("n", "text", " ").alias("said"))
    spoken = said.withColumn("turn", F.when(F.col("speaker").isNotNull(), F.concat("speaker", F.lit(": "), "said")).otherwise(F.col("said")))
    return spoken.groupBy(key).agg(joined("_run", "turn", "\n").alias("text"))


def _people(names: Column, owner: str) -> Column:
    """Distinct names in order, without the owner and numbered speakers."""
    other = F.filter(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != ""))), lambda n: (F.lower(n) != owner.strip().lower()) & ~n.rlike(r"(?i)^speaker [0-9]+$"))
    return F.transform(other, lambda n: F.struct(H.name_handle(n).alias("handle"), n.alias("name"))).cast(f"array<{PARTY}>")


def _record(df: DataFrame, source: str, key: Column, **columns: Column) -> DataFrame:
    base = {"id": F.concat(F.lit(f"{source}:"), key), "source": F.lit(source), "kind": F.lit("meeting"), "thread": F.concat(F.lit(f"meeting:{source}:"), key), "sender": F.lit(None).cast(PARTY), "is_from_me": F.lit(False), "url": F.lit(None).cast("string")} | columns
    return df.select(*(base[c].alias(c) for c in "id source kind thread ts sender recipients is_from_me title text url meta".split())).where("ts is not null")


def zoom_records(files: DataFrame, owner: str, zone: str, prior: DataFrame | None = None) -> DataFrame:
    """One meeting a folder. Its transcript is the first of its timed captions, closed captions, what an earlier run had, none.

    A recording without a transcript waits for one (``needs_transcript``);
    folders with neither text, chat nor recording give no row. ``prior`` is
    (id, text, transcript_source) of stored records.
    """
    name = F.lower("name")
    kind = F.when(name.endswith(".vtt"), "vtt").when(name.rlike(r"^closed_caption.*\.txt$"), "cc").when(name.rlike(r"^(meeting_saved.*chat.*|chat)\.txt$"), "chat").when(name.rlike(r"\.(m4a|mp4)$"), "media")
    kinds = files.where(~F.col("name").startswith(".")).withColumn("kind", kind)
    first = kinds.groupBy("folder").agg(F.max("modified").alias("modified"), *(F.min_by(F.col("value"), F.when(F.col("kind") == k, F.col("name"))).alias(k) for k in ("vtt", "cc", "chat")), F.max(F.col("kind") == "media").alias("media"), *(F.max((F.col("kind") == k).cast("int")).alias(f"has_{k}") for k in ("vtt", "cc")))
    source = F.when(F.col("has_vtt") == 1, "zoom").when(F.col("has_cc") == 1, "zoom_captions")
    lines = F.when(source == "zoom", captions(F.col("vtt"))).when(source == "zoom_captions", closed_captions(F.col("cc")))
    parsed = first.select("folder", "modified", F.coalesce("media", F.lit(False)).alias("media"), source.alias("found"), F.coalesce(lines, F.array().cast(LINE)).alias("lines"), F.coalesce(chat_lines(F.col("chat")), F.array().cast(LINE)).alias("said"))
    spoken = turns(parsed.select("folder", F.posexplode("lines").alias("n", "line")).select("folder", "n", "line.speaker", "line.text"), "folder")
    key = F.substring(F.sha1("folder"), 1, 16)
    both = parsed.join(spoken, "folder", "left").withColumn("id", F.concat(F.lit("zoom_local:"), key))
    held = (prior.select("id", F.col("text").alias("old"), F.col("transcript_source").alias("old_source")) if prior is not None else both.select("id", F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("old_source")).limit(0)).where("coalesce(old, '') <> '' and old_source is not null")
    known = both.join(held, "id", "left").withColumn("own", F.nullif(F.col("text"), F.lit("")))
    at = F.regexp_extract
    stamp = F.concat_ws(" ", F.concat_ws("-", *(at("folder", FOLDER, i) for i in (1, 2, 3))), F.concat_ws(":", *(at("folder", FOLDER, i) for i in (4, 5, 6))))
    told = known.withColumns({"named": F.col("folder").rlike(FOLDER), "text": F.coalesce("own", "old", F.lit(""))}).withColumn("waits", (F.col("text") == "") & F.col("media"))
    chat = F.array_join(F.transform("said", lambda c: F.concat(c["speaker"], F.lit(": "), c["text"])), "\n")
    meta = F.to_json(
        F.struct(
            F.col("folder").alias("item_id"),
            F.col("folder"),
            F.nullif(F.when(F.col("named"), at("folder", FOLDER, 8)), F.lit("")).alias("meeting_id"),
            F.when(F.col("own").isNotNull(), F.col("found")).otherwise(F.col("old_source")).alias("transcript_source"),
            F.when((F.col("found") == "zoom") & (F.size("lines") > 0), F.round(F.element_at("lines", -1)["until"]).cast("bigint")).alias("duration_s"),
            F.when(F.col("waits"), F.lit(True)).alias("needs_transcript"),
            F.when(F.size("said") > 0, F.left(chat, F.lit(CHAT))).alias("chat"),
        )
    )
    told = told.where((F.col("text") != "") | (F.size("said") > 0) | F.col("waits"))
    speakers = F.concat(F.transform("lines", lambda c: c["speaker"]), F.transform("said", lambda c: c["speaker"]))
    return _record(
        told,
        "zoom_local",
        key,
        ts=F.when(F.col("named"), F.to_utc_timestamp(F.try_to_timestamp(stamp), zone)).otherwise(F.col("modified")),
        recipients=_people(speakers, owner),
        title=F.coalesce(F.nullif(F.trim(F.when(F.col("named"), at("folder", FOLDER, 7))), F.lit("")), F.col("folder")),
        text=F.left(T.clean_text(F.col("text")), F.lit(TRANSCRIPT)),
        meta=meta,
    )


def _named(c: Column) -> Column:
    """Names from a JSON list of names or objects, or from a plain list in a text."""
    v = F.try_parse_json(c)
    listed = F.transform(get(v, "$", "array<variant>"), lambda x: F.coalesce(get(x, "$.name"), get(x, "$.displayName"), F.when(F.schema_of_variant(x) == "STRING", get(x, "$"))))
    return F.filter(F.transform(F.coalesce(listed, F.split(c, r"[,;\n]"), F.array().cast("array<string>")), lambda n: F.trim(n)), lambda n: F.coalesce(n, F.lit("")) != "")


def _speaker_map(c: Column) -> Column:
    """Names by speaker from a JSON object of names or objects, or a list of objects with ids."""
    v = F.try_parse_json(c)
    label = lambda x: F.coalesce(get(x, "$.name"), get(x, "$.label"), F.when(F.schema_of_variant(x) == "STRING", get(x, "$")))
    entry = "array<struct<key:string,value:string>>"
    listed = F.transform(get(v, "$", "array<variant>"), lambda x: F.struct(F.coalesce(get(x, "$.id"), get(x, "$.speaker"), get(x, "$.key")).alias("key"), label(x).alias("value"))).cast(entry)
    mapped = F.transform(F.map_entries(get(v, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), label(e["value"]).alias("value"))).cast(entry)
    every = F.filter(F.coalesce(listed, mapped, F.array().cast(entry)), lambda e: e["key"].isNotNull() & (F.coalesce(e["value"], F.lit("")) != ""))
    return F.filter(every, lambda e, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda later: later["key"] == e["key"]))


def dictation_meetings(meetings: DataFrame, files: DataFrame, owner: str) -> DataFrame:
    """Meetings of a dictation app: (id, title, created, modified, ended, participants, notes, summary, speaker_map, calendar_id, transcript, deleted).

    The lines come from the first file of the meeting's folder that holds any
    (``refined.ndjson`` before the others by name), else from ``transcript``, a
    JSON list or a plain text. Speakers are named by the map, numbers as
    ``Speaker n``, else as they are.
    """
    row = "struct<speaker:string,speakerId:string,text:string,content:string>"
    parsed = files.where(F.col("name").endswith(".ndjson")).select(
        F.col("folder").alias("id"), "name", F.filter(F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, row))), lambda r: r.isNotNull()).alias("rows")
    )
    best = parsed.where(F.size("rows") > 0).groupBy("id").agg(F.min_by("rows", F.struct(F.col("name") != "refined.ndjson", "name")).alias("filed"))
    m = meetings.where(~F.coalesce("deleted", F.lit(False))).withColumn("id", F.col("id").cast("string")).join(best, "id", "left")
    inline = F.when(F.try_parse_json("transcript").isNotNull() & get(F.try_parse_json("transcript"), "$", "array<variant>").isNotNull(), F.from_json("transcript", f"array<{row}>"))
    plain = F.when(F.trim("transcript") != "", F.array(F.struct(F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("speakerId"), F.col("transcript").alias("text"), F.lit(None).cast("string").alias("content"))))
    told = m.withColumns({"_rows": F.coalesce("filed", inline, plain, F.array().cast(f"array<{row}>")), "_map": _speaker_map(F.col("speaker_map")), "_ts": F.coalesce(D.loose_date(F.col("created")), D.loose_date(F.col("modified"))), "_end": D.loose_date(F.col("ended"))})
    lines = told.select("id", "_map", F.posexplode("_rows").alias("n", "r")).withColumn("raw", F.coalesce("r.speaker", "r.speakerId"))
    mapped = F.try_element_at(F.filter("_map", lambda e: e["key"] == F.col("raw")), F.lit(1))["value"]
    number = F.nullif(F.regexp_extract("raw", r"(?i)^(?:speaker[_ ]?)?([0-9]+)$", 1), F.lit(""))
    who = F.coalesce(mapped, F.concat(F.lit("Speaker "), number), F.col("raw"))
    said = lines.select("id", "n", who.alias("speaker"), T.clean_text(F.coalesce("r.text", "r.content", F.lit(""))).alias("text")).where("text <> ''")
    spoken = turns(said, "id")
    values = F.transform("_map", lambda e: e["value"])
    full = told.join(spoken, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    meta = F.to_json(
        F.struct(
            F.col("id").alias("item_id"),
            T.clean_text(F.nullif(F.col("summary"), F.lit(""))).alias("summary"),
            T.clean_text(F.nullif(F.col("notes"), F.lit(""))).alias("notes"),
            F.when(F.col("_end").isNotNull(), F.greatest(F.round((F.unix_millis("_end") - F.unix_millis("_ts")) / 1000).cast("bigint"), F.lit(0))).alias("duration_s"),
            F.nullif(F.col("calendar_id").cast("string"), F.lit("")).alias("calendar_event_id"),
            F.when(F.size("_map") > 0, values).alias("speakers"),
            F.when(F.col("text") == "", F.lit(True)).alias("needs_transcript"),
        )
    )
    people = F.filter(F.array_distinct(F.concat(_named(F.col("participants")), values)), lambda n: F.lower(n) != owner.strip().lower())
    return _record(
        full,
        "wispr",
        F.col("id"),
        ts=F.col("_ts"),
        recipients=F.transform(people, lambda n: F.struct(H.name_handle(n).alias("handle"), n.alias("name"))).cast(f"array<{PARTY}>"),
        title=F.nullif(H.trim_space(F.col("title")), F.lit("")),
        text=F.left("text", F.lit(TRANSCRIPT)),
        meta=meta,
    )


def dictations(history: DataFrame, owner: tuple[str, str]) -> DataFrame:
    """Dictations (id, asr, formatted, edited, at, app, url, duration, words): what was edited, else formatted, else heard."""
    filled = [F.nullif(F.col(c), F.lit("")) for c in ("edited", "formatted", "asr")]
    text = T.clean_text(F.coalesce(*filled, F.lit("")))
    meta = F.to_json(F.struct(F.col("id").cast("string").alias("item_id"), F.nullif("app", F.lit("")).alias("app"), F.nullif("url", F.lit("")).alias("url"), F.round("duration").cast("bigint").alias("duration_s"), F.col("words")))
    df = history.withColumns({"_text": text, "_ts": D.loose_date(F.col("at"))}).where("_text <> ''")
    return _record(df, "wispr", F.concat(F.lit("h:"), F.col("id").cast("string")), kind=F.lit("dictation"), thread=F.lit(None).cast("string"), ts=F.col("_ts"), sender=F.struct(F.lit(owner[0]).alias("handle"), F.lit(owner[1]).alias("name")).cast(PARTY), recipients=F.array().cast(f"array<{PARTY}>"), is_from_me=F.lit(True), title=F.lit(None).cast("string"), text=F.col("_text"), meta=meta)
