"""Exported chats: a text file a chat, in either of two header styles, to full records.

A file is one row; its entries are cut out by patterns and all that holds for
the whole file (order of the date's parts, the owner's name, group or not, who
takes part) is worked out on arrays inside the row, before its messages become
rows. Only repeated messages need a count, and that is by message.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import handles as H
from threadloom.functions import text as T
from threadloom.sources.mappers import PARTY
from threadloom.storage import materialize

# Marks of direction, what clients write for media, for deleted and edited messages, for the owner, and how they name files.
_MARKS = "‎‏‪-‮⁦-⁩﻿"
MEDIA = [
    (r"<(?:media omitted|multimedia omitido|medios omitidos|m[ií]dia oculta)>", "media"),
    (r"(?:image|photo|imagen|foto) omitid[oa]|image omitted", "image"),
    (r"(?:video|v[ií]deo) omit(?:ted|ido)", "video"),
    (r"audio omit(?:ted|ido)", "audio"),
    (r"sticker omit(?:ted|ido)", "sticker"),
    (r"GIF omit(?:ted|ido)", "gif"),
    (r"(?:document|documento) omit(?:ted|ido)|.+ • [0-9]+ (?:pages|páginas).*omit.*", "document"),
    (r"(?:contact card|tarjeta de contacto) omitid[ao]|contact card omitted", "contact"),
]
ATTACHED = r"(?i)^<(?:attached|adjunto): ([^>]+)>$|^(\S.*?\.[A-Za-z0-9]{2,5}) \((?:file attached|archivo adjunto)\)$"
DELETED = r"(?i)^(?:this message was deleted|you deleted this message|se elimin[oó] este mensaje|eliminaste este mensaje|este mensaje fue eliminado|null)\.?$"
EDITED = r"(?i)\s*<(?:this message was edited|se edit[oó] este mensaje)\.?>\s*$"
ME = ["you", "tu", "yo", "voce"]
FILE_NAMES = r"(?i)^(?:WhatsApp Chat (?:with|-)|Chat de WhatsApp (?:con|-)|Conversa do WhatsApp com|Conversa do WhatsApp -|Discussion WhatsApp avec)\s*"
_TIME = r"([0-9]{1,4})[./-]([0-9]{1,2})[./-]([0-9]{1,4}),?[^\S\n]+([0-9]{1,2})[:.]([0-9]{2})(?:[:.]([0-9]{2}))?[^\S\n]*([aApP]\.?[^\S\n]?[mM]\.?)?"
HEADS = {"bracket": rf"(?m)^[{_MARKS}]*\[{_TIME}\][^\S\n]+(.*)$", "dash": rf"(?m)^[{_MARKS}]*{_TIME}[^\S\n]+[-–][^\S\n]+(.*)$"}
ENTRY = "array<struct<p:array<string>,hour:int,minute:int,second:int,half:string,rest:string,body:string>>"


def _fold(c: Column) -> Column:
    """Names and texts as they are compared: no accents, lower case, letters, digits and plus signs."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(T.fold_accents(c)), "[^a-z0-9+ ]", " "), r"\s+", " "))


def entries(value: Column) -> Column:
    """Entries of an export, in order: date parts, clock, the rest of the head line and what follows it. The first head's style is the file's."""
    text = F.translate(F.regexp_replace(F.regexp_replace(value, "^﻿", ""), r"\r\n?", "\n"), "  ", "  ")
    places = [F.coalesce(F.nullif(F.regexp_instr(text, F.lit(h)), F.lit(0)), F.lit(2**31 - 1)) for h in HEADS.values()]
    style = F.when(places[0] <= places[1], HEADS["bracket"]).otherwise(HEADS["dash"])

    def cut(x: Column) -> Column:
        heads = [F.regexp_extract_all(x["text"], x["style"], F.lit(i)) for i in range(1, 9)]
        bodies = F.split(x["text"], x["style"], -1)
        at = lambda k, i: F.get(heads[k], i)
        number = lambda k, i: F.coalesce(at(k, i).try_cast("int"), F.lit(0))
        return F.transform(heads[0], lambda _, i: F.struct(F.array(at(0, i), at(1, i), at(2, i)).alias("p"), number(3, i).alias("hour"), number(4, i).alias("minute"), number(5, i).alias("second"), F.nullif(at(6, i), F.lit("")).alias("half"), at(7, i).alias("rest"), F.get(bodies, i + 1).alias("body"))).cast(ENTRY)

    return H.let(F.struct(text.alias("text"), style.alias("style")), cut)


def date_order(found: Column) -> Column:
    """ymd, dmy or mdy for a whole file: by a four-digit first part, by parts over twelve, by the reading that goes back in time less often, by the one that spans less, by the spelling of the half day."""
    part = lambda e, i: F.get(e["p"], F.lit(i)).cast("int")
    big = lambda i: F.exists(found, lambda e: part(e, i) > 12)

    def days(d: int, m: int) -> Column:
        year = lambda e: F.when(part(e, 2) < 100, part(e, 2) + 2000).otherwise(part(e, 2))
        # months over twelve run on into the next years, as a calendar's arithmetic has it
        return F.transform(found, lambda e: F.datediff(F.add_months(F.make_date(year(e), F.lit(1), F.lit(1)), part(e, m) - 1), F.lit("1970-01-01").cast("date")) + part(e, d))

    def steps(list_: Column) -> Column:
        return F.transform(F.slice(list_, F.lit(2), F.greatest(F.size(list_) - 1, F.lit(0))), lambda v, i: v - F.get(list_, i))

    def judged(x: Column) -> Column:
        back = lambda c: F.size(F.filter(c, lambda v: v < 0))
        span = lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + F.abs(v))
        half = F.try_element_at(F.filter(F.transform(found, lambda e: e["half"]), lambda h: h.isNotNull()), F.lit(1))
        return F.when(back(x["dmy"]) != back(x["mdy"]), F.when(back(x["dmy"]) < back(x["mdy"]), "dmy").otherwise("mdy")).when(span(x["dmy"]) != span(x["mdy"]), F.when(span(x["dmy"]) < span(x["mdy"]), "dmy").otherwise("mdy")).when(half.rlike("^[AP]M$"), "mdy").otherwise("dmy")

    by_time = H.let(F.struct(steps(days(0, 1)).alias("dmy"), steps(days(1, 0)).alias("mdy")), judged)
    return F.when(F.exists(found, lambda e: F.length(F.get(e["p"], F.lit(0))) == 4), "ymd").when(big(0) & ~big(1), "dmy").when(big(1) & ~big(0), "mdy").otherwise(by_time)


def _message(e: Column, order: Column, zone: str) -> Column:
    """One entry as (ts, sender, text, media, attachment, edited); what is no message has no sender."""
    part = lambda i: F.get(e["p"], F.lit(i)).cast("int")
    pick = lambda ymd, dmy, mdy: F.when(order == "ymd", part(ymd)).when(order == "dmy", part(dmy)).otherwise(part(mdy))
    year, month, day = pick(0, 2, 2), pick(1, 1, 0), pick(2, 0, 1)
    pm = e["half"].rlike("^[pP]")
    hour = F.when(pm & (e["hour"] < 12), e["hour"] + 12).when(e["half"].isNotNull() & ~pm & (e["hour"] == 12), 0).otherwise(e["hour"])
    local = F.try_make_timestamp(F.when(year < 100, year + 2000).otherwise(year), month, day, hour, e["minute"], e["second"].cast("decimal(8,6)"))
    bare = lambda c: F.regexp_replace(c, f"[{_MARKS}]", "")

    def split(colon: Column) -> Column:
        inside = colon.between(2, 80)
        said = F.when(inside, F.substr(e["rest"], colon + 2))
        sender = F.when(inside, F.trim(F.regexp_replace(bare(F.substr(e["rest"], F.lit(1), colon - 1)), r"^~\s*", "")))
        return F.struct(sender.alias("sender"), said.rlike("^[‎‏]").alias("marked"), H.trim_space(bare(F.concat(said, F.regexp_replace(e["body"], r"\n$", "")))).alias("whole"))

    def freed(x: Column) -> Column:
        return F.struct(x["sender"].alias("sender"), x["marked"].alias("marked"), x["whole"].alias("whole"), F.regexp_replace(x["whole"], EDITED, "").alias("body"))

    def kinds(x: Column) -> Column:
        kind = F.lit(None).cast("string")
        for pattern, name in reversed(MEDIA):
            kind = F.when(x["body"].rlike(f"(?i)^(?:{pattern})$"), name).otherwise(kind)
        named = F.coalesce(F.nullif(F.regexp_extract(x["body"], ATTACHED, 1), F.lit("")), F.nullif(F.regexp_extract(x["body"], ATTACHED, 2), F.lit("")))
        return F.struct(x.alias("x"), kind.alias("kind"), named.alias("file"), local.alias("local"))

    def made(y: Column) -> Column:
        x, media = y["x"], F.coalesce(y["kind"], F.when(y["file"].isNotNull(), "attachment"))
        good = F.coalesce((x["sender"] != "") & y["local"].isNotNull() & ~x["body"].rlike(DELETED) & ~(x["marked"] & media.isNull()), F.lit(False))
        return F.struct(F.to_utc_timestamp(y["local"], zone).alias("ts"), F.when(good, x["sender"]).alias("sender"), F.when(media.isNull(), x["body"]).otherwise("").alias("text"), media.alias("media"), y["file"].alias("attachment"), (x["whole"] != x["body"]).alias("edited"))

    return H.let(H.let(H.let(H.let(F.instr(e["rest"], ": "), split), freed), kinds), made)


def chat_name(file: Column) -> Column:
    """``WhatsApp Chat with Ana (1).txt`` is the chat with Ana."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(file, r"\.[^.]*$", ""), r"\s*\([0-9]+\)$", ""), FILE_NAMES, "")
    return F.coalesce(F.nullif(F.trim(stem), F.lit("")), F.lit("WhatsApp chat"))


def export_records(files: DataFrame, owner: tuple[str, str], zone: str, native: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Records of kind message from files (file, value).

    The owner is who bears their name or a word for oneself, or in a chat of
    two the one whom the file isn't named after. Chats that are known already,
    ``native`` (name, thread, is_group, jid), lend their thread, and messages
    of the same minute and text in ``stored`` (thread, ts, text) are left out.
    A file without entries gives no rows.
    """
    spark = files.sparkSession
    native = native if native is not None else spark.createDataFrame([], "name string, thread string, is_group boolean, jid string")
    known = native.select(_fold(F.col("name")).alias("key"), F.struct("thread", "is_group", "jid").alias("known")).groupBy("key").agg(F.min("known").alias("known"))
    cut = materialize(files.select("file", entries(F.col("value")).alias("found")), "chat-entries")
    parsed = cut.withColumn("order", date_order(F.col("found")))
    told = parsed.select("file", F.filter(F.transform("found", lambda e: _message(e, F.col("order"), zone)), lambda m: m["sender"].isNotNull()).alias("messages"))
    told = materialize(told, "chat-messages")  # files are cut and read once, and the plan stays short
    chat = chat_name(F.col("file"))
    chats = told.withColumn("chat", chat).withColumns({"key": _fold(F.col("chat")), "senders": F.array_distinct(F.transform("messages", lambda m: m["sender"]))}).withColumn("folded", F.transform("senders", _fold)).join(known, "key", "left")

    own = "".join(x if x.isascii() and (x.isalnum() or x == "+") else " " for x in "".join(x for x in unicodedata.normalize("NFKD", owner[1]).lower() if not "\u0300" <= x <= "\u036f"))
    own = " ".join(own.split())
    at = lambda i: F.get("folded", i)
    first = lambda f: F.try_element_at(F.filter("senders", lambda s, i: f(at(i))), F.lit(1))
    named = F.array_contains("folded", F.col("key"))
    me = F.coalesce(first(lambda n: n.isin([*ME, *([own] if own else [])])), F.when((F.size("senders") == 2) & named, first(lambda n: n != F.col("key"))))
    people = F.filter("senders", lambda s: ~s.eqNullSafe(F.col("me")))
    group = F.coalesce(F.col("known.is_group"), (F.size(people) > 1) | ((F.size("senders") > 0) & ~named & (F.size("senders") != 1)))
    digest = F.substring(F.sha1("key"), 1, 16)
    phone = lambda s: F.when(s.rlike(r"^\+?[0-9\s().-]{8,}$"), H.phone_handle(F.when(s.startswith("+"), s).otherwise(F.concat(F.lit("+"), s))))
    partner = F.when(~group, H.phone_handle(F.concat(F.lit("+"), F.nullif(F.regexp_extract("known.jid", r"^([0-9]{6,15})@s\.whatsapp\.net$", 1), F.lit("")))))
    whole = chats.withColumn("me", me).withColumns(
        {
            "group": group,
            "partner": partner,
            "thread": F.coalesce("known.thread", F.concat(F.lit("whatsapp:export:"), digest)),
            "room": F.when(F.col("known").isNotNull(), H.group_handle(F.lit("whatsapp"), F.regexp_replace("known.thread", "^whatsapp:", ""))).otherwise(H.group_handle(F.lit("whatsapp_export"), digest)),
            "participants": F.when(group, F.array_distinct(F.filter(F.transform(people, lambda s: F.coalesce(phone(s), H.name_handle(s))), lambda h: h.isNotNull()))),
        }
    )
    rows = whole.select("file", "chat", "key", "me", "group", "partner", "thread", "room", "participants", F.posexplode("messages").alias("at", "m")).select("*", "m.*")
    if stored is not None:
        minute = lambda ts: F.date_format(ts, "yyyy-MM-dd HH:mm")
        held = stored.select("thread", minute(F.col("ts")).alias("minute"), _fold(F.coalesce("text", F.lit(""))).alias("said")).distinct()
        rows = rows.withColumns({"minute": minute(F.col("ts")), "said": _fold(F.col("text"))}).join(held, ["thread", "minute", "said"], "left_anti")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    base = F.concat_ws("|", "key", iso, "sender", "text", F.coalesce("attachment", F.lit("")))
    counted = rows.withColumn("base", base).withColumn("n", F.row_number().over(Window.partitionBy("file", "base").orderBy("at")))
    mine, number = F.col("sender").eqNullSafe(F.col("me")), phone(F.col("sender"))
    party = lambda handle, name: F.struct(handle.alias("handle"), name.alias("name")).cast(PARTY)
    told_by = F.when(mine, party(F.lit(owner[0]), F.lit(owner[1]))).otherwise(party(F.coalesce(number, F.when(~F.col("group"), F.col("partner")), H.name_handle(F.col("sender"))), F.when(number.isNull(), F.col("sender"))))
    to = F.when(F.col("group"), F.array(party(F.col("room"), F.col("chat")))).when(mine, F.array(party(F.coalesce("partner", H.name_handle(F.col("chat"))), F.col("chat")))).otherwise(F.array().cast(f"array<{PARTY}>"))
    meta = F.to_json(
        F.struct(
            F.col("chat").alias("chat_name"),
            F.col("file").alias("export_file"),
            F.when(F.col("group"), F.lit(True)).alias("is_group"),
            F.col("participants"),
            F.col("media"),
            F.when(F.col("attachment").isNotNull(), F.array(F.struct(F.col("attachment").alias("filename")))).alias("attachments"),
            F.when(F.col("edited"), F.lit(True)).alias("edited"),
        )
    )
    return counted.select(
        F.concat(F.lit("whatsapp_export:"), F.substring(F.sha1(F.concat("base", F.lit("|"), F.col("n").cast("string"))), 1, 20)).alias("id"),
        F.lit("whatsapp_export").alias("source"),
        F.lit("message").alias("kind"),
        "thread",
        "ts",
        told_by.alias("sender"),
        to.alias("recipients"),
        F.coalesce(mine & F.col("me").isNotNull(), F.lit(False)).alias("is_from_me"),
        F.when(F.col("group"), F.col("chat")).alias("title"),
        T.clean_text(F.col("text")).alias("text"),
        F.lit(None).cast("string").alias("url"),
        meta.alias("meta"),
    )
