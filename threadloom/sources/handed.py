"""Payloads handed over as JSON texts: mail, chat channels, recorders and finished records.

Texts are parsed once to variants, so a payload may have any shape and depth;
each mapper gives the columns of ``RECORD``. A mail's body is found in one pass
inside its row, however deep its parts are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import dates as D
from threadloom.functions import handles as H
from threadloom.functions import text as T
from threadloom.sources.mappers import LISTS, PARTY

RECORD = "id source kind thread ts sender recipients is_from_me title text url meta".split()
#: Entities that mail bodies are freed of, in this order.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
MAIL_LINK = "https://mail.google.com/mail/u/0/#all/"


def get(v: Column, path: str, kind: str = "string") -> Column:
    """A field of a variant, null where it is missing or of another kind."""
    return F.try_variant_get(v, path, kind)


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(get(v, path, "variant")).startswith(kind), F.lit(False))


def handed_items(raw: DataFrame, column: str = "value") -> DataFrame:
    """``(item, context)`` variants of JSON texts: an array, an object with one list among ``LISTS``, a single object, or one object a line.

    ``context`` is the object around a list. Texts and lines that are no JSON
    give no rows; other columns of ``raw`` stay.
    """
    text = F.trim(F.col(column))
    alone = get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")  # the parser stops after a first value: several are no single text
    whole = F.when(F.size(alone) == 1, alone[0])
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.try_parse_json(x))
    listed = F.coalesce(*(get(F.col("_v"), f"$.{name}", "array<variant>") for name in LISTS))
    top = F.coalesce(get(F.col("_v"), "$", "array<variant>"), listed, F.when(F.col("_v").isNotNull(), F.array("_v")), F.col("_lines"))
    parsed = raw.withColumn("_v", whole).withColumn("_lines", F.when(whole.isNull(), lines))
    around = F.when(get(F.col("_v"), "$", "array<variant>").isNull() & listed.isNotNull(), F.col("_v"))
    return parsed.select(*(c for c in raw.columns if c != column), around.alias("context"), F.explode(top).alias("item")).where("item is not null")


def is_record(item: Column) -> Column:
    """Whether an item already is a record: source, kind, time and text are there as texts."""
    return _is(item, "$.source", "STRING") & _is(item, "$.kind", "STRING") & _is(item, "$.ts", "STRING") & _is(item, "$.text", "STRING")


def _party(v: Column) -> Column:
    return F.when(v.isNotNull(), F.struct(get(v, "$.handle").alias("handle"), get(v, "$.name").alias("name"))).cast(PARTY)


def merged(first: Column, second: Column) -> Column:
    """Two JSON objects as one; where both name a key, the second counts."""
    a, b = (F.from_json(F.coalesce(m, F.lit("{}")), "map<string,variant>") for m in (first, second))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def _json(**fields: Column) -> Column:
    """An object of the fields that are not null."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def passed_through(items: DataFrame, account: Column | None = None) -> DataFrame:
    """Items that are records, as they are; the account they came with is noted in ``meta``."""
    item = F.col("item")
    return items.where(is_record(item)).select(
        get(item, "$.id").alias("id"),
        get(item, "$.source").alias("source"),
        get(item, "$.kind").alias("kind"),
        get(item, "$.thread").alias("thread"),
        F.try_to_timestamp(get(item, "$.ts")).alias("ts"),
        _party(get(item, "$.from", "variant")).alias("sender"),
        F.coalesce(get(item, "$.to", f"array<{PARTY}>"), F.array().cast(f"array<{PARTY}>")).alias("recipients"),
        F.coalesce(get(item, "$.is_from_me", "boolean"), F.lit(False)).alias("is_from_me"),
        get(item, "$.title").alias("title"),
        get(item, "$.text").alias("text"),
        get(item, "$.url").alias("url"),
        merged(F.to_json(get(item, "$.meta", "variant")), _json(account=F.lit(None).cast("string") if account is None else account)).alias("meta"),
    )


def mail_html(c: Column) -> Column:
    """Text of an HTML mail body: styles and scripts go, tags become spaces, a few entities are read, white space is narrowed."""
    for pattern, put in ((r"(?is)<style.*?</style>|<script.*?</script>", ""), (r"<[^>]+>", " ")):
        c = F.regexp_replace(c, pattern, put)
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return H.trim_space(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n\s+", "\n"))


def _decoded(data: Column) -> Column:
    return F.make_valid_utf8(F.unbase64(F.translate(data, "-_", "+/")).cast("string"))


def mail_body(payload: Column) -> Column:
    """Text of a tree of mail parts (a variant), null if no part has any.

    Among the children of a part its first plain text counts before its first
    HTML, these before what lies deeper (in page order), and all before data
    of the part itself. Every part gets the path of these choices as a key, the
    tree is opened level by level inside the row, as often as it may be deep,
    and the smallest key wins. Attachments hold no data and don't count.
    """
    texts = ("text/plain", "text/html")
    node, key = "struct<at:string,part:variant>", "struct<at:string,mime:string,data:string>"
    data = lambda n: F.nullif(get(n["part"], "$.body.data"), F.lit(""))
    mime = lambda v: F.coalesce(get(v, "$.mimeType"), F.lit(""))
    ends = lambda n: data(n).isNotNull() & mime(n["part"]).isin(*texts)

    def children(n: Column) -> Column:
        parts = F.coalesce(get(n["part"], "$.parts", "array<variant>"), F.array().cast("array<variant>"))
        kinds = F.transform(parts, mime)
        plain, html = (F.array_position(kinds, t) for t in texts)
        rank = lambda i: F.when(i + 1 == plain, "0").when(i + 1 == html, "1").otherwise("2")
        return F.transform(parts, lambda p, i: F.struct(F.concat(n["at"], rank(i), F.lpad(i.cast("string"), 6, "0")).alias("at"), p.alias("part")))

    def open_level(acc: Column, _: Column) -> Column:
        told = F.transform(F.filter(acc["open"], lambda n: data(n).isNotNull()), lambda n: F.struct(F.concat(n["at"], F.when(ends(n), "").otherwise("3")).alias("at"), mime(n["part"]).alias("mime"), data(n).alias("data")))
        deeper = F.flatten(F.transform(F.filter(acc["open"], lambda n: ~ends(n)), children))
        return F.struct(deeper.cast(f"array<{node}>").alias("open"), F.concat(acc["found"], told.cast(f"array<{key}>")).alias("found"))

    start = F.struct(F.array(F.struct(F.lit("").alias("at"), payload.alias("part"))).cast(f"array<{node}>").alias("open"), F.array().cast(f"array<{key}>").alias("found"))
    depth = F.regexp_count(F.to_json(payload), F.lit('"parts"')) + 1  # no tree is deeper than it has lists of parts
    found = F.aggregate(F.sequence(F.lit(1), depth), start, open_level)["found"]
    read = F.transform(F.array_sort(found), lambda f: F.when(f["mime"] == "text/html", mail_html(_decoded(f["data"]))).otherwise(_decoded(f["data"])))
    return F.try_element_at(F.filter(read, lambda t: t != ""), F.lit(1))


def _mail_time(text: Column) -> Column:
    """ISO times, and dates as mail headers write them."""
    plain = F.regexp_replace(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*|\s*\([^)]*\)\s*$", ""), r"(GMT|UT|Z)$", "+0000")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")))


def gmail_records(items: DataFrame, owners: list[str], account: Column | None = None) -> DataFrame:
    """Mail resources (headers, tree of parts) and flat search results as records of kind email.

    Without ``internalDate`` the Date header gives the time; an item without
    any readable time gives no row. An item without an id is named by its
    thread and time.
    """
    item = F.col("item")
    headers = F.coalesce(get(item, "$.payload.headers", "array<struct<name:string,value:string>>"), F.array().cast("array<struct<name:string,value:string>>"))
    raw = get(item, "$.payload.headers", "variant").isNotNull()
    head = lambda name: F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(1))["value"]
    field = lambda name, *flat: F.when(raw, head(name)).otherwise(F.coalesce(*(get(item, f"$.{f}") for f in flat)))
    flat_text = F.coalesce(*(get(item, f"$.{f}") for f in ("body", "text", "snippet")), F.lit(""))
    df = items.where(~is_record(item)).withColumns(
        {
            "_from": F.try_element_at(T.address_list(F.coalesce(field("from", "from"), F.lit(""))), F.lit(1)),
            "_ts": F.coalesce(D.from_unix_time(get(item, "$.internalDate")), _mail_time(field("date", "date"))),
            "_thread": F.coalesce(get(item, "$.threadId"), get(item, "$.thread_id"), get(item, "$.id")),
            "_id": get(item, "$.id"),
        }
    )
    labels = F.coalesce(get(item, "$.labelIds", "array<string>"), get(item, "$.labels", "array<string>"), F.array().cast("array<string>"))
    stamp = F.date_format("_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return df.select(
        F.concat(F.lit("gmail:"), F.coalesce("_id", F.concat("_thread", F.lit(":"), stamp))).alias("id"),
        F.lit("gmail").alias("source"),
        F.lit("email").alias("kind"),
        F.concat(F.lit("email:"), "_thread").alias("thread"),
        F.col("_ts").alias("ts"),
        F.col("_from").cast(PARTY).alias("sender"),
        T.address_list(F.concat_ws(",", field("to", "to"), field("cc", "cc"))).cast(f"array<{PARTY}>").alias("recipients"),
        F.coalesce(F.col("_from")["handle"].isin(owners), F.lit(False)).alias("is_from_me"),
        field("subject", "subject", "title").alias("title"),
        F.when(get(item, "$.payload", "variant").isNotNull(), F.coalesce(mail_body(get(item, "$.payload", "variant")), get(item, "$.snippet"), F.lit(""))).otherwise(flat_text).alias("text"),
        F.concat(F.lit(MAIL_LINK), "_id").alias("url"),
        _json(labels=labels, account=F.lit(None).cast("string") if account is None else account).alias("meta"),
    ).where("id is not null and ts is not null")


def slack_records(items: DataFrame, owners: list[str]) -> DataFrame:
    """Channel messages as records, alone or in the wrapper of a channel read: channel, team and member count come from either."""
    item, around = F.col("item"), F.col("context")
    either = lambda path, kind="string": F.coalesce(get(item, path, kind), get(around, path, kind))
    channel = either("$.channel", "variant")
    named = F.coalesce(get(channel, "$.id"), get(channel, "$.name"))
    plain = F.when(F.schema_of_variant(channel) == "STRING", get(channel, "$"))
    df = items.where(~is_record(item)).withColumns(
        {
            "_channel": F.coalesce(F.nullif(plain, F.lit("")), named, F.when(channel.isNull(), F.coalesce(get(around, "$.id"), get(item, "$.channel_id"))), F.lit("unknown")),
            "_room": F.coalesce(get(channel, "$.name"), get(item, "$.channel_name")),
            "_user": F.coalesce(get(item, "$.user"), get(item, "$.user_id"), get(item, "$.userId")),
            "_name": F.coalesce(get(item, "$.user_profile.real_name"), get(item, "$.username"), get(item, "$.user_name")),
            "_stamp": get(item, "$.ts"),
            "_members": F.coalesce(get(around, "$.num_members", "bigint"), get(item, "$.num_members", "bigint")),
        }
    )
    ts = F.coalesce(F.timestamp_micros((F.expr("try_cast(_stamp as decimal(20,6))") * 1_000_000).cast("bigint")), F.try_to_timestamp(F.coalesce(get(item, "$.date"), get(item, "$.timestamp"))))
    sender = F.when(F.col("_user").isNotNull(), F.struct(H.slack_handle(either("$.team"), F.col("_user")).alias("handle"), F.col("_name").alias("name"))).when(F.col("_name").isNotNull(), F.struct(H.name_handle(F.col("_name")).alias("handle"), F.col("_name").alias("name")))
    thread_ts = either("$.thread_ts")
    meta = _json(channel=F.col("_channel"), channelName=F.col("_room"), threadTs=thread_ts, chat_name=F.col("_room"), is_group=~F.col("_channel").startswith("D"), member_count=F.when(F.col("_members") > 0, F.col("_members")))
    return df.withColumns({"_ts": ts, "_sender": sender}).select(
        F.concat(F.lit("slack:"), "_channel", F.lit(":"), F.coalesce("_stamp", get(item, "$.id"), F.date_format("_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))).alias("id"),
        F.lit("slack").alias("source"),
        F.lit("message").alias("kind"),
        F.concat(F.lit("slack:"), "_channel").alias("thread"),
        F.col("_ts").alias("ts"),
        F.col("_sender").cast(PARTY).alias("sender"),
        F.array().cast(f"array<{PARTY}>").alias("recipients"),
        F.coalesce(F.col("_sender")["handle"].isin(owners), F.lit(False)).alias("is_from_me"),
        F.lit(None).cast("string").alias("title"),
        F.coalesce(get(item, "$.text"), get(item, "$.message"), F.lit("")).alias("text"),
        get(item, "$.permalink").alias("url"),
        meta.alias("meta"),
    ).where("ts is not null")
