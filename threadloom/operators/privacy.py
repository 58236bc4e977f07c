"""Privacy rules: which records go, whole threads or single ones, and what is masked in the rest.

``exclusions`` is a plain dict of lists (people, handles, domains, chats,
accounts, keywords, categories); it becomes literals of one expression, so a
scan judges a record without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import handles as H
from threadloom.functions import phrases as P
from threadloom.functions import privacy_lists as L
from threadloom.functions import text as T

#: Under so many people a thread goes whole; from there on only what names the excluded.
LARGE_GROUP = 8
#: Most other people in a talk that counts as private.
SMALL_CIRCLE = 2
#: Characters of a mail that the phrases are looked for in.
MAIL_HEAD = 3000
#: Kinds whose text is short enough that a phrase tells what it is about.
SHORT_KINDS = ("message", "email", "event", "dictation", "doc", "note")


def _any(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def name_matches(name: Column, people: list[str]) -> Column:
    """Equal, a prefix at a word's end, or all tokens present."""
    out, n = F.lit(False), T.name_norm(name)
    for person in people:
        wanted = " ".join(person.lower().split())
        tokens = F.forall(_any(wanted.split()), lambda t: F.array_contains(T.name_tokens(name), t))
        out = out | (n == wanted) | n.startswith(wanted + " ") | (tokens if " " in wanted else F.lit(False))
    return out


def handle_matches(handle: Column, handles: list[str]) -> Column:
    tails = [h[-10:] for h in ("".join(c for c in x if c.isdigit()) for x in handles if x.startswith("tel:")) if len(h) >= 10]
    return F.array_contains(_any(handles), handle) | F.coalesce(F.array_contains(_any(tails), H.last10(handle)), F.lit(False))


def domain_in(handle: Column, domains: list[str]) -> Column:
    d = H.email_domain(handle)
    return F.coalesce(F.exists(_any(domains), lambda x: (d == x) | d.endswith(F.concat(F.lit("."), x))), F.lit(False))


def party_reason(handle: Column, name: Column, exclusions: dict) -> Column:
    return (
        F.when(name_matches(F.coalesce(name, F.lit("")), exclusions.get("people", [])), "person")
        .when(handle_matches(handle, exclusions.get("handles", [])), "handle")
        .when(domain_in(handle, exclusions.get("domains", [])), "domain")
    )


def rule_keywords(text: Column, words: list[str]) -> Column:
    folded = T.privacy_fold(text)
    import re

    return folded.rlike("(^|[^a-z0-9])(" + "|".join(map(re.escape, words)) + ")($|[^a-z0-9])") if words else F.lit(False)


def _host_in(handle: Column, domains: list[str], words: list[str]) -> Column:
    """Whether a mail's host is one of the domains, lies under one, or has a label that holds one of the words."""
    host = H.email_domain(handle)
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hit = F.exists(above, lambda d: d.isin(domains))  # a set, looked up once a label
    if words:
        hit = hit | host.rlike(rf"({'|'.join(words)})[a-z0-9]*(\.|$)")
    return F.coalesce(hit, F.lit(False))


def bank_name(name: Column) -> Column:
    """A bank's name anywhere in a folded name; a brand that is also a word only alone or with an ending of banks."""
    brand = rf"^({'|'.join(L.BANK_BRANDS)})( ({'|'.join(L.BANK_ENDINGS)}))?$"
    return P.holds(name, L.BANK_NAMES) | name.rlike(brand)


def relative_name(name: Column) -> Column:
    """A folded name that is a relative's, or a relative and one more word."""
    own = rf"^(my |mi )?(({'|'.join(L.RELATIVES)})|({'|'.join(L.RELATIVES_NAMED)}) [a-z]+)$"
    return name.rlike(own) & ~P.holds(name, L.NO_FAMILY)


def told_password(text: Column) -> Column:
    """Codes, resets and second factors, and a value behind a label."""
    label = rf"(?<![A-Za-z0-9_])(?<!{L.NO_PASSWORD})({'|'.join(L.PASSWORD_LABELS)})\s*[:=]\s*\S"
    code = r"(?<![A-Za-z0-9_])[0-9]{4,8} is your(?![A-Za-z0-9_]).{0,40}(?<![A-Za-z0-9_])(code|pin|passcode)(?![A-Za-z0-9_])"
    return P.holds(text, L.PASSWORD_TEXT) | text.rlike(label) | text.rlike(code)


def category_reason(view: dict[str, Column], categories: list[str]) -> Column:
    """``(reason, scope)`` of the first category that holds, else null.

    ``view`` has handle and name of every party (``handles``, ``names``, arrays),
    ``others`` (names of the people but the owner), ``chats`` and ``cards``
    (names of the chat and of a contact), ``kind``, ``title``, ``text``,
    ``group`` and ``automated``. A rule on who a thread is with takes the whole
    thread, one on a person's words that record only.
    """
    kind, automated = view["kind"], view["automated"]
    body = F.when(kind == "email", F.left(view["text"], F.lit(MAIL_HEAD))).otherwise(view["text"])
    text, title = P.fold(F.concat_ws("\n", view["title"], body)), P.fold(view["title"])
    names, others, chats, cards = (F.transform(view[k], P.fold_name) for k in ("names", "others", "chats", "cards"))
    any_host = lambda domains, words=(): F.exists(view["handles"], lambda h: _host_in(h, domains, list(words)))
    short, event = kind.isin(*SHORT_KINDS), kind == "event"
    by_sender = F.when(automated, "thread").otherwise("record")
    bank_text, health_text = P.holds(text, L.BANK_TEXT), P.holds(text, L.HEALTH_TEXT)
    family_chat = lambda n: (P.holds(n, L.FAMILY_CHATS) | relative_name(n)) & ~P.holds(n, L.NO_FAMILY)
    rules = {
        "banking": F.when(any_host(L.BANK_DOMAINS, L.BANK_HOST_WORDS) | F.exists(F.concat(names, chats, cards), bank_name), "thread").when(short & bank_text, F.when(automated, "thread").when(P.holds(text, L.BANK_NAMES), "record")),
        "health": F.when(any_host(L.HEALTH_DOMAINS, L.HEALTH_HOST_WORDS) | F.exists(F.concat(names, chats), lambda n: P.holds(n, L.HEALTH_NAMES)), "thread")
        .when(short & ~event & health_text, by_sender)
        .when(event & (P.holds(title, L.HEALTH_EVENTS) | health_text), "record"),
        "passwords": F.when(any_host(L.PASSWORD_DOMAINS) | F.exists(names, lambda n: P.holds(n, L.PASSWORD_NAMES)), "thread").when(kind.isin("message", "email") & told_password(text), by_sender),
        "family": F.when(F.exists(chats, family_chat) | (~view["group"] & (F.size(others) <= SMALL_CIRCLE) & F.exists(others, relative_name)), "thread").when(
            F.exists(cards, relative_name) | (event & P.holds(title, L.FAMILY_EVENTS) & ~P.holds(title, L.NO_FAMILY)), "record"
        ),
    }
    found = [F.struct(F.lit(c).alias("reason"), rules[c].alias("scope")) for c in rules if c in categories]
    return F.coalesce(*(F.when(f["scope"].isNotNull(), f) for f in found), F.lit(None).cast("struct<reason:string,scope:string>"))


#: Columns of records that rules look at beside those that every record has, and what counts where a table lacks them.
VIEW = {"recipients": "array<struct<handle:string,name:string>>", "contact_names": "array<string>", "is_group": "boolean", "is_from_me": "boolean", "bulk": "boolean"}


def record_view(records: DataFrame) -> dict[str, Column]:
    """What the category rules look at, from the columns of a table of records; those of ``VIEW`` may be missing."""
    held = {n: F.col(n) if n in records.columns else F.lit(None).cast(kind) for n, kind in VIEW.items()}
    mine, group = F.coalesce(held["is_from_me"], F.lit(False)), F.coalesce(held["is_group"], F.lit(False))
    party = VIEW["recipients"]
    everyone = F.concat(F.array(F.struct(F.col("sender").alias("handle"), F.col("sender_name").alias("name"))).cast(party), F.coalesce(held["recipients"], F.array().cast(party)))
    people = F.filter(everyone, lambda p: p["handle"].isNotNull() | p["name"].isNotNull())
    called = lambda p: F.coalesce(p["name"], F.when(H.scheme(p["handle"]) == "name", H.value(p["handle"])), F.lit(""))
    rooms = F.filter(people, lambda p: F.coalesce(p["handle"].startswith("group:"), F.lit(False)))
    others = F.filter(people, lambda p: ~F.coalesce(p["handle"].startswith("group:"), F.lit(False)) & ~(mine & p["handle"].eqNullSafe(F.col("sender"))))
    group = group | (F.size(rooms) > 0)
    spoken = F.when((F.col("kind") == "message") & ~group, F.col("title"))
    chats = F.filter(F.concat(F.array(F.col("chat"), spoken), F.transform(rooms, lambda p: p["name"])), lambda n: F.coalesce(n, F.lit("")) != "")
    return {
        "handles": F.filter(F.transform(people, lambda p: p["handle"]), lambda h: h.isNotNull()),
        "names": F.transform(people, called),
        "others": F.transform(others, called),
        "chats": chats,
        "cards": F.when(F.col("kind") == "contact", F.filter(F.concat(F.coalesce(held["contact_names"], F.array().cast("array<string>")), F.array("title")), lambda n: n.isNotNull())).otherwise(F.array().cast("array<string>")),
        "kind": F.col("kind"),
        "title": F.coalesce("title", F.lit("")),
        "text": F.coalesce("text", F.lit("")),
        "group": group,
        "automated": ~mine & (F.coalesce(H.is_short_code(F.col("sender")) | H.is_automated(F.col("sender")), F.lit(False)) | F.coalesce(held["bulk"], F.lit(False))),
    }


def filter_record(records: DataFrame, exclusions: dict) -> DataFrame:
    """Adds keep, reason and scope; the first rule that holds counts.

    Columns: account, chat, thread, sender, sender_name, title, text,
    kind, members (number of people, null if unknown); those of ``VIEW`` count where they are there.
    """
    party = party_reason(F.col("sender"), F.col("sender_name"), exclusions)
    small = F.coalesce(F.col("members") < LARGE_GROUP, F.lit(False)) & F.col("kind").isin("message", "email")
    category = category_reason(record_view(records), exclusions.get("categories", []))
    s = lambda reason, scope: F.struct(reason.alias("reason"), scope.alias("scope"))
    verdict = (
        F.when(F.coalesce(F.array_contains(_any(exclusions.get("accounts", [])), F.col("account")), F.lit(False)), s(F.lit("account"), F.lit("record")))
        .when(F.coalesce(F.array_contains(_any([c.lower() for c in exclusions.get("chats", [])]), T.name_norm(F.col("chat"))), F.lit(False)), s(F.lit("chat"), F.lit("thread")))
        .when(party.isNotNull(), s(party, F.when(small, "thread").otherwise("record")))
        .when(rule_keywords(F.concat_ws(" ", "title", "text"), exclusions.get("keywords", [])), s(F.lit("keyword"), F.lit("record")))
        .otherwise(category)
    )
    return records.withColumn("_v", verdict).withColumns({"keep": F.col("_v").isNull(), "reason": F.col("_v.reason"), "scope": F.col("_v.scope")}).drop("_v")


def purge_excluded(judged: DataFrame) -> DataFrame:
    """Records that stay: neither excluded themselves nor in a thread that is excluded whole, whatever order they came in."""
    threads = judged.where("scope = 'thread'").select("thread").distinct()
    return judged.where("keep").join(threads, "thread", "left_anti")


def validate_record(records: DataFrame, kinds: list[str]) -> DataFrame:
    """Adds ``errors``: names of the rules that a record breaks."""
    rules = {
        "id": F.col("id").rlike("^[a-z_]+:.+$"),
        "source": F.col("id").startswith(F.concat("source", F.lit(":"))),
        "kind": F.col("kind").isin(*kinds),
        "ts": F.col("ts").isNotNull(),
    }
    found = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()))
    return records.withColumn("errors", F.array_compact(found))


def scrub_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``scrubbed`` and ``redactions``: IBANs, cards, social security numbers, codes and passwords masked.

    A text is read once, in expressions only; one that holds neither a digit
    nor a password's name is passed on as it is.
    """
    from threadloom.functions.scrub import scrub

    likely = F.coalesce(F.col(text).rlike(r"(?i)[0-9]{4}|[0-9][ -][0-9]|passw|pwd|contrase|clave|passcode"), F.lit(False))
    plain = F.struct(F.col(text).alias("scrubbed"), F.array().cast("array<string>").alias("redactions"))
    marked = docs.withColumn("_s", F.when(likely, scrub(F.col(text))).otherwise(plain))
    return marked.withColumns({"scrubbed": F.col("_s.scrubbed"), "redactions": F.col("_s.redactions")}).drop("_s")
