"""Privacy categories over hosts, names and texts that cover every entry of their lists and near misses of each.

A project's id decides which entry meets it and where it stands; Spark judges
with the compiled lists, the SQL searches the same entries one by one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import privacy_lists as L
from threadloom.functions.phrases import spelled
from threadloom.operators import privacy as P
from threadloom.plans import tables as t
from threadloom.plans.tables import sql

QUERIES, SQL = {}, {}
KINDS = ["message", "email", "event", "doc", "meeting", "contact"]
SENDERS = ["mailto:ann@shop.example", "mailto:no-reply@shop.example", "tel:+22395", "tel:+13055551234"]


def _said(phrases: list[str]) -> list[str]:
    """Phrases as a text has them: digits and open words filled in."""
    return [p.replace("#", "7").replace("~", "lees") for p in spelled(phrases)]


def _near(values: list[str]) -> list[str]:
    """Each value and, for every third, one that only looks like it."""
    return [*values, *(f"x{v}" for v in values[::3]), *(f"{v}q" for v in values[1::3])]


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _cases(hosts: list[str], names: list[str], texts: list[str], titles: list[str]) -> tuple:
    """The same table of cases for Spark and as SQL: a host, a name, a title or a text of the lists meets each id."""
    where = [f"mailto:{who}@{sub}{h}" for h in _near(hosts) for who, sub in (("ann", ""), ("no-reply", "mail."))]
    names, texts, titles = _near(names), _near(texts), _near(titles)

    def rows(spark, sf):
        at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.expr(n) % len(values) + 1).cast("int"))
        turn = F.col("id") % 4
        p = t.projects(spark, sf)
        return p.select(
            "id",
            at(KINDS, "id div 4").alias("kind"),
            F.when(turn == 0, at(where, "id div 4")).otherwise(at(SENDERS, "id div 24")).alias("sender"),
            F.when(turn == 1, F.initcap(at(names, "id div 4"))).otherwise(F.lit("Ann Lee")).alias("sender_name"),
            F.when((turn == 1) & (F.col("id") % 3 == 0), at(names, "id div 4")).alias("chat"),
            F.when(turn == 2, F.initcap(at(titles, "id div 4"))).otherwise(F.col("title")).alias("title"),
            F.when(turn == 3, F.concat(F.lit("Note, "), F.upper(at(texts, "id div 4")), F.when(at(texts, "id div 4").endswith("$"), "5").otherwise(" now"))).otherwise(F.col("title")).alias("text"),
            (F.col("id") % 5 == 0).alias("is_group"),
        )

    at = lambda values, n: f"{_list(values)}[CAST(({n}) % {len(values)} + 1 AS INTEGER)]"
    said = at(texts, "id // 4")
    table = f"""cases AS (SELECT id, {at(KINDS, "id // 4")} AS kind, CASE WHEN id % 4 = 0 THEN {at(where, "id // 4")} ELSE {at(SENDERS, "id // 24")} END AS sender,
    CASE WHEN id % 4 = 1 THEN {at(names, "id // 4")} ELSE 'ann lee' END AS name, CASE WHEN id % 4 = 1 AND id % 3 = 0 THEN {at(names, "id // 4")} ELSE '' END AS chat,
    CASE WHEN id % 4 = 2 THEN {at(titles, "id // 4")} ELSE lower(title) END AS title, CASE WHEN id % 4 = 3 THEN 'note ' || {said} || CASE WHEN {said} LIKE '%$' THEN '5' ELSE ' now' END ELSE lower(title) END AS text, id % 5 = 0 AS grp FROM projects),
seen AS (SELECT *, CASE WHEN sender LIKE 'mailto:%' THEN split_part(sender, '@', 2) ELSE '' END AS host, sender LIKE '%no-reply%' OR sender = 'tel:+22395' AS automated, ' ' || title || ' ' || text || ' ' AS body,
    CASE WHEN kind = 'message' AND NOT grp THEN title ELSE '' END AS room FROM cases)"""
    return rows, table


def _any(values: list[str], test: str) -> str:
    return f"len(list_filter({_list(values)}, lambda v: {test})) > 0"


def _has(phrases: list[str], column: str) -> str:
    """Whether a phrase stands in a column as words of its own; an apostrophe ends a word."""
    wanted = "CASE WHEN v LIKE '%$' THEN ' ' || v ELSE ' ' || v || ' ' END"
    return _any(_said(phrases), f"contains(' ' || {column} || ' ', {wanted}) OR contains(' ' || replace({column}, chr(39), ' ') || ' ', {wanted})")


def _named(phrases: list[str], column: str) -> str:
    """The same in a name, whose signs count as spaces."""
    return _has([p.replace("*", " ").replace(".", " ") for p in phrases], f"trim(regexp_replace({column}, '[^a-z0-9]+', ' ', 'g'))")


def _host(domains: list[str], words: list[str]) -> str:
    parts = _any(domains, "host = v OR ends_with(host, '.' || v)")
    return f"({parts} OR regexp_matches(host, '({'|'.join(words)})[a-z0-9]*([.]|$)'))" if words else f"({parts})"


_BRAND = "regexp_matches({c}, '^(" + "|".join(L.BANK_BRANDS) + ")( (" + "|".join(L.BANK_ENDINGS) + "))?$')"
_SHORT = "kind IN ('message', 'email', 'event', 'dictation', 'doc', 'note')"
_KIN = _any(L.RELATIVES, "list_contains([v, 'my ' || v, 'mi ' || v], {c})") + " OR " + _any(L.RELATIVES_NAMED, "regexp_matches({c}, '^(my |mi )?' || v || ' [a-z]+$')")
_kin = lambda c: f"(({_KIN.format(c=c)}) AND NOT {_named(L.NO_FAMILY, c)})"
_anyone = lambda test, *columns: "(" + " OR ".join(test(c) for c in columns) + ")"
_card = "CASE WHEN kind = 'contact' THEN title ELSE '' END"

_RULES = {
    "banking": (
        (L.BANK_DOMAINS + [f"my{w}s.example" for w in L.BANK_HOST_WORDS], _said(L.BANK_NAMES) + L.BANK_BRANDS + [f"chase {e}" for e in L.BANK_ENDINGS] + ["chase miller"], _said(L.BANK_TEXT) + [f"your balance at {n}" for n in _said(L.BANK_NAMES)], _said(L.BANK_NAMES)),
        f"CASE WHEN {_host(L.BANK_DOMAINS, L.BANK_HOST_WORDS)} OR {_anyone(lambda c: _named(L.BANK_NAMES, c) + ' OR ' + _BRAND.format(c=c), 'name', 'chat', 'room', _card)} THEN 'thread' "
        f"WHEN {_SHORT} AND {_has(L.BANK_TEXT, 'body')} AND automated THEN 'thread' WHEN {_SHORT} AND {_has(L.BANK_TEXT, 'body')} AND {_has(L.BANK_NAMES, 'body')} THEN 'record' END",
    ),
    "health": (
        (L.HEALTH_DOMAINS + [f"city{w}s.example" for w in L.HEALTH_HOST_WORDS], _said(L.HEALTH_NAMES), _said(L.HEALTH_TEXT), _said(L.HEALTH_EVENTS)),
        f"CASE WHEN {_host(L.HEALTH_DOMAINS, L.HEALTH_HOST_WORDS)} OR {_anyone(lambda c: _named(L.HEALTH_NAMES, c), 'name', 'chat', 'room')} THEN 'thread' "
        f"WHEN {_SHORT} AND kind <> 'event' AND {_has(L.HEALTH_TEXT, 'body')} THEN CASE WHEN automated THEN 'thread' ELSE 'record' END WHEN kind = 'event' AND ({_has(L.HEALTH_EVENTS, 'title')} OR {_has(L.HEALTH_TEXT, 'body')}) THEN 'record' END",
    ),
    "passwords": (
        (L.PASSWORD_DOMAINS, L.PASSWORD_NAMES, _said(L.PASSWORD_TEXT) + ["password: a1", "palabra clave: x", "clave = z", "123456 is your new code"], ["password reset", "magic links"]),
        f"CASE WHEN {_host(L.PASSWORD_DOMAINS, [])} OR {_named(L.PASSWORD_NAMES, 'name')} THEN 'thread' WHEN kind IN ('message', 'email') AND ({_has(L.PASSWORD_TEXT, 'body')} OR contains(body, ' password: ') OR contains(replace(body, 'palabra clave', ''), ' clave = ') "
        "OR contains(body, ' 123456 is your new code ')) THEN CASE WHEN automated THEN 'thread' ELSE 'record' END END",
    ),
    "family": (
        (["shop.example"], L.RELATIVES + [f"{w} rosa" for w in L.RELATIVES] + [f"los {c} ruiz" for c in L.FAMILY_CHATS] + L.NO_FAMILY + ["mama juana bar"], ["hello"], L.FAMILY_EVENTS + L.NO_FAMILY + L.RELATIVES),
        f"CASE WHEN {_anyone(lambda c: f'(({_named(L.FAMILY_CHATS, c)} OR {_kin(c)}) AND NOT {_named(L.NO_FAMILY, c)})', 'chat', 'room')} OR (NOT grp AND {_kin('name')}) THEN 'thread' "
        f"WHEN {_kin(_card)} OR (kind = 'event' AND {_has(L.FAMILY_EVENTS, 'title')} AND NOT {_has(L.NO_FAMILY, 'title')}) THEN 'record' END",
    ),
}


def _register(category: str, lists: tuple, scope: str) -> None:
    rows, table = _cases(*lists)

    def run(spark, sf):
        cases = rows(spark, sf)
        verdict = P.category_reason(P.record_view(cases), [category])
        return cases.select("id", "kind", "sender", verdict["scope"].alias("scope"))

    QUERIES[f"rule_{category}"] = run
    SQL[f"rule_{category}"] = sql("projects", f"SELECT id, kind, sender, {scope} AS scope FROM seen", table)


for _category, (_lists, _scope) in _RULES.items():
    _register(_category, _lists, _scope)
