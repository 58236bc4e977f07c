"""Handles: one spelling for phones, mail addresses and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Local parts of senders that are no person.
NO_REPLY = r"(?i)^(no-?reply|do-?not-?reply|notifications?|mailer-daemon|bounce|alerts?|updates?|news(letter)?|info|support|hello|team|billing|receipts?)[@+.]"
#: Mail hosts that never name a company.
FREE_MAIL = (
    "gmail.com googlemail.com yahoo.com yahoo.es ymail.com hotmail.com hotmail.es outlook.com outlook.es live.com msn.com icloud.com me.com mac.com aol.com proton.me "
    "protonmail.com gmx.com gmx.de yandex.com mail.com zoho.com fastmail.com hey.com pm.me qq.com 163.com comcast.net att.net verizon.net sbcglobal.net bellsouth.net"
).split()


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def trim_space(c: Column) -> Column:
    """Unicode white space off both ends; Spark's own trim takes the plain space only."""
    return F.regexp_replace(c, r"^[\s\u00a0\u2000-\u200a\u3000\ufeff]+|[\s\u00a0\u2000-\u200a\u3000\ufeff]+$", "")


def let(c: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def norm_phone(raw: Column) -> Column:
    """E.164 of a phone, null if it is none; up to six digits are a short code, ten without a plus get the country code 1."""
    return let(F.regexp_replace(trim_space(raw), r"(?i)(@s\.whatsapp\.net|@c\.us)$", ""), _norm_phone)


def _norm_phone(s: Column) -> Column:
    zeros = s.startswith("00")
    d = F.when(zeros, F.substr(digits(s), F.lit(3))).otherwise(digits(s))
    n = F.length(d)
    full = F.when(~s.startswith("+") & ~zeros & (n == 10), F.concat(F.lit("1"), d)).otherwise(d)
    return F.when(s.contains("@") | (n == 0), None).when(n <= 6, F.concat(F.lit("+"), d)).when(F.length(full).between(8, 15), F.concat(F.lit("+"), full))


def norm_email(raw: Column) -> Column:
    """The first token that looks like an address, lower-cased."""
    found = F.regexp_extract(F.lower(trim_space(raw)), r"[^\s<>\"'(),;:]+@[^\s<>\"'(),;:]+\.[a-z]{2,}", 0)
    return F.nullif(found, F.lit(""))


def phone_handle(raw: Column) -> Column:
    return F.concat(F.lit("tel:"), norm_phone(raw))


def email_handle(raw: Column) -> Column:
    return F.concat(F.lit("mailto:"), norm_email(raw))


def name_handle(raw: Column) -> Column:
    name = F.regexp_replace(F.lower(trim_space(raw)), r"\s+", " ")
    return F.when(name != "", F.concat(F.lit("name:"), name))


def slack_handle(team: Column, user: Column) -> Column:
    return F.when(user != "", F.concat(F.lit("slack:"), F.coalesce(team, F.lit("")), F.lit("/"), user))


def group_handle(source: Column, key: Column) -> Column:
    return F.concat_ws(":", F.lit("group"), source, key)


def make_handle(raw: Column) -> Column:
    """The best handle of a raw value: mail, then phone, then name."""
    return F.coalesce(email_handle(raw), phone_handle(raw), name_handle(raw))


def scheme(h: Column) -> Column:
    return F.when(h.contains(":"), F.substring_index(h, ":", 1)).otherwise("unknown")


def value(h: Column) -> Column:
    return F.when(h.contains(":"), F.substr(h, F.instr(h, ":") + 1)).otherwise(h)


def last10(h: Column) -> Column:
    """The last ten digits of a phone handle, null with fewer; they survive country codes."""
    d = digits(value(h))
    return F.when((scheme(h) == "tel") & (F.length(d) >= 10), F.right(d, F.lit(10)))


def is_short_code(h: Column) -> Column:
    return (scheme(h) == "tel") & (F.length(digits(value(h))) <= 6)


def is_automated(h: Column) -> Column:
    return (scheme(h) == "mailto") & value(h).rlike(NO_REPLY)


def email_domain(h: Column) -> Column:
    v = value(h)
    return F.when((scheme(h) == "mailto") & (F.instr(v, "@") > 1), F.substring_index(v, "@", -1))


def canon_handle(h: Column) -> Column:
    """The handle spelled anew by its scheme; what can't be read stays, lower-cased."""
    again = F.when(scheme(h) == "tel", phone_handle(value(h))).when(scheme(h) == "mailto", email_handle(value(h))).when(scheme(h) == "name", name_handle(value(h)))
    return F.coalesce(again, F.lower(h))


def pretty_handle(h: Column) -> Column:
    v, d = value(h), digits(value(h))
    us = F.concat(F.lit("+1 "), F.substr(d, F.lit(2), F.lit(3)), F.lit(" "), F.substr(d, F.lit(5), F.lit(3)), F.lit(" "), F.substr(d, F.lit(8), F.lit(4)))
    return F.when((scheme(h) == "tel") & (F.length(d) == 11) & d.startswith("1"), us).when(scheme(h) == "name", F.initcap(v)).otherwise(v)


def mask_handle(h: Column) -> Column:
    """A phone with its last four digits only; a name without itself."""
    return F.when(scheme(h) == "tel", F.concat(F.lit("tel:..."), F.right(digits(value(h)), F.lit(4)))).when(scheme(h) == "name", F.lit("name:...")).otherwise(h)
