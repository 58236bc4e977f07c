"""Privacy categories on cases of their own, and the compiled lists against plain search."""

import random
import re

import pytest

from threadloom.functions.phrases import spelled, trie
from threadloom.functions.privacy_lists import BANK_TEXT, HEALTH_TEXT, PASSWORD_TEXT
from threadloom.operators import privacy as P

ANA, ALL = "tel:+13055551234", {"categories": ["banking", "health", "passwords", "family"]}
SCHEMA = "account string, chat string, thread string, sender string, sender_name string, title string, text string, kind string, members int, recipients array<struct<handle:string,name:string>>, is_group boolean, is_from_me boolean"


def case(sender=ANA, name="Ana Lopez", text="See you at 3", title=None, kind="message", chat=None, to=(), group=False, mine=False):
    return (None, chat, "t", sender, name, title, text, kind, 2, list(to), group, mine)


CASES = [
    (case("mailto:no-reply@alertsp.chase.com", "Chase", kind="email"), "banking", "thread"),
    (case("mailto:info@firstcitizensbank.com", None, kind="email"), "banking", "thread"),
    (case("mailto:x@mybank-online.com", None, kind="email"), None, None),
    (case("tel:+24273", None, "Chase: A $52.10 debit card transaction on your account ending in 1234."), "banking", "thread"),
    (case("tel:+26628", None, "BBVA: Compra por $1,250.00 con tu tarjeta terminada en 4321."), "banking", "thread"),
    (case(text="BBVA: saldo disponible $4"), "banking", "record"),
    (case(text="tu saldo, amigo"), None, None),
    (case(name="Santander México"), "banking", "thread"),
    (case(name="Chase Bank"), "banking", "thread"),
    (case(name="Chase Miller"), None, None),
    (case("mailto:citas@sonrisadental.mx", None, kind="email"), "health", "thread"),
    (case(name="Clínica San José"), "health", "thread"),
    (case(text="Te recuerdo tu cita médica mañana a las 10"), "health", "record"),
    (case(text="Dr. Ruiz's office called"), "health", "record"),
    (case(text="Te paso la receta del pastel"), None, None),
    (case(text="", title="Cita con la doctora", kind="event"), "health", "record"),
    (case(text="", title="Call with Dr. Patel (investor)", kind="event"), None, None),
    (case(text="my prescription is ready, anyway", kind="meeting"), None, None),
    (case(text="G-482913 is your code"), "passwords", "record"),
    (case("tel:+32665", None, "Your verification code is 482913"), "passwords", "thread"),
    (case(text="the wifi contraseña: Qwave2026!"), "passwords", "record"),
    (case(text="Cuál es la palabra clave: innovación"), None, None),
    (case("mailto:hello@1password.com", "1Password", kind="email"), "passwords", "thread"),
    (case(text="Access code: 123 456 789", kind="event"), None, None),
    (case(name="Mamá Rosa"), "family", "thread"),
    (case(name="Mama Juana Bar Miami"), None, None),
    (case(name="Alex Rivera", mine=True, to=[("tel:+13055559999", "Tío Juan")]), "family", "thread"),
    (case(chat="Familia Hernández", to=[("group:x:1", "Familia Hernández")], group=True), "family", "thread"),
    (case(chat="Smith Family Office deal", to=[("group:x:1", "Smith Family Office deal")], group=True), None, None),
    (case(name="Mom", to=[("tel:+1305555777%d" % i, "P") for i in range(3)]), None, None),
    (case(text="", title="Family dinner", kind="event"), "family", "record"),
    (case(title="Mom", kind="contact", text=""), "family", "record"),
    (case(None, None, None, None), None, None),
]


def test_categories(spark):
    table = spark.createDataFrame([c for c, _, _ in CASES], SCHEMA)
    got = P.filter_record(table.coalesce(1), ALL).collect()
    for r, (c, reason, scope) in zip(got, CASES, strict=True):
        assert (r["reason"], r["scope"], r["keep"]) == (reason, scope, reason is None), c


@pytest.mark.parametrize("phrases", [BANK_TEXT, HEALTH_TEXT, PASSWORD_TEXT])
def test_trie_equals_plain_search(phrases):
    pattern, rng = re.compile(trie(phrases)), random.Random(4)
    plain = [re.compile(r"(?<!\w)" + re.escape(p).replace(r"\#", "[0-9]").replace(r"\~", "[A-Za-z0-9_]+'?s").replace("\\~", "[A-Za-z0-9_]+'?s") + (r"(?=\w)" if p.endswith("$") else r"(?!\w)"), re.A) for p in spelled(phrases)]
    words = [w for p in spelled(phrases) for w in re.split("( )", p.replace("#", "7"))] + ["5", "x", "-", "lees", "lee's"]
    for _ in range(4000):
        text = "".join(rng.choices(words, k=rng.randrange(12)))
        assert bool(pattern.search(text)) == any(p.search(text) for p in plain), text
    for p in spelled(phrases):
        said = p.replace("#", "7").replace("~", "lee's")
        assert pattern.search(f"a {said}{'5' if said.endswith('$') else '.'}")
