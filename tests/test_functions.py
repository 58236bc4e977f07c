from pyspark.sql import functions as F

from threadloom.functions import handles as H
from threadloom.functions import text as T


def values(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t")).alias("v")).collect()]


def test_phone(spark):
    got = values(spark, H.norm_phone, "(555) 123-4567", "+52 1 55 1234 5678", "0044 20 7946 0958", "22395", "a@b.com", "", None, "123456789012345678")
    assert got == ["+15551234567", "+5215512345678", "+442079460958", "+22395", None, None, None, None]


def test_email_and_domain(spark):
    assert values(spark, H.norm_email, "Ann <ANN@Acme.com>", "no address", None) == ["ann@acme.com", None, None]
    assert values(spark, H.email_domain, "mailto:a@b@c.org", "tel:+1", "mailto:@x.com") == ["c.org", None, None]


def test_automated(spark):
    assert values(spark, H.is_automated, "mailto:no-reply@x.com", "mailto:newsletter@x.com", "mailto:ann@x.com", "tel:+1") == [True, True, False, False]


def test_names(spark):
    assert values(spark, T.name_norm, "  José  O'Néill ", "ÑANDÚ-9", "") == ["jose o neill", "nandu 9", ""]
    assert values(spark, T.company_key, "Acme Holdings, Inc.", "Beta S.A. de C.V.", "Gamma Corp Ltd") == ["acme holdings", "beta s a de c v", "gamma"]


def test_classes(spark):
    got = values(spark, T.classify_message, "Thanks!", "jajaja", "ok", "Your verification code is 1234", "I will send the deck tomorrow", "", None)
    assert got == ["noise", "noise", "ack", "noise", "content", "noise", "noise"]
    assert values(spark, T.is_request, "Can you call me", "Done?", "no question", None) == [True, True, False, False]


def test_clean_email(spark):
    assert values(spark, T.clean_email_text, "Hi there\n\nOn Mon, Jan 1, 2024 Ann wrote:\n> old", "a\n> q\nb\n--\nsig") == ["Hi there", "a\nb"]


def test_html(spark):
    assert values(spark, T.html_to_text, "<html><script>x</script><p>a &amp; b</p><p>c</p></html>") == ["a & b\nc"]


SCRUBBED = [
    ("card 4111 1111 1111 1111 ok", "card [card] ok", ["card"]),
    ("amex 3782 822463 10005.", "amex [card].", ["card"]),
    ("4111 1111 1111 1112", "4111 1111 1111 1112", []),
    ("41 111111 1111 1111", "41 111111 1111 1111", []),
    ("IBAN DE89 3704 0044 0532 0130 00 end", "IBAN [iban] end", ["iban"]),
    ("DE89370400440532013000 ABCD", "[iban] ABCD", ["iban"]),
    ("my SSN 123-45-6789", "my SSN [ssn]", ["ssn"]),
    ("número de seguro social: 123456789 y", "número de seguro social: [ssn] y", ["ssn"]),
    ("ssn 000-12-3456 and ssn 666-12-3456", "ssn 000-12-3456 and ssn 666-12-3456", []),
    ("your code is 123456", "your code is [code]", ["code"]),
    ("G-48213 is your Google verification code", "[code] is your Google verification code", ["code"]),
    ("482134 is your login code", "[code] is your login code", ["code"]),
    ("123456 es el nuevo código", "[code] es el nuevo código", ["code"]),
    ("zip code 90210 and order code 1234", "zip code 90210 and order code 1234", []),
    ("código postal 28013, código 2024", "código postal 28013, código 2024", []),
    ("code 1999 but pin 1999", "code 1999 but pin [code]", ["code"]),
    ("password: hunter2", "password: [password]", ["password"]),
    ("the password is fine, the password is Hunter2.", "the password is fine, the password is [password].", ["password"]),
    ("palabra clave: sol; clave: sol", "palabra clave: sol; clave: [password]", ["password"]),
    ("passcode: 1234", "passcode: [code]", ["code"]),
    ("nothing here", "nothing here", []),
    ("Card 4111 1111 1111 1111 and amex 3782-822463-10005, visa 4012888888881881.", "Card [card] and amex [card], visa [card].", ["card", "card", "card"]),
    *((s, s, []) for s in ("Call +1 305 555 0100", "Order 112-1234567-1234567", "Invoice 4111 1111 1111 1112", "Tracking 1Z999AA10123456784", "Total $1,234,567.89", "Date 2026-09-28 12:30", "Stamp 20260928123045", "Ref 5105 1051 0510 5106 1")),
    ("IBAN: DE89 3704 0044 0532 0130 00 PLEASE PAY", "IBAN: [iban] PLEASE PAY", ["iban"]),
    ("ES9121000418450200051332", "[iban]", ["iban"]),
    ("it ends.\n4111111111111111 begins", "it ends.\n[card] begins", ["card"]),
    ("the code\n123456", "the code\n123456", []),
    ("DE89 3704 0044 0532 0130 01", "DE89 3704 0044 0532 0130 01", []),
    ("Número de seguro social: 123 45 6789", "Número de seguro social: [ssn]", ["ssn"]),
    ("Part number 123-45-6789", "Part number 123-45-6789", []),
    ("ssn 123-45-6789 12 then 4111111111111111", "ssn [ssn] 12 then [card]", ["card", "ssn"]),
    ("Tu código de verificación es 4821", "Tu código de verificación es [code]", ["code"]),
    ("482913 is your Instagram code", "[code] is your Instagram code", ["code"]),
    ("G-482913 is your Google verification code.", "[code] is your Google verification code.", ["code"]),
    ("OTP: 123 456", "OTP: [code]", ["code"]),
    ("PIN 1234 4111 1111 1111 1111", "PIN [code] 1111 1111 1111", ["code"]),
    ("+1 4111 1111 1111 1111", "+1 [card]", ["card"]),
    ("$4111 1111 1111 1111", "$4111 1111 1111 1111", []),
    ("4111 1111 1111 1111 4012 8888 8888 1881", "[card] [card]", ["card", "card"]),
    ("4111111111111111.5", "4111111111111111.5", []),
    ("1234567890123456789012345 code", "1234567890123456789012345 code", []),
    *((s, s, []) for s in ("Zip code 33101", "Código postal 06600", "Promo code 2024 saves 20%", "Meeting ID: 812 3456 7890", "Call me at 305 555 0100", "Order code 99812", "The code of conduct 2026")),
    ("wifi password: Qwave2026!", "wifi password: [password]", ["password"]),
    ("la contraseña es Tigre#88.", "la contraseña es [password].", ["password"]),
    ("Passcode: aB3dE9", "Passcode: [password]", ["password"]),
    ("the password is wrong", "the password is wrong", []),
    ("palabra clave: innovación", "palabra clave: innovación", []),
    ("password: hunter2 pin 4821 4111111111111111 ES9121000418450200051332", "password: [password] pin [code] [card] [iban]", ["iban", "card", "code", "password"]),
    ("", "", []),
    (None, None, []),
]


def test_scrub(spark):
    from threadloom.operators.privacy import scrub_text

    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(SCRUBBED)], "id int, text string")
    got = {r["id"]: (r["scrubbed"], r["redactions"]) for r in scrub_text(df).collect()}
    for i, (t, want, kinds) in enumerate(SCRUBBED):
        assert got[i] == (want, kinds), t
    assert "Python" not in scrub_text(df)._jdf.queryExecution().toString()


def test_accents_code_point_by_code_point(spark):
    import unicodedata

    from threadloom.functions import text as T

    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not 0x300 <= ord(c) <= 0x36F)
    points = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)]) if plain(c) != c]
    texts = [f"a{c}b" for c in points] + ["řőşŁ ﬁné Ａｂ１ 한국 ½ ㎏", "", "plain", "\n한\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    got = {r["i"]: r["f"] for r in rows.select("i", T.fold_accents(rows["v"]).alias("f")).collect()}
    assert len(points) > 16_000 and [texts[i] for i in got if got[i] != plain(texts[i])] == []
    assert got[len(points)] == plain("řőşŁ ﬁné Ａｂ１ 한국 ½ ㎏") and rows.select(T.fold_accents(rows["v"].substr(9, 1)).alias("x")).where("x is null").count() == 0
