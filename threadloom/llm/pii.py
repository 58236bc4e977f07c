"""Personal data by bootstrapped contextual extraction, in Spark expressions only.

Four kinds have patterns of their own. Other identifiers are found by
bootstrapping: candidates are tokens that look like identifiers; each has a
context (the word or two and the signs before it) and a form (its kind of
characters). Seeds are entities: the spans of the four kinds, and candidates
after a few words that announce a secret. Contexts and forms score candidates,
candidates score contexts and forms, a few rounds; contexts that end with a
high score are patterns, and every candidate in one is a found identifier.

A text is scanned once: its spans, candidates and contexts are written, one
row for each distinct text that has any, and all later steps work on these.
Contexts stay a table, however many there are; forms are a few hundred at most.

Java's regular expressions are written with possessive repeats and a guard in
front, so each runs in time linear in the text and without deep recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.storage import materialize

#: Patterns of the four kinds, in their order. ``\\G`` lets a match begin where the last one ended.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this sign holds none of the kind.
SIGN = {"email": "@", "ip": ".", "card": "", "phone": "+"}
OTHER = "identifier"
#: 8 to 64 letters, digits and inner hyphens or underscores, a digit among them.
CANDIDATE = r"(?<![0-9A-Za-z_-])(?=[A-Za-z][A-Za-z_-]{0,62}[0-9]|[0-9])[0-9A-Za-z_-]{8,64}+(?<=[0-9A-Za-z])(?![0-9A-Za-z_-])"
#: Words before an assignment whose values are seeds.
SEED_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key")
#: Rounds, and what a context must reach: its score, that without a sign of assignment, and distinct candidates.
ROUNDS, ACCEPT, ACCEPT_PLAIN, SUPPORT = 3, 0.5, 0.8, 3
_CHUNK = 256


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once; inside a lambda a plain column expression is computed for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _prefix_sums(lengths: Column) -> Column:
    """Sums of all earlier elements, in chunks so that long arrays stay cheap."""
    plus = lambda a, b: a + b
    zero = F.lit(0)
    chunk = lambda i: F.floor(i / _CHUNK).cast("int")

    def chunk_sums(x: Column) -> Column:
        n = F.size(x)
        starts = F.when(n > 0, F.sequence(zero, chunk(n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda c: F.aggregate(F.slice(x, c * _CHUNK + 1, F.lit(_CHUNK)), zero, plus))

    def prefixes(x: Column, before: Column) -> Column:
        return F.transform(x, lambda _, i: F.get(before, chunk(i)) + F.aggregate(F.slice(x, chunk(i) * _CHUNK + 1, i % _CHUNK), zero, plus))

    return _let(
        lengths,
        lambda x: _let(chunk_sums(x), lambda sums: _let(F.transform(sums, lambda _, c: F.aggregate(F.slice(sums, F.lit(1), c), zero, plus)), lambda before: prefixes(x, before))),
    )


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, match, gap): leftmost non-overlapping matches with code-point starts and the text since the last one."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def place(x: Column) -> Column:
        gap = lambda i: F.get(x["gaps"], i)
        lengths = F.transform(x["found"], lambda m, i: F.char_length(m) + F.char_length(gap(i)))
        row = lambda before: F.transform(
            x["found"], lambda m, i: F.struct((F.get(before, i) + F.char_length(gap(i))).alias("start"), m.alias("m"), F.right(gap(i), F.lit(48)).alias("gap"))
        )
        return _let(_prefix_sums(lengths), row)

    return _let(both, place)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = F.regexp_replace(m, "[ -]", "")
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", F.when(F.length(digits).between(13, 19), digits).otherwise("0"))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int>>"


def _kept(kind: str, text: Column) -> Column:
    """Array of (kind, start, end, m, context) of one kind, in order; a match that fails its check is dropped and not tried again."""
    shape = "array<struct<kind:string,start:int,end:int,m:string,context:string>>"
    spans = F.transform(
        F.filter(_matches(text, KINDS[kind]), lambda x: _valid(kind, x["m"])),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.char_length(x["m"])).alias("end"), x["m"].alias("m"), _context(x["gap"]).alias("context")),
    )
    likely = text.contains(SIGN[kind]) if SIGN[kind] else F.lit(True)
    return F.when(likely & text.rlike(KINDS[kind]), spans.cast(shape)).otherwise(F.array().cast(shape))


def _context(gap: Column) -> Column:
    """The word and signs right before a candidate, or two words if only spaces follow them, lower-cased; empty if there is none within reach."""
    signed = F.regexp_extract(gap, r"([A-Za-z_]{2,24}\s{0,2}[:=][\s:=\"'#]{0,3})$", 1)
    plain = F.regexp_extract(gap, r"(?<![A-Za-z_])([A-Za-z_]{1,24}\s{1,2}[A-Za-z_]{2,24}[\s\"'#]{1,3})$", 1)
    return F.regexp_replace(F.lower(F.when(signed != "", signed).otherwise(plain)), r"\s+", " ")


def _form(m: Column) -> Column:
    """Kind of characters; at most about 1,500 values."""
    core = F.regexp_replace(m, "[_-]", "")
    kind = (
        F.when(core.rlike("^[0-9]+$"), "digits")
        .when(core.rlike("^[0-9a-f]+$"), "hex")
        .when(core.rlike("^[A-Z0-9]+$"), F.concat(F.lit("upper:"), F.regexp_extract(core, "^([A-Z]{0,2})", 1)))
        .otherwise("mixed")
    )
    return F.concat(kind, F.when(core == m, "").otherwise("-"))


def candidates(text: Column) -> Column:
    """Array of (start, end, m, context, form) of tokens that look like identifiers."""
    kind = "array<struct<start:int,end:int,m:string,context:string,form:string>>"
    found = F.transform(
        _matches(text, CANDIDATE),
        lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.char_length(x["m"])).alias("end"), x["m"].alias("m"), _context(x["gap"]).alias("context"), _form(x["m"]).alias("form")),
    )
    return F.when(text.rlike(CANDIDATE), found.cast(kind)).otherwise(F.array().cast(kind))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _key(text: Column) -> Column:
    return F.md5(text)


def scan(docs: DataFrame) -> DataFrame:
    """``(key, n_<kind>, base, contexts, found)`` of each distinct text with a span or a candidate, written to the shared folder.

    ``base`` has the spans of the four kinds in their order, ``contexts`` the
    context of each, ``found`` the candidates that no base span overlaps.
    """
    rows = docs.select(_text().alias("_text")).where(F.col("_text").rlike("[0-9@]"))  # every kind and candidate holds one
    matched = rows.select("_text", *(_kept(k, F.col("_text")).alias(f"_{k}") for k in KINDS), candidates(F.col("_text")).alias("_found"))
    span = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    both = matched.select(
        _key(F.col("_text")).alias("key"), *(F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS), F.concat(*(f"_{k}" for k in KINDS)).alias("_base"), "_found"
    )
    grouped = both.groupBy("key").agg(*(F.first(c).alias(c) for c in both.columns[1:])).where("size(_base) > 0 or size(_found) > 0")
    clear = F.filter("_found", lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return materialize(grouped.select("key", *(f"n_{k}" for k in KINDS), F.transform("_base", span).cast(_SPAN).alias("base"), "_base", clear.alias("found")), "pii-scan")


def bootstrap(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(context, worth, support)`` of contexts that announce identifiers, from the rows of ``scan``.

    The graph links distinct instances to their contexts and forms. It holds
    sums, not texts, and is written to the shared folder once. Spans of the
    four kinds are seeds, with contexts but without forms. A context is
    accepted with at least ``SUPPORT`` distinct instances, a candidate among
    them, and a score of ``ACCEPT``, or of ``ACCEPT_PLAIN`` if it doesn't end
    with a sign of assignment.
    """
    tokens = scanned.select(F.explode("found").alias("c")).select(F.xxhash64("c.m").alias("instance"), "c.context", "c.form")
    entities = scanned.select(F.explode("_base").alias("c")).select(F.xxhash64("c.kind", "c.m").alias("instance"), "c.context", F.lit(None).cast("string").alias("form"))
    word = F.regexp_extract("context", "^([a-z_]+)", 1)
    seed = (word.isin(*SEED_WORDS) & F.col("context").rlike("[:=]")) | F.col("form").isNull()
    edges = tokens.unionByName(entities).where("context <> ''").groupBy("instance", "context", "form").agg(F.count("*").alias("n"))
    graph = materialize(edges.select("instance", "context", "form", seed.cast("double").alias("seed")), "pii-graph")
    links = graph.select("instance", "context")
    nodes = materialize(graph.groupBy("instance").agg(F.max("seed").alias("seed"), F.max("form").alias("form")), "pii-nodes")
    scores, contexts = nodes.select("instance", F.col("seed").alias("score")), None
    for _ in range(rounds):
        # a context or form is worth the mean score of its instances; few instances count for less
        worth = (F.sum("score") / (F.count("*") + 1)).alias("worth")
        real = F.max(F.when(F.col("form").isNotNull(), 1).otherwise(0)).alias("real")
        scored = nodes.join(scores, "instance")
        contexts = materialize(links.join(scored, "instance").groupBy("context").agg(worth, F.count("*").alias("support"), real), "pii-contexts")
        forms = scored.where("form is not null").groupBy("form").agg(worth.alias("f"))  # bounded, see _form
        # an instance is worth its best context and its form together, a seed stays a seed
        best = links.join(contexts, "context").groupBy("instance").agg(F.max("worth").alias("c"))
        reached = nodes.join(best, "instance").join(F.broadcast(forms), "form", "left")
        score = F.greatest("seed", 1 - (1 - F.col("c")) * (1 - F.coalesce("f", F.lit(0.0))))
        scores = materialize(reached.select("instance", score.alias("score")), "pii-scores")
    least = F.when(F.col("context").rlike(r"[:=][\s\"'#]*$"), ACCEPT).otherwise(ACCEPT_PLAIN)
    return contexts.where((F.col("worth") >= least) & (F.col("support") >= SUPPORT) & (F.col("real") == 1)).select("context", "worth", "support")


def find_spans(docs: DataFrame, scanned: DataFrame, contexts: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``_base`` and ``_found``, arrays of (kind, start, end) in code points, end exclusive, and ``_n_<kind>``.

    ``_base`` has the four kinds in their order, ``_found`` the identifiers
    after an accepted context that no base span overlaps. A null text counts
    as empty. Spark broadcasts what was found if it is small enough, and
    else joins it by the text's key.
    """
    named = scanned.select("key", F.explode("found").alias("c")).select("key", "c.context", F.struct(F.lit(OTHER).alias("kind"), F.col("c.start").alias("start"), F.col("c.end").alias("end")).alias("s"))
    # a context stands once; a semi join never broadcasts the exploded side, whose size Spark tells too low
    named = named.join(contexts.select("context"), "context", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list("s")).cast(_SPAN).alias("_found"))
    none = F.array().cast(_SPAN)
    known = scanned.select("key", F.col("base").alias("_base"), *(F.col(f"n_{k}").alias(f"_n_{k}") for k in KINDS)).join(named, "key", "left").where("size(_base) > 0 or _found is not null")
    # left rows keep their own columns under one name, so clashing names meet nothing
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _key(_text()).alias("_text_key"))
    joined = rows.join(known, F.col("_text_key") == F.col("key"), "left")
    return joined.select("_row", F.coalesce("_base", none).alias("_base"), F.coalesce("_found", none).alias("_found"), *(F.coalesce(f"_n_{k}", F.lit(0).cast("bigint")).alias(f"_n_{k}") for k in KINDS))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of every row.

    Null texts count as empty and have no spans; repeated rows are kept, each
    with its spans; an empty table gives no rows.
    """
    scanned = scan(docs)
    rows = find_spans(docs.select("doc_id", "text"), scanned, bootstrap(scanned))
    return rows.select(
        F.col("_row.doc_id").alias("doc_id"),
        *(F.col(f"_n_{k}").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.concat("_base", "_found")).alias("spans"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets, and n_chars counted anew.

    Overlapping spans are masked as one. Texts without spans, nulls among
    them, stay as they are.
    """
    names = docs.columns
    scanned = scan(docs)
    rows = find_spans(docs, scanned, bootstrap(scanned)).withColumn("_text", F.coalesce("_row.text", F.lit("")))
    order = F.array_sort(F.transform(F.concat("_base", "_found"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    kind = "array<struct<start:int,end:int,kind:string>>"

    def join(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        overlaps = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(-1)) > s["start"])
        return F.when(overlaps, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)).cast(kind)).otherwise(F.concat(done, F.array(s)).cast(kind))

    rows = rows.withColumn("_order", order).withColumn("_spans", F.when(F.size("_order") > 0, F.aggregate("_order", F.array().cast(kind), join)).otherwise(F.array().cast(kind)))
    pieces = F.transform(
        "_spans",
        lambda s, i: F.concat(
            F.substring(F.col("_text"), F.coalesce(F.get(F.col("_spans"), i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(F.col("_spans"), i - 1)["end"], F.lit(0))),
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
        ),
    )
    tail = F.expr("substring(_text, element_at(_spans, -1).end + 1)")
    masked = rows.withColumn("_masked", F.when(F.size("_spans") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("_row.text")))
    new = {"text": F.col("_masked")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.size("_spans") > 0, F.length("_masked").cast("bigint")).otherwise(F.col("_row.n_chars"))
    return masked.select(*(new.get(n, F.col("_row")[n]).alias(n) for n in names))
