"""Text functions over columns. ``\\b`` is written with ASCII lookarounds: Java counts accented letters as word letters."""

from __future__ import annotations

import json
import unicodedata
from functools import cache
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.handles import digits, trim_space

LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Words without content, in two languages.
STOP = (
    "the and for with that this from have has had was were are you your our their them they she him her his its but not all any can will would should could about into over then than just also been more some "
    "what when who how why a an to of in on at by or as is it be we i me my mi el la los las de del y o en un una con por para que se su sus lo al es"
).split()
#: Texts that say nothing, and bare acknowledgements.
NOISE = [
    "thanks", "thank you", "thanks so much", "thank you so much", "thx", "ty", "tysm", "thanks man", "thank u", "many thanks", "lol", "lmao", "rofl", "hi", "hello", "hey", "hey there", "yo", "bye", "good night",
    "goodnight", "gn", "good morning", "gm", "morning", "night", "you too", "same to you", "np", "no problem", "no worries", "welcome", "youre welcome", "love you", "ily", "miss you", "xoxo", "see you", "see ya",
    "cya", "ttyl", "congrats", "congratulations", "happy birthday", "nice", "wow", "omg", "gracias", "muchas gracias", "mil gracias", "gracias a ti", "hola", "buenas", "buenos dias", "buenas tardes",
    "buenas noches", "chao", "chau", "adios", "de nada", "igualmente", "besos", "un beso", "abrazo", "un abrazo", "te quiero", "nos vemos", "felicidades", "feliz cumpleanos", "jaja", "jeje", "jiji", "que bien", "genial",
]
ACKS = [
    "ok", "okay", "okk", "k", "kk", "oki", "okey", "yes", "yeah", "yep", "yup", "ya", "sure", "of course", "cool", "great", "perfect", "awesome", "got it", "sounds good", "will do", "on it", "done", "noted",
    "agreed", "deal", "for sure", "absolutely", "ok thanks", "ok thank you", "ok great", "ok cool", "no", "nope", "not yet", "si", "sip", "claro", "dale", "listo", "vale", "va", "sale", "perfecto", "bueno",
    "de acuerdo", "entendido", "excelente", "super", "ok gracias", "hecho", "todavia no", "aun no",
]
#: Legal forms at the end of a company's name.
LEGAL = "inc incorporated llc ltd limited corp corporation co company plc gmbh ag sa sas srl sl bv pty pte".split()
#: What a request, a reaction, a code and a placeholder in a calendar look like.
REQUEST = r"(?i)\?\s*$|" + LEFT + r"(can you|could you|would you|will you|please|pls|let me know|lmk|send me|are you able|puedes|podrías|podrias|por favor|me mandas|me envías|me envias|avísame|avisame|me confirmas)" + RIGHT
REACTION = r"(?i)^(liked|loved|laughed at|emphasized|questioned|disliked|reacted\s+\S{1,12}\s+to|le gustó|le encantó|se rió de|enfatizó|cuestionó|no le gustó|reaccionó\s+\S{1,12}\s+a)\s+[“\"'«]"
CODE = r"(?i)(verification|security|login|sign.?in|one.?time|confirmation|access)\s+code|code is\s*:?\s*\d{4,}|código( de verificación)?\s*(es)?\s*:?\s*\d{4,}|" + LEFT + r"\d{4,8}" + RIGHT + " is your"
CALENDAR_NOISE = (
    r"(?i)^(busy|hold|on hold|blocked?|block|focus( time| block)?|deep work|lunch|breakfast|dinner|ooo|out of office|commute|travel( time)?|gym|workout|personal|private|tentative|free|available|do not book|dnd|no meetings?|"
    r"home|school pickup|pickup|ocupado|bloqueado|almuerzo|comida|cena|privado|gimnasio|traslado)$"
)
CALENDAR_PREFIX = r"(?i)^(canceled|cancelled|cancelado|declined|rechazado|updated invitation|invitation|accepted|tentatively accepted|invitación|invitacion|aceptado|aceptada)(?![A-Za-z0-9_])\s*:?"
#: Hangul syllables are spelled by arithmetic: first and last of them, first letters of their three parts, number of second and third ones.
_SYLLABLES, _JAMO, _VOWELS, _FINALS = (0xAC00, 0xD7A3), (0x1100, 0x1161, 0x11A7), 21, 28


@cache
def folds() -> tuple[str, str, dict[str, str]]:
    """Unicode's compatible decomposition without combining accents, Hangul apart.

    Characters that become one other, and what; then those that vanish stand
    at the end of the first text alone; and those that become several.
    """
    one, gone, several = {}, "", {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)):
        c = chr(code)
        if _SYLLABLES[0] <= code <= _SYLLABLES[1]:
            continue
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)
        if d == "":
            gone += c
        elif len(d) > 1:
            several[c] = d
        elif d != c:
            one[c] = d
    return "".join(one) + gone, "".join(one.values()), several


def _ranges(characters: list[str]) -> str:
    """Characters as a class of a regular expression."""
    out, codes = "", sorted(map(ord, characters))
    for _, run in groupby(enumerate(codes), lambda x: x[1] - x[0]):
        span = [c for _, c in run]
        out += f"\\x{{{span[0]:x}}}-\\x{{{span[-1]:x}}}"
    return f"[{out}]"


@cache
def _spelling() -> tuple[str, str, str, str, str, str]:
    """What ``fold_accents`` names: the table from and to, several-letter forms as JSON, classes of what is cut apart, of syllables, of what may need cutting."""
    narrow, wide, several = folds()
    syllable = f"[\\x{{{_SYLLABLES[0]:x}}}-\\x{{{_SYLLABLES[1]:x}}}]"
    rare = _ranges([x for x in several if x < "\u0250"])[:-1] + r"\x{250}-\x{10ffff}]"  # spares texts in Latin letters the long list
    return narrow, wide, json.dumps(several, ensure_ascii=False), f"{_ranges([*several])}|{syllable}", syllable, rare


def fold_accents(c: Column) -> Column:
    """Letters without their accents, and other forms as the plain ones: all of Unicode's compatible decomposition (NFKD) without combining accents.

    Plain ASCII passes as it is, most other texts by one table of characters;
    only texts with a character that becomes several are cut apart.
    """
    narrow, wide, several, odd, syllable, rare = _spelling()
    spelled = F.from_json(F.lit(several), "map<string,string>")
    letter = lambda code: F.decode(F.unhex(F.hex(code)), "UTF-16BE")
    code = lambda x: F.conv(F.hex(F.encode(x, "UTF-16BE")), 16, 10).cast("int") - _SYLLABLES[0]
    final = lambda x: F.when(code(x) % _FINALS > 0, letter(F.lit(_JAMO[2]) + code(x) % _FINALS)).otherwise("")
    jamo = lambda x: F.concat(letter(F.lit(_JAMO[0]) + F.floor(code(x) / (_VOWELS * _FINALS)).cast("int")), letter(F.lit(_JAMO[1]) + F.floor(code(x) % (_VOWELS * _FINALS) / _FINALS).cast("int")), final(x))
    apart = lambda x: F.when(x.rlike(syllable), jamo(x)).otherwise(F.coalesce(F.try_element_at(spelled, x), x))
    pieces = F.regexp_extract_all(c, F.lit(f"(?s)(?:{odd})|(?:(?!{odd}).)+"), F.lit(0))
    whole = F.when(c.rlike(rare) & c.rlike(odd), F.array_join(F.transform(pieces, lambda x: F.when(F.length(x) == 1, apart(x)).otherwise(x)), "")).otherwise(c)
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.translate(whole, narrow, wide)).otherwise(c)


def name_norm(c: Column) -> Column:
    """Folded, lower-cased, letters and digits only, single-spaced."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), r"[^\p{L}\p{N} ]+", " "), " +", " "))


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(name_norm(c), " "), lambda t: t != "")


def privacy_fold(c: Column) -> Column:
    """Folded and lower-cased, with the signs that privacy rules look at."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), r"[^\p{L}\p{N}@.\-+$*#'\":=/ ]+", " "), r"\s+", " "))


def looks_like_handle(c: Column) -> Column:
    return c.contains("@") | c.rlike(r"^[+()\d\s.-]{6,}$")


def one_line(c: Column) -> Column:
    return trim_space(F.regexp_replace(c, r"\s+", " "))


def title_case(c: Column) -> Column:
    parts = F.split(c, r"(?<=[ \-\"'])")
    return F.array_join(F.transform(parts, lambda t: F.concat(F.upper(F.left(t, F.lit(1))), F.substr(t, F.lit(2)))), "")


def clean_dashes(c: Column) -> Column:
    s = F.regexp_replace(c, r"\s*(?:[—–]|(?<=\s)--(?=\s))\s*", ", ")
    return trim_space(F.regexp_replace(F.regexp_replace(s, r"(,\s*){2,}", ", "), r",\s*([.!?;:])", "$1"))


def ensure_sentence(c: Column) -> Column:
    s = one_line(c)
    first = F.concat(F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2)))
    return F.when(s == "", s).when(s.rlike(r"[.!?…]$"), first).otherwise(F.concat(first, F.lit(".")))


def safe_file_name(c: Column, most: int = 90) -> Column:
    s = one_line(F.regexp_replace(c, r"[\\/:*?\"<>|#^\[\]]", " "))
    cut = F.left(s, F.lit(most))
    return F.when(F.length(s) <= most, s).otherwise(F.coalesce(F.nullif(F.regexp_extract(cut, r"^(.*)\s\S*$", 1), F.lit("")), cut))


def slug_tag(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("n"), s)).otherwise(s)


def trim_words(c: Column, most: int) -> Column:
    """Cut at a word boundary, with an ellipsis."""
    t = trim_space(c)
    cut = F.left(t, F.lit(most))
    space = F.length(cut) - F.locate(" ", F.reverse(cut))
    at_word = F.when((F.locate(" ", F.reverse(cut)) > 0) & (space > most * 0.7), F.left(cut, space)).otherwise(cut)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(at_word, r"[\s,;:.]+$", ""), F.lit("…")))


def content_words(c: Column) -> Column:
    stop = F.array(*map(F.lit, STOP))
    return F.array_distinct(F.filter(name_tokens(c), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct words; two empty ones are equal."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - common
    return F.when(both == 0, 1.0).otherwise(common / both)


def company_key(c: Column) -> Column:
    """Normalised company name without up to two legal forms at its end."""
    ending = r"\s+(" + "|".join([*LEGAL, "sa de cv", "s de rl"]) + r")$"
    return F.regexp_replace(F.regexp_replace(name_norm(c), ending, ""), ending, "")


def fingerprint(*parts: Column) -> Column:
    """Sixteen hex digits over normalised parts."""
    clean = [F.trim(F.regexp_replace(F.lower(fold_accents(F.coalesce(p.cast("string"), F.lit("")))), "[^a-z0-9]+", " ")) for p in parts]
    return F.left(F.sha1(F.concat_ws("|", *clean)), F.lit(16))


def record_hash(*parts: str) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def norm_subject(c: Column) -> Column:
    return name_norm(F.regexp_replace(trim_space(c), r"(?i)^((re|fw|fwd|rv|aw)\s*:\s*)+", ""))


def clean_email_text(c: Column) -> Column:
    """What the sender wrote: cut at the first reply, forward or signature mark behind the start, quoted lines dropped."""
    marks = [
        r"(?m)^\s*On .{5,300}wrote:\s*$",
        r"(?m)^\s*El .{5,300}escribió:\s*$",
        r"(?im)^\s*-{2,}\s*(Original Message|Mensaje original|Forwarded message|Mensaje reenviado)\s*-{2,}",
        r"(?m)^\s*From:\s.+\n\s*(Sent|Date):\s",
        r"(?m)^\s*De:\s.+\n\s*(Enviado|Fecha):\s",
        r"(?m)^--\s*$",
        r"(?im)^\s*(Sent from my|Enviado desde mi|Get Outlook for)(?![A-Za-z0-9_])",
    ]
    def cut(s: Column, mark: Column) -> Column:
        at = F.regexp_instr(s, mark)
        return F.when(at > 1, F.left(s, at - 1)).otherwise(s)

    s = F.aggregate(F.array(*map(F.lit, marks)), F.regexp_replace(c, r"\r\n?", "\n"), cut)
    lines = F.array_join(F.filter(F.split(s, "\n"), lambda x: ~x.rlike(r"^\s*>")), "\n")
    return trim_space(F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def html_to_text(c: Column) -> Column:
    """Visible text of a page: scripts and styles dropped, blocks on lines of their own, common entities decoded."""
    s = F.regexp_replace(c, r"(?is)<(script|style|head)[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/ul|/ol|/table)\b[^>]*>", "\n")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(sign))
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t\u00a0]+", " "), r" ?\n ?", "\n")
    return trim_space(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def clean_text(c: Column) -> Column:
    s = F.regexp_replace(c, r"[\u0000\u200e\u200f\u202a-\u202e\u2066-\u2069\ufffc\ufeff]", "")
    return trim_space(F.regexp_replace(F.regexp_replace(s, r"\r\n?", "\n"), r"\n{3,}", "\n\n"))


def sanitize_text(c: Column) -> Column:
    """Mail addresses, phones and home folders replaced by their kind; ISO times stay."""
    s = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    s = F.regexp_replace(s, r"/(?:Users|home)/[^/\s]+", "~")
    return F.regexp_replace(s, r"(?<![\dT:.-])\+?\d[\d ().-]{7,}\d(?![\dT:Z-])", "[phone]")


def classify_message(c: Column) -> Column:
    """``noise``, ``ack`` or ``content``."""
    t = trim_space(F.coalesce(c, F.lit("")))
    core = name_norm(t)
    laugh = F.replace(core, F.lit(" "), F.lit("")).rlike("^((ha|ja|je|ji|he|hi)+h?|lol+|xd+)$")
    noise = (t == "") | t.rlike(REACTION) | (F.length(core) < 2) | core.isin(NOISE) | laugh | ((F.length(t) < 220) & t.rlike(CODE))
    return F.when(noise, "noise").when(core.isin(ACKS), "ack").otherwise("content")


def is_request(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(REQUEST)


def is_calendar_noise(c: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(one_line(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N} ]+", " "), r"\s+", " "))
    return (plain == "") | plain.rlike(CALENDAR_NOISE) | one_line(F.coalesce(c, F.lit(""))).rlike(CALENDAR_PREFIX)


def iban_valid(c: Column) -> Column:
    """IBAN checksum: the remainder by 97 of the moved digits is 1."""
    s = F.upper(F.regexp_replace(c, r"\s+", ""))
    moved = F.concat(F.substr(s, F.lit(5)), F.left(s, F.lit(4)))
    step = lambda acc, ch: F.when(ch.rlike("[A-Z]"), (acc * 100 + F.ascii(ch) - 55) % 97).otherwise((acc * 10 + F.coalesce(ch.try_cast("int"), F.lit(0))) % 97)
    return F.length(s).between(15, 34) & s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), step) == 1)


def luhn_valid(c: Column) -> Column:
    return F.call_function("luhn_check", digits(c))


def transcript_text(turns: Column) -> Column:
    """Turns of (speaker, text) as lines; empty ones are dropped."""
    kept = F.filter(turns, lambda t: F.coalesce(F.trim(t["text"]), F.lit("")) != "")
    return F.array_join(F.transform(kept, lambda t: F.concat(F.coalesce(F.nullif(t["speaker"], F.lit("")), F.lit("Unknown")), F.lit(": "), F.trim(t["text"]))), "\n")


def address_list(c: Column) -> Column:
    """``Name <mail>`` entries of a comma list as (handle, name); entries without an address are dropped."""
    from threadloom.functions.handles import email_handle

    name = lambda p: F.regexp_extract(F.trim(p), r"^\"?(.*?)\"?\s*<[^>]+>$", 1)
    one = lambda p: F.struct(email_handle(p).alias("handle"), F.nullif(F.trim(name(p)), F.lit("")).alias("name"))
    return F.filter(F.transform(F.split(c, ","), one), lambda p: p["handle"].isNotNull())


def source_of_ref(c: Column) -> Column:
    return F.substring_index(c, ":", 1)


def speakers(c: Column) -> Column:
    """Distinct names before a colon at the start of a line."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?m)^([^:\n]{1,60}):\s"), F.lit(1)))


def section_text(c: Column, start: str, end: str) -> Column:
    """Text between two marks, null without both."""
    found = F.regexp_extract(c, f"(?s){start}(.*?){end}", 1)
    return F.when(c.rlike(f"(?s){start}.*?{end}"), trim_space(found))
