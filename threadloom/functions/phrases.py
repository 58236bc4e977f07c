"""Many phrases as one regular expression in the shape of a trie, so a text is read once whatever their number.

A phrase is plain words. In it ``#`` is a digit, ``~`` a word that ends in s,
and ``{a|b}`` stands for each of its choices (one may be empty).
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import fold_accents

_WORD = "[A-Za-z0-9_]"
_SLOTS = {"#": "[0-9]", "~": r"[A-Za-z0-9_]+'?s"}


def spelled(phrases: list[str]) -> list[str]:
    """Every phrase that the choices of a list stand for, in order."""
    out = []
    for p in phrases:
        parts = [x.split("|") if i % 2 else [x] for i, x in enumerate(re.split(r"[{}]", p))]
        out += ["".join(x) for x in product(*parts)]
    return list(dict.fromkeys(out))


def _branches(node: dict) -> str:
    ways = [token + _branches(rest) for token, rest in node.items()]
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""


def trie(phrases: list[str]) -> str:
    """A pattern of all phrases where they stand as words of their own; signs at their ends must touch a word."""
    root: dict = {}
    for p in spelled(phrases):
        edge = f"(?!{_WORD})" if re.match(r"\w|#|~", p[-1]) else f"(?={_WORD})"
        node = root
        for token in [*(_SLOTS.get(c) or re.escape(c) for c in p), edge]:
            node = node.setdefault(token, {})
    return f"(?<!{_WORD})" + _branches(root)


def holds(c: Column, phrases: list[str]) -> Column:
    """Whether a folded text holds one of the phrases."""
    return c.rlike(trie(phrases))


def fold(c: Column) -> Column:
    """Lower case without accents, and with no signs but those that rules look at; single spaces."""
    plain = F.regexp_replace(F.lower(fold_accents(F.coalesce(c, F.lit("")))), r"[^a-z0-9@.\-+$*#':=]+", " ")
    return F.trim(plain)


def fold_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))
