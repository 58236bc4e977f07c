"""Labelled learning pages: layouts of common sites, filled with lines of real texts.

Every element that holds text of the article carries ``MARK``; what the
extractor learns from are tags, class words and the text itself, never the
mark. Furniture is filled with lines of the same kind as articles, so that
length and wording alone don't give it away.
"""

from __future__ import annotations

import html as entities
import random

MARK = "data-main"

# Words that sites use in class and id for parts that are no article, and phrases in them.
PARTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav pagination pager tabs links toc",
    "header": "header masthead topbar site-header branding logo banner page-header tagline",
    "footer": "footer site-footer copyright legal bottom colophon page-footer imprint",
    "side": "sidebar aside rail widget related recommended popular trending more-stories teaser tags author-box right-column secondary",
    "ad": "ad ads advert advertisement adbox ad-slot adsbygoogle sponsored sponsor promo promotion commercial",
    "notice": "notice cookie cookies cookie-banner consent gdpr alert popup modal overlay disclaimer message paywall warning announcement",
    "form": "form newsletter subscribe signup login search contact search-form mailing-list poll",
    "comment": "comments comment comment-list reader-comments discussion replies reply respond disqus feedback responses thread",
    "share": "share social sharing social-links follow buttons toolbar print",
}
PHRASES = {
    "nav": ["Home", "About", "Contact", "News", "Products", "Archive", "Next", "Previous"],
    "header": ["Welcome", "Your daily source", "Log in", "Menu"],
    "footer": ["Copyright 2024", "© 2023 All rights reserved", "Privacy policy", "Terms of use", "Imprint"],
    "side": ["Related articles", "Most read", "Recommended for you", "About the author", "Tags"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer", "50 % off"],
    "notice": ["We use cookies to improve this site.", "This site uses cookies. Accept", "Please enable JavaScript.", "Your privacy matters to us."],
    "form": ["Subscribe to our newsletter", "Your e-mail", "Name", "Search", "Sign up"],
    "comment": ["Comments (12)", "Reply", "3 comments", "Leave a comment", "Posted by guest at 10:15"],
    "share": ["Share on social media", "Tweet", "Print", "E-mail this"],
}
TAGS = {
    "nav": ["nav", "div", "ul"],
    "header": ["header", "header", "div"],
    "footer": ["footer", "footer", "div"],
    "side": ["aside", "aside", "div", "section"],
    "ad": ["div", "aside", "section", "div"],
    "notice": ["div", "section", "p", "aside"],
    "form": ["form", "form", "div"],
    "comment": ["section", "div", "ol", "ul", "article"],
    "share": ["div", "ul"],
}
BODIES = ["article", "article", "article", "main", "main", "div.content", "div.post", "div.entry-content", "div.story", "section.article-body", "div#main", "div.text", "div", "section", "td", "div.page", "div.post-content"]
WORDS = frozenset("cookie cookies privacy copyright rights reserved subscribe newsletter login log sign share comment comments reply posted advertisement sponsored terms search related menu home contact imprint".split())


def _said(text: str) -> str:
    return entities.escape(" ".join(text.split()), quote=False)


def _open(tag: str, name: str, rng: random.Random) -> str:
    where = rng.choice(["class", "class", "class", "id"])
    return f'<{tag} {where}="{name}">' if name else f"<{tag}>"


def _furniture(kind: str, lines: list[str], rng: random.Random) -> str:
    """One part that is no article."""
    tag = rng.choice(TAGS[kind])
    plain = rng.random() < 0.4 and tag in ("nav", "header", "footer", "aside", "form")
    name = "" if plain else rng.choice(PARTS[kind].split())
    said = lambda: _said(rng.choice(lines) if rng.random() < 0.6 else rng.choice(PHRASES[kind]))
    if tag in ("ul", "ol"):
        inner = "".join(f'<li><a href="#">{_said(" ".join(said().split()[:2]))}</a></li>' if kind != "comment" else f"<li>{_paragraphs(said, rng)}</li>" for _ in range(rng.randrange(2, 7)))
    elif kind == "nav":
        inner = "<ul>" + "".join(f'<li><a href="/{i}">{_said(rng.choice(rng.choice(lines).split() or ["x"]))}</a></li>' for i in range(rng.randrange(3, 8))) + "</ul>"
    elif kind == "form":
        inner = f'<label>{said()}</label><input name="q"><p>{said()}</p>' + ("<button>Send</button>" if rng.random() < 0.5 else "")
    elif tag == "p":
        inner = said()
    else:
        head = f"<h{rng.choice('1234')}>{said()}</h{rng.choice('1234')}>" if rng.random() < 0.3 else ""
        inner = head + (_paragraphs(said, rng) if rng.random() < 0.6 else said())
        if kind in ("side", "share", "footer", "header") and rng.random() < 0.5:
            inner += "<ul>" + "".join(f'<li><a href="#">{said()}</a></li>' for _ in range(rng.randrange(1, 5))) + "</ul>"
    return _open(tag, name, rng) + inner + f"</{tag}>"


def _paragraphs(said, rng: random.Random) -> str:
    return "".join(f"<{t}>{said()}</{t}>" for t in rng.choices(["p", "p", "p", "div", "h4"], k=rng.randrange(1, 4)))


def _article(lines: list[str], rng: random.Random, parts: list[str]) -> str:
    """The article; ``parts`` are furniture that stands inside it."""
    out = []
    if rng.random() < 0.8:
        head = f"<h1 {MARK}=1>{_said(lines[0][:60])}</h1>"
        out.append(f"<header>{head}</header>" if rng.random() < 0.15 else head)
    for line in lines:
        text = _said(line)
        words = text.split(" ")
        if rng.random() < 0.2 and len(words) > 4 and "&" not in text:
            i = rng.randrange(len(words) - 2)
            words[i : i + 2] = [f'<{(t := rng.choice(["b", "em", "a", "span"]))}{" href=#" if t == "a" else ""}>{words[i]} {words[i + 1]}</{t}>']
            text = " ".join(words)
        kind = rng.random()
        if kind < 0.7:
            out.append(f"<p {MARK}=1>{text}" + ("</p>" if rng.random() < 0.9 else ""))
        elif kind < 0.76:
            out.append(f"<h2 {MARK}=1>{_said(line[:40])}</h2>")
        elif kind < 0.82:
            out.append(f"<ul><li {MARK}=1>{text}</li><li {MARK}=1>{text}</li></ul>")
        elif kind < 0.87:
            out.append(f"<blockquote {MARK}=1>{text}</blockquote>" if rng.random() < 0.5 else f"<blockquote><p {MARK}=1>{text}</p></blockquote>")
        elif kind < 0.9:
            out.append(f"<figure><img src=x><figcaption {MARK}=1>{text}</figcaption></figure>")
        elif kind < 0.93:
            out.append(f"<table><tr><td {MARK}=1>{_said(line[:20])}</td><td {MARK}=1>{_said(line[20:40])}</td></tr></table>")
        elif kind < 0.95:
            out.append(f"<pre {MARK}=1>{text}</pre>")
        else:
            out.append(f"<div {MARK}=1>{text}</div>")
    for part in parts:
        out.insert(rng.randrange(1, len(out) + 1), part)
    body = rng.choice(BODIES)
    tag, sign, name = body.partition("#") if "#" in body else body.partition(".")
    whole = (f'<{tag} {"id" if sign == "#" else "class"}="{name}">' if sign else f"<{tag}>") + "".join(out) + f"</{tag}>"
    if rng.random() < 0.05:
        whole = "".join(out)
    elif tag == "td":
        whole = f"<table><tr>{whole}</tr></table>"
    return whole


def page(lines: list[str], others: list[str], rng: random.Random) -> str:
    """A labelled page whose article is ``lines``, its furniture filled from ``others``."""
    many = lambda kinds, chance: [_furniture(k, others, rng) for k in kinds if rng.random() < chance]
    before = many(["notice"], 0.3) + many(["header"], 0.6) + many(["nav"], 0.7) + many(["ad", "notice", "form", "side", "nav"], 0.2)
    inside = many(["ad", "share", "side", "notice", "form", "nav"], 0.15)
    after = many(["share", "ad", "side", "form"], 0.3) + many(["comment"], 0.6) + many(["side", "ad", "notice"], 0.25) + many(["footer"], 0.8) + many(["notice"], 0.1)
    if rng.random() < 0.12:  # a bare page
        before = inside = after = []
    middle = _article(lines, rng, inside)
    if rng.random() < 0.4:
        middle = f'<div class="{rng.choice(["wrapper", "container", "row", "layout", "x1", "site"])}">{"".join(before)}{middle}{"".join(after)}</div>'
    else:
        middle = "".join(before) + middle + "".join(after)
    return f"<!DOCTYPE html><html><head><title>{_said(lines[0][:60])}</title><style>p{{margin:0}}</style></head><body>{middle}" + ("</body></html>" if rng.random() < 0.9 else "")
