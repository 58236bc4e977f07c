"""License scans by template-markup matching.

A template is a line of words with markup: ``[ ... ]`` is a region that may be
left out, ``{n}`` a region that may be replaced by up to n words of any kind,
``{*}`` one by any number of words, up to the mandatory word that follows.
It is compiled to an automaton over tokens; a text holds the license if the
automaton accepts a run of its words, that is if all mandatory wording
stands there exactly, from the first word to the last. ``TEXTS`` has whole
licenses, so kin such as two and three clauses are told apart; ``NOTICES``
has lines that only name one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from threadloom.llm.text import per_batch

#: Phrases and labels of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal in the software "
    "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so"
)
_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
    "purpose and noninfringement in no event shall [the] {*} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
    "from out of or in connection with the software or the use or other dealings in the software"
)
_REDISTRIBUTION = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] [a] redistributions of "
    "source code must retain the above copyright notice this list of conditions and the following disclaimer [2] [b] redistributions in binary form must reproduce the above "
    "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_AS_IS = (
    "this software is provided by {*} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a "
    "particular purpose are disclaimed in no event shall {*} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited "
    "to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
    "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GNU = (
    "is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software "
    "foundation either version {{2}} of the license or at your option any later version {{*}} is distributed in the hope that it will be useful but without any warranty without "
    "even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0}general public license for more details"
)
_CREATIVE = "licensed under [a] [the] creative commons attribution {0}[1 0] [2 0] [2 5] [3 0] [4 0] [unported] [international] [public] license"
#: The whole mandatory wording of public licenses and of the notices they prescribe, with their labels.
TEXTS = {
    "mit": [f"{_GRANT} subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software {_AS_IS}"],
    "mit-0": [f"{_GRANT} {_AS_IS}"],
    "bsd-2-clause": [f"{_REDISTRIBUTION} {_BSD_AS_IS}"],
    "bsd-3-clause": [f"{_REDISTRIBUTION} [3] [c] neither the name of {{*}} nor the names of {{*}} contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_AS_IS}"],
    "isc": [
        "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and {*} disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall {*} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use "
        "data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {*} "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any "
        "kind either express or implied see the license for the specific language governing permissions and limitations under the license"
    ],
    "gpl": [_GNU.format("")],
    "lgpl": [_GNU.format("lesser "), _GNU.format("library ")],
    "agpl": [_GNU.format("affero ")],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"],
}
#: One-line notices that name a license; they don't count behind a negation in the same sentence.
NOTICES = {
    "mit": ["[released] [licensed] under the [terms of the] mit license"],
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "gpl": ["licensed under the [terms of the] gnu general public license"],
    "lgpl": ["licensed under the [terms of the] gnu lesser general public license", "licensed under the [terms of the] gnu library general public license"],
    "agpl": ["licensed under the [terms of the] gnu affero general public license"],
    "cc-by-nc-sa": ["licensed under [a] [the] [creative commons] cc by nc sa", _CREATIVE.format("noncommercial sharealike "), _CREATIVE.format("non commercial share alike ")],
    "cc-by-nc-nd": ["licensed under [a] [the] [creative commons] cc by nc nd", _CREATIVE.format("noncommercial noderivatives "), _CREATIVE.format("non commercial no derivatives ")],
    "cc-by-nc": ["licensed under [a] [the] [creative commons] cc by nc", _CREATIVE.format("noncommercial "), _CREATIVE.format("non commercial ")],
    "cc-by-sa": ["licensed under [a] [the] [creative commons] cc by sa", _CREATIVE.format("sharealike "), _CREATIVE.format("share alike ")],
    "cc-by-nd": ["licensed under [a] [the] [creative commons] cc by nd", _CREATIVE.format("noderivatives "), _CREATIVE.format("no derivatives ")],
    "cc-by": [_CREATIVE.format(""), "licensed under [a] [the] cc by"],
    "reserved": ["copyright [c] {8} all rights reserved"],
}
NEGATIONS = frozenset(b"not never cannot nor neither t".split())
#: Kinds of a license that a notice of another may be the beginning of.
KINDS = {"cc-by": ("cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"), "cc-by-nc": ("cc-by-nc-sa", "cc-by-nc-nd")}
_SENTENCE = re.compile(rb"[.!?;]+(?=\s|$)|\n\s*\n")
#: Scores of a text's best finding.
WHOLE, NOTICE, PHRASE = 1.0, 0.8, 0.5

_NOT_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased: digits, a-z and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_NOT_WORD).split()


class Automaton:
    """States and moves of one template; state 0 begins, ``end`` accepts."""

    def __init__(self, template: str):
        self.word: dict[int, dict[bytes, int]] = {}
        self.any: dict[int, int] = {}
        self.skip: dict[int, list[int]] = {}
        self.states = 1
        self.must: list[bytes] = []
        parts = re.findall(r"\[|\]|\{(?:\d+|\*)\}|[^\s\[\]{}]+", template)
        self.end = self._build(parts, 0, 0, True)[0]
        begin = self.closed({0})
        self.first, self.anywhere = self.words_from(begin), any(s in self.any for s in begin)

    def _state(self) -> int:
        self.states += 1
        return self.states - 1

    def _build(self, parts: list[str], i: int, state: int, must: bool) -> tuple[int, int]:
        while i < len(parts):
            part = parts[i]
            i += 1
            if part == "]":
                return state, i
            if part == "[":
                inner, i = self._build(parts, i, state, False)
                after = self._state()
                self.skip.setdefault(inner, []).append(after)
                self.skip.setdefault(state, []).append(after)
                state = after
            elif part[0] == "{":
                after = self._state()
                if part == "{*}":  # a state of its own that any word leads back to
                    gap = self._state()
                    self.skip.setdefault(state, []).append(gap)
                    self.any[gap] = gap
                    self.skip.setdefault(gap, []).append(after)
                    state = after
                    continue
                self.skip.setdefault(state, []).append(after)
                for _ in range(int(part[1:-1])):
                    self.any[state] = nxt = self._state()
                    self.skip.setdefault(nxt, []).append(after)
                    state = nxt
                state = after
            else:
                self.word.setdefault(state, {})[part.encode()] = nxt = self._state()
                state = nxt
                if must:
                    self.must.append(part.encode())
        return state, i

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for nxt in self.skip.get(todo.pop(), ()):
                if nxt not in states:
                    states.add(nxt)
                    todo.append(nxt)
        return states

    def words_from(self, states: set[int]) -> set[bytes]:
        return {w for s in states for w in self.word.get(s, ())}

    def holds(self, words: list[bytes], starts: list[int]) -> bool:
        """Whether the template begins at one of the places (ascending) and ends anywhere behind it; one pass, all beginnings at once."""
        begin, now, k, i = self.closed({0}), set(), 0, 0
        while i < len(words) and (now or k < len(starts)):
            if not now:
                i = max(i, starts[k])
            while k < len(starts) and starts[k] <= i:
                if starts[k] == i:
                    now = now | begin
                k += 1
            now = self.closed({n for s in now for n in (self.word.get(s, {}).get(words[i]), self.any.get(s)) if n is not None})
            if self.end in now:
                return True
            i += 1
        return False

    def found(self, words: list[bytes], at: dict[bytes, list[int]], denied: Callable[[int], bool] | None = None) -> bool:
        """Whether a text holds the template; places that ``denied`` names don't count."""
        places = range(len(words)) if self.anywhere else sorted({p for w in self.first for p in at.get(w, ())})
        return self.holds(words, [p for p in places if not (denied and denied(p))])


class Scanner:
    def __init__(self, texts: dict[str, list[str]] = TEXTS, notices: dict[str, list[str]] = NOTICES, phrases: dict[str, str] = PHRASES):
        self.automata = [(label, Automaton(t), whole) for whole, some in ((True, texts), (False, notices)) for label, lines in some.items() for t in lines]
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        # a text without all of a template's long words in its bytes needs no automaton
        self.rare = [sorted(set(a.must), key=len)[-4:] for _, a, _ in self.automata]

    @staticmethod
    def _denials(text: str) -> Callable[[int], bool]:
        """Tells whether a negation stands before a word in its sentence."""
        since: list[bool] = []
        for sentence in _SENTENCE.split(text.encode("utf-8", "surrogatepass").lower()):
            denied = False
            for w in sentence.translate(_NOT_WORD).split():
                since.append(denied)
                denied = denied or w in NEGATIONS
        return since.__getitem__

    def scan(self, text: str | None) -> tuple:
        """``(n_words, n_base, first_word, last_word, base_labels, labels, score)`` of one text."""
        low = (text or "").encode("utf-8", "surrogatepass").lower().translate(_NOT_WORD)
        words = low.split()
        places, base, added = [], set(), {}
        for phrase, label in self.phrases:
            if all(w in low for w in phrase):
                n, i = len(phrase), -1
                try:
                    while True:
                        i = words.index(phrase[0], i + 1)
                        if words[i : i + n] == phrase:
                            places.append(i)
                            base.add(label)
                except ValueError:
                    pass
        likely = [x for x, rare in zip(self.automata, self.rare, strict=True) if all(w in low for w in rare)]
        if likely:
            starts = set().union(*(a.first for _, a, _ in likely))
            at: dict[bytes, list[int]] = {}
            for i, w in enumerate(words):
                if w in starts:
                    at.setdefault(w, []).append(i)
            denials = self._denials(text or "")
            for label, a, whole in likely:
                if a.found(words, at, None if whole else denials):
                    added[label] = max(added.get(label, 0.0), WHOLE if whole else NOTICE)
            for label, kinds in KINDS.items():  # the longer name is the license's
                if added.get(label) == NOTICE and any(k in added for k in kinds):
                    del added[label]
        labels = base | set(added)
        score = max([PHRASE if base else 0.0, *added.values()])
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan_licenses(docs: DataFrame, texts: dict[str, list[str]] = TEXTS, notices: dict[str, list[str]] = NOTICES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """License phrases, notices and whole licenses in every whole text.

    ``score`` is 1 if a whole license is accepted, 0.8 for a notice, 0.5 if
    only a base phrase stands there, else 0. Null texts count as empty. Repeated rows give
    repeated results; no shuffle, one text at a time in memory.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def make():
        scanner = Scanner(texts, notices, phrases)

        def work(batch):
            rows = [scanner.scan(t) for t in batch["text"]]
            return {"doc_id": batch["doc_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return work

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return per_batch(docs.select("doc_id", "text"), make, schema)
