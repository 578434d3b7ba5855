"""License scans by template markup.

A template is the license's wording with marked regions: ``[[ … ]]`` may be missing, ``(a | b)`` is either
wording, ``{m,n}`` is replaceable by m to n words of any kind. Each is compiled to an automaton over words; a text
is accepted where the mandatory wording stands exactly, with regions filled as marked.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from creditloom.llm.base import map_rows, texts

# Phrases and labels of the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of common license texts and notices, in markup. Labels are SPDX-like names.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license]]",
    "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {0,1} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {0,1} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "cc-by-4.0": "licensed under [[a | the]] (cc by | creative commons attribution) 4 0 [[international]] [[license]]",
    "cc-by-nc-4.0": "licensed under [[a | the]] (cc by nc | creative commons attribution noncommercial | creative commons attribution non commercial) 4 0 [[international]] [[license]]",
    "cc-by-sa-4.0": "licensed under [[a | the]] (cc by sa | creative commons attribution sharealike | creative commons attribution share alike) 4 0 [[international]] [[license]]",
    "copyright-reserved": "copyright [[c]] {1,8} all rights reserved",
    "gpl-2.0": "[[this {1,3} is]] (licensed under | under the terms of) the [[gnu]] general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license or at your option any later version]]",
    "gpl-3.0": "[[this {1,3} is]] (licensed under | under the terms of) the [[gnu]] general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license or at your option any later version]]",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "(released | licensed | distributed) under the [[terms of the]] mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions [[the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software]]",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, start: int, end: int>>"
)

# A-Z to lower case, other ASCII that is no digit or letter to a space; the bytes of other characters stay.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_MARK = re.compile(r"\[\[|\]\]|\{(\d+),(\d+)\}|[(|)]|[^\s\[\](){}|]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


@dataclass
class Automaton:
    """States are numbers; ``on`` has the moves by word, ``any_word`` those by any word, ``free`` those by none."""

    on: list[dict[bytes, list[int]]] = field(default_factory=list)
    any_word: list[list[int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    first: int = 0
    last: int = 0
    required: list[bytes] = field(default_factory=list)

    def state(self) -> int:
        self.on.append({})
        self.any_word.append([])
        self.free.append([])
        return len(self.on) - 1

    def closed(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return frozenset(states)

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        after = set()
        for s in states:
            after.update(self.on[s].get(word, ()))
            after.update(self.any_word[s])
        return self.closed(after)

    def longest(self, words: list[bytes], at: int) -> tuple[int, int]:
        """Words of the longest accepted run from ``at`` (0: none), and how far the wording was followed."""
        states, best, n = self.closed({self.first}), 0, 0
        while states and at + n < len(words):
            states = self.step(states, words[at + n])
            n += bool(states)
            if self.last in states:
                best = n
            if not states:
                break
        return best, n


def compile_template(markup: str) -> Automaton:
    """The automaton of a template; ``required`` are its mandatory words outside of all regions."""
    automaton, tokens, place = Automaton(), list(_MARK.finditer(markup)), 0

    def sequence(start: int, ends: tuple[str, ...], inside: bool) -> int:
        nonlocal place
        at = start
        while place < len(tokens) and tokens[place][0] not in ends:
            token, place = tokens[place], place + 1
            if token[0] in ("[[", "("):
                close = "]]" if token[0] == "[[" else ")"
                out = automaton.state()
                while True:
                    branch = automaton.state()
                    automaton.free[at].append(branch)
                    automaton.free[sequence(branch, ("|", close), True)].append(out)
                    place += 1
                    if tokens[place - 1][0] == close:
                        break
                if close == "]]":
                    automaton.free[at].append(out)
                at = out
            elif token[1] is not None:
                low, high = int(token[1]), int(token[2])
                out, here = automaton.state(), at
                for n in range(high + 1):
                    if n >= low:
                        automaton.free[here].append(out)
                    if n < high:
                        after = automaton.state()
                        automaton.any_word[here].append(after)
                        here = after
                at = out
            else:
                for word in words_of(token[0]):
                    after = automaton.state()
                    automaton.on[at].setdefault(word, []).append(after)
                    at = after
                    if not inside:
                        automaton.required.append(word)
        return at

    automaton.first = automaton.state()
    automaton.last = sequence(automaton.first, (), False)
    return automaton


def _base_starts(joined: bytes, phrase: bytes) -> list[int]:
    """Word places where the phrase stands; ``joined`` has one space around every word."""
    found, at, counted, words = [], joined.find(phrase), 0, 0
    while at >= 0:
        words += joined.count(b" ", counted, at)
        counted = at
        found.append(words)
        at = joined.find(phrase, at + 1)
    return found


def scan_words(words: list[bytes], automata: dict[str, Automaton]):
    """Base places per label, template spans, and the score."""
    joined = b" " + b" ".join(words) + b" "
    base = {}
    for phrase, label in PHRASES.items():
        starts = _base_starts(joined, b" " + phrase.encode() + b" ")
        if starts:
            base[label] = starts
    spans, score = [], 1.0 if base else 0.0
    for label, automaton in automata.items():
        first = automaton.closed({automaton.first})
        opening = {w for s in first for w in automaton.on[s]}
        if any(automaton.any_word[s] for s in first):
            places = range(len(words))
        else:
            places = sorted(p for w in opening for p in _base_starts(joined, b" " + w + b" "))
        end, followed = 0, 0
        for at in places:
            if at < end:
                continue
            size, far = automaton.longest(words, at)
            followed = max(followed, far)
            if size:
                spans.append((label, at, at + size))
                end = at + size
        score = max(score, 1.0 if end else min(0.5, 0.5 * followed / max(len(automaton.required), 1)))
    return base, spans, score


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base phrases, accepted templates with their word spans, and a score.

    ``score`` is 1 where a phrase or template is found, else half the share of a template's mandatory words that
    were followed at most. Null and empty texts have no words, no places and score 0. Repeated rows stay repeated, a null id is
    kept. Texts are scanned whole, in place: no shuffle.
    """
    automata = {label: compile_template(markup) for label, markup in sorted((templates or TEMPLATES).items())}

    def run(batches):
        for ids, bodies in batches:
            out = [[] for _ in range(9)]
            for doc_id, body in zip(ids, bodies):
                words = words_of(body)
                base, spans, score = scan_words(words, automata)
                starts = [s for places in base.values() for s in places]
                row = (
                    doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base)), ",".join(sorted({*base, *(s[0] for s in spans)})), score,
                    [{"label": n, "start": a, "end": b} for n, a, b in spans],
                )
                for column, value in zip(out, row):
                    column.append(value)
            yield out

    return map_rows(texts(docs, key, text), run, SCHEMA)


def report(docs: DataFrame) -> DataFrame:
    """The scan without its spans."""
    return scan(docs).drop("spans")
