import random
import re

import pytest

from creditloom.llm import license_markup as lm


def brute(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = {}
    for phrase, label in lm.PHRASES.items():
        p = phrase.split()
        places[label] = [i for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [s for x in places.values() for s in x]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(k for k, v in places.items() if v))


def test_base_matches_the_plain_scan(spark):
    rng = random.Random(1)
    parts = ["CC BY", "cc", "by", "general", "Public-License", "all rights", "reserved", "é", "ÀCC", "×", "\n", "4.0", "x_y", "all all rights reserved", "cc by cc by"]
    docs = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "all rights " * 30_000 + "reserved"), (None, "cc-by"), (5, "cc by"), (5, "cc by")]
    frame = spark.createDataFrame([(i, t, "") for i, t in docs], "doc_id long, text string, labels string")
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in lm.report(frame).collect())
    want = sorted((str(i), *(str(x) if k in (2, 3) else x for k, x in enumerate(brute(t)))) for i, t in docs)
    assert got == want
    assert lm.report(frame.limit(0)).collect() == []


@pytest.mark.parametrize(
    "text, label",
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
        ("Released under the MIT License.", "mit"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
        ("Copyright (c) 2019, Jane Doe and others. All rights reserved.", "copyright-reserved"),
        ("Licensed under the Apache License, Version 1.0.", None),
        ("Licensed beneath the Apache License, Version 2.0.", None),
    ],
)
def test_mandatory_wording(text, label):
    automata = {n: lm.compile_template(t) for n, t in lm.TEMPLATES.items()}
    for a in automata.values():
        a.rare = a.required[:3]
    _, spans, _ = lm.scan_words(lm.words_of(f"Before it {text} after"), automata)
    assert {s[0] for s in spans} == ({label} if label else set())


def test_regions_against_a_regular_expression():
    automaton = lm.compile_template("a [[b [[c]] ]] {1,2} (d | e f) g")
    pattern = re.compile(r"a (?:b (?:c )?)?(?:\w )(?:\w )?(?:d|e f) g")
    rng = random.Random(3)
    for _ in range(3000):
        words = [rng.choice("abcdefg") for _ in range(rng.randint(1, 9))]
        joined = " ".join(words)
        accepted = [n for n in range(1, len(words) + 1) if pattern.fullmatch(" ".join(words[:n]))]
        assert automaton.longest([w.encode() for w in words], 0)[0] == max(accepted, default=0), joined


def test_a_truncated_license_scores_the_share_that_was_followed(spark):
    full = "one two three four five considerable exceptional unforeseeable"
    frame = spark.createDataFrame([(1, "x one two three four y"), (2, f"x {full} y"), (3, "x y")], "doc_id long, text string")
    found = {r.doc_id: (r.score, len(r.spans)) for r in lm.scan(frame, {"t": full}).collect()}
    assert found == {1: (0.25, 0), 2: (1.0, 1), 3: (0.0, 0)}
