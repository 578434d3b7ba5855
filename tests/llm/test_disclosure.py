import hashlib
import math
import random
import re
import time

from creditloom.llm import disclosure

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute_spans(text):
    found = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), number, m.end()))
    return sorted(found)


def random_text(rng):
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (652) 555-5229", "+12 34",
             "é𝄞", " ", " ", "\n", ".", "-", "%", "word", "Zürich", "q@w.e-r.t_y@z.u", "0000000000.1.2.3", "+", "99", "(5) "]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))


def check(rows, docs):
    want = sorted((str(i), *(sum(s[1] == k for s in brute_spans(t)) for k in range(4)), hashlib.sha256(
        ",".join(f"{disclosure.KINDS[k]}:{a}:{b}" for a, k, b in brute_spans(t)).encode()).hexdigest()) for i, t in docs)
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows)
    assert got == want


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(1)
    docs = [(i, random_text(rng)) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "7" * 60_000), (1003, "a" * 4_000 + "@b.c"), (None, "a@b.cd"), (1004, "1.2.3.4 " * 3000), (1005, "x@y.zz"), (1005, "x@y.zz")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, spans int")
    check(disclosure.report(frame).collect(), docs)
    assert disclosure.report(frame.limit(0)).collect() == []


def test_terms_that_disclose_a_value(spark):
    rng = random.Random(2)
    common = ["the", "house", "river", "stone", "green", "cloud"]
    say = lambda n: " ".join(rng.choice(common) for _ in range(n))
    docs = [(i, f"{say(4)} Kalamazoo {say(2)} ann@corp.org {say(5)}") for i in range(6)]
    docs += [(i, f"{say(9)} u{i}@corp.org {say(6)}") for i in range(10, 40)] + [(i, say(30)) for i in range(50, 200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for row in disclosure.report(frame).collect():
        text = dict(docs)[row.doc_id]
        at = text.find("Kalamazoo")
        assert (f"term:{at}:{at + 9}" in row.spans) == (at >= 0)
        assert row.n_term == (at >= 0)
    out = {r.doc_id: r.text for r in disclosure.sanitise(frame).collect()}
    assert len(out) == len(docs)
    assert all("Kalamazoo" not in t and "@" not in t for t in out.values())
    assert "[TERM]" in out[0] and "[EMAIL]" in out[0] and out[60] == dict(docs)[60]


def test_sanitise_rebuilds_the_rest_of_the_text(spark, monkeypatch):
    monkeypatch.setattr(disclosure, "MIN_CONTEXTS", 10**6)
    rng = random.Random(3)
    docs = [(i, random_text(rng), 0) for i in range(200)] + [(900, None, None), (901, "", 0), (5, "a@b.cd", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_chars int")
    rows = disclosure.sanitise(frame).collect()
    want = []
    for i, text, _ in docs:
        out, at = [], 0
        for a, k, b in brute_spans(text):
            if b <= at:
                continue
            out += [text[at : max(a, at)], "" if a < at else disclosure.GENERAL[disclosure.KINDS[k]]]
            at = b
        want.append((i, None if text is None else "".join(out) + text[at:]))
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((i, t or "") for i, t in want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_terms_anywhere_in_a_text_disclose_a_value_seen_twice(spark):
    rng = random.Random(4)
    common = ["the", "house", "river", "stone", "green", "cloud"]
    say = lambda n: " ".join(rng.choice(common) for _ in range(n))
    docs = [(i, f"{say(3)} Kalamazoo {say(60)} ann@corp.org {say(40)} KALAMAZOO") for i in range(2)]
    docs += [(2, f"no value but Kalamazoo {say(20)}")] + [(i, f"{say(9)} u{i}@corp.org {say(6)}") for i in range(10, 40)]
    # All copies of one text are one piece of evidence.
    docs += [(i, f"{say(20)}") for i in range(50, 800)] + [(900 + i, "Solitary Hapaxes bob@corp.org") for i in range(5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in disclosure.report(frame).collect()}
    assert [found[i].n_term for i in (0, 1, 2)] == [2, 2, 1]
    text = docs[2][1]
    assert found[2].spans == f"term:{text.find('Kalamazoo')}:{text.find('Kalamazoo') + 9}"
    assert all(r.n_term == 0 for i, r in found.items() if i >= 10)
    assert all("kalamazoo" not in r.text.lower() for r in disclosure.sanitise(frame).collect())


def brute_terms(texts):
    """The revealing words of a corpus whose only values are e-mail addresses, by the definition."""
    email, word = re.compile(PLAIN["email"]), re.compile(r"[^\W\d_]{3,}")
    holders, values = {}, {}
    for row, text in enumerate(texts):
        for w in {w.lower() for w in word.findall(email.sub(" ", text))}:
            holders.setdefault(w, set()).add(row)
        matches = list(email.finditer(text))
        for i, m in enumerate(matches):
            before = text[matches[i - 1].end() if i else 0 : m.start()][-80:]
            behind = text[m.end() : matches[i + 1].start() if i + 1 < len(matches) else len(text)][:80]
            values.setdefault(m[0].lower(), {}).setdefault(row, (before, behind))
    total, terms = len(texts), set()
    tried = math.log(len(holders)) + math.log(len(values))
    for rows in values.values():
        n_value, n = len(rows), len(set(rows.values()))
        for term, held in holders.items():
            both = held & rows.keys()
            if not both or n_value == total:
                continue
            k, q = len({rows[r] for r in both}), len(held) / total
            a = k / n
            rest = (1 - a) * math.log((1 - a) / (1 - q)) if k < n else 0.0
            chance = -n * (a * math.log(a / q) + rest) if a > q else 0.0
            share = math.log2(total * len(both) / (n_value * len(held))) / math.log2(total / n_value)
            if share >= disclosure.DISCLOSURE and tried + chance <= math.log(disclosure.CHANCE):
                terms.add(term)
    return terms


def test_terms_equal_the_definition(spark):
    rng = random.Random(11)
    words = [f"{a}{b}{c}en" for a in "bdfgkl" for b in "aeiou" for c in "mnrst"]
    names = ["Orlando", "Zürich", "Ångström", "Quito", "Lagos", "Oslo"]
    texts = []
    for i in range(900):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 25))]
        person = rng.randrange(40)
        if rng.random() < 0.4:
            parts.insert(rng.randint(0, len(parts)), rng.choice(["Ann", "ann"]) + f"{person}@corp.org")
            if person < 6 and rng.random() < 0.95:
                parts.insert(rng.randint(0, len(parts)), names[person] if rng.random() < 0.7 else names[person].upper())
        texts.append(" ".join(parts))
    texts += texts[:40]
    expected = brute_terms(texts)
    assert 3 <= len(expected & {n.lower() for n in names})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in disclosure.report(docs).collect()}
    word = re.compile(r"[^\W\d_]+")
    for i, text in enumerate(texts):
        inside = [(m.start(), m.end()) for m in re.finditer(PLAIN["email"], text)]
        want = [
            f"term:{m.start()}:{m.end()}" for m in word.finditer(text)
            if m[0].lower() in expected and not any(a <= m.start() < b for a, b in inside)
        ]
        assert [s for s in found[i].split(",") if s.startswith("term")] == want


def test_many_matches_take_linear_time(spark):
    texts = ["12, " * 500_000, "4111111111111111, " * 30_000, "ann@x.org " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.time()
    found = {r.doc_id: (r.n_email, r.n_card) for r in disclosure.report(docs).collect()}
    hidden = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert time.time() - start < 120
    assert found == {0: (0, 0), 1: (0, 30_000), 2: (30_000, 0)}
    assert hidden == {0: texts[0], 1: "[CARD], " * 30_000, 2: "[EMAIL] " * 30_000}
