import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import turn_repair
from creditloom.llm.turn_repair import END, advance, matrix, power, product, symbol, tail, times, unroll

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = sorted({symbol(i, f) for i in ("s", "u", "a", "-", "") for f in range(4)})


def _plain_edits(rows):
    """(cost, letters) over (initial, fault), by a search over all edits with costs to go as texts."""

    def legal(start, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((start, initial))

    best = {(len(rows), ""): (0, ""), (len(rows), "a"): (0, "")}
    for at in range(len(rows), -1, -1):
        for _ in range(4):
            for start in ("", "s", "u", "a"):
                found = [best[at, start]] if (at, start) in best else []
                for other in "ua":
                    to = legal(start, other)
                    if to and (at, to) in best:
                        found.append((best[at, to][0] + 2, "I" + best[at, to][1]))
                    if at < len(rows) and rows[at][1] < 2 and to and (at + 1, to) in best:
                        cost, letters = best[at + 1, to]
                        found.append((cost + 2 + rows[at][1], "R" + letters))
                if at < len(rows):
                    if (at + 1, start) in best:
                        found.append((best[at + 1, start][0] + 3, "D" + best[at + 1, start][1]))
                    to = legal(start, rows[at][0])
                    if rows[at][1] < 2 and to and (at + 1, to) in best:
                        found.append((best[at + 1, to][0] + rows[at][1], "K" + best[at + 1, to][1]))
                if found:
                    best[at, start] = min(found)
    return best[0, ""]


def _runs(symbols):
    return [(of, len(list(same))) for of, same in itertools.groupby(symbols)]


@pytest.mark.parametrize("seed", range(5))
def test_edits_are_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    for _ in range(150):
        rows = []
        while len(rows) < rng.randint(0, 24):
            rows += [(rng.choice(["s", "u", "a", "u", "a", "x", ""]), rng.choice([0, 0, 0, 1, 2, 3]))] * rng.choice([1, 1, 1, 2, 9])
        runs = _runs([symbol(*r) for r in rows])
        letters, state = unroll(runs, list(END), 0)
        cost = int(times(product(runs), np.array(END))[0])
        assert (cost, "".join(letters) + tail(state)) == _plain_edits(rows)


def test_powers_are_repeated_products():
    for of in SYMBOLS:
        made = matrix(of)
        for n in range(2, 20):
            made = times(matrix(of), made)
            assert (advance(of, n, np.array(END)) == times(made, np.array(END))).all()
        assert (power(of, 4) == times(power(of, 3), power(of, 3))).all()


def test_a_long_run_is_unrolled_by_its_cycle():
    n = 300_000
    letters, state = unroll([(("u", 0), n)], list(END), 0)
    audit = "".join(letters) + tail(state)
    assert sum({"D": 3, "I": 2, "K": 0, "R": 2}[x] for x in audit) == advance(("u", 0), n, np.array(END))[0] == n
    assert _plain_edits([("u", 0)] * 200)[1] == "".join(unroll([(("u", 0), 200)], list(END), 0)[0])


def _plain_report(rows, live=lambda c, t: True, copies=lambda c, t: 1):
    """The report by hand; the order within a turn is that of role, then the text's digest."""
    out = []
    for conv in {r[0] for r in rows}:
        own = []
        for c, t, role, text in rows:
            if c == conv and live(c, t):
                text = " " if text is None else text
                own += [(t is not None, t or 0, role if role is not None else " ", hashlib.md5(text.encode()).hexdigest(), text)] * copies(c, t)
        own.sort()
        seen, faults = set(), []
        for _, _, role, _, text in own:
            kept = text.rstrip(WHITE)
            fault = 2 if not kept else 3 if (role, text) in seen else 1 if kept[-1] not in ".!?" else 0
            seen.add((role, text))
            faults.append(fault)
        initials = [r[2][:1] for r in own]
        cost, audit = _plain_edits(list(zip(initials, faults)))
        turns, state, at = [], "", 0
        for letter in audit:
            if letter == "I":
                new = "a" if state == "u" else "u"
                turns.append(f"{turn_repair.ROLE[new]}:")
                state = new
                continue
            _, _, role, _, text = own[at]
            at += 1
            if letter == "R":
                state = "a" if state == "u" else "u"
                turns.append(f"{turn_repair.ROLE[state]}:{text}")
            elif letter == "K":
                state = role[:1]
                turns.append(f"{role}:{text}")
        numbers = [r[1] for r in own if r[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(turns).encode()).hexdigest()
        out.append((conv, gaps, faults.count(2), faults.count(3), faults.count(1), illegal, cost, audit, digest))
    return sorted(out, key=str)


def _reported(docs, **more):
    return sorted(map(tuple, turn_repair.report(docs, **more).collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, pos string"


def _some_rows(rng, n):
    texts = ["Well.", "Well", "", " \n", None, "Yes!", " ", "Ends. ", "Ends. \t", "a. b", "?", "long " * 3000 + "end."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "other", "User"]
    return [
        (rng.choice([1, 2, 2, 2, 2, None, 7]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts), "x") for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_report_equals_plain(spark, seed):
    rows = _some_rows(random.Random(seed), 250)
    rows += rows[:20] + [(9, 5, "user", "Once.", None)] * 60
    docs = spark.createDataFrame(rows, SCHEMA)
    plain = [r[:4] for r in rows]
    assert _reported(docs) == _plain_report(plain)
    # Turns that take no part, twice, or leave nothing of a conversation.
    live, copies = (F.coalesce("turn", F.lit(0)) != 5), F.when(F.col("turn") == 3, 2).otherwise(1)
    assert _reported(docs, live=live, copies=copies) == _plain_report(plain, lambda c, t: t != 5, lambda c, t: 2 if t == 3 else 1)


def test_one_conversation_lies_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "ready", lambda session: session)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    rng = random.Random(8)
    rows = [(3, t // 2, rng.choice(["user", "assistant"]), rng.choice(["One.", "Two", f"No {t}.", f"No {t}."]), "x") for t in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    prepared = turn_repair._prepared(docs, "conv_id", "turn", "role", "text", F.lit(True), F.lit(1))
    pieces, found = turn_repair._headers(prepared).count(), _reported(docs)
    for key, value in before.items():
        spark.conf.set(key, value)
    assert pieces > 5
    assert found == _plain_report([r[:4] for r in rows])


def test_repaired_turns_are_legal(spark):
    docs = spark.createDataFrame(_some_rows(random.Random(4), 200), SCHEMA)
    digests = {r.conv_id: r.repaired_sha256 for r in turn_repair.report(docs).collect()}
    turns = {}
    for r in turn_repair.repair(docs).collect():
        turns.setdefault(r.conv_id, []).append(r)
    for conv, own in turns.items():
        kept = sorted((r.place, r.role, r.text) for r in own if r.place is not None)
        assert [k[0] for k in kept] == list(range(len(kept)))
        initials = "".join(k[1][:1] for k in kept).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2)
        assert hashlib.sha256("\n".join(f"{k[1]}:{k[2]}" for k in kept).encode()).hexdigest() == digests[conv]
        assert all(r.place is None for r in own if r.edit == "D")
    assert turn_repair.repair(docs.limit(0)).collect() == [] and turn_repair.report(docs.limit(0)).collect() == []


def test_query_over_its_whole_table(spark):
    from creditloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = []
    originals = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for conv, turn, role, text in originals:
        damage = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = " " if text is None else text
        text = "" if damage == 1 else "".join(c for c in text if c not in ".!?") if damage == 2 else text
        rows.append((conv, turn, "user" if damage == 4 else role, text, damage))
    kinds = {(r[0], r[1]): r[4] for r in rows}
    expected = _plain_report([r[:4] for r in rows], lambda c, t: kinds[c, t] != 0, lambda c, t: 2 if kinds[c, t] == 3 else 1)
    assert sorted(map(tuple, QUERIES["op11_run_lengths"](spark, folder).collect()), key=str) == expected
