import random

import xxhash
from creditloom.llm import simhash_bk
from creditloom.llm.graph import components


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, at = [], ""
    for c in lowered + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words += [at] if at else []
            at = ""
        else:
            at += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    least = {n: n for n in nodes}
    while True:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return least


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    pairs += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    nodes = {n for a, b in pairs for n in (a, b) if a != b}
    assert found == brute_components([p for p in pairs if p[0] != p[1]], nodes)
    assert components(edges.limit(0)).collect() == []


def check(spark, fps):
    found = components(simhash_bk.links(spark.createDataFrame([(f - ((f >> 63) << 64),) for f in fps], "fp long")))
    found = {r.node: r.component for r in found.collect()}
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2]
    signed = lambda f: f - ((f >> 63) << 64)
    pairs = [(signed(a), signed(b)) for a, b in pairs]
    assert found == brute_components(pairs, {n for p in pairs for n in p})


def test_links_match_all_pairs(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for bits in (1, 2, 3):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), bits)))
    check(spark, sorted(fps))


def test_crowded_shards_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash_bk, "SHARD_ROWS", 8)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    check(spark, sorted({base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 4, 9) for _ in range(40)}))


def test_rows_of_every_kind(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(1, "", 0), (2, None, 0), (3, "One", 0), (4, "ONE", 0), (5, "Two\twords\x0b\x1cx É", 0), (6, long, 0), (6, long, 0), (None, "a b c d", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = simhash_bk.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    want = sorted((f"{brute_fingerprint(t):016x}" for _, t, _ in rows))
    assert sorted(r.fingerprint for r in found) == want
    by_id = {r.doc_id: r for r in found}
    assert by_id[2].component_id == 1 and by_id[4].component_id == 3 and by_id[6].component_id == 6
    assert simhash_bk.near_duplicates(docs.limit(0)).collect() == []


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d"), (2, "A b c d"), (3, "other words here now"), (3, "other words here now"), (4, "x y z w v"), (None, "a b c d"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")
    kept = sorted((str(r.doc_id), str(r.text)) for r in simhash_bk.first_of_each(docs).collect())
    assert kept == sorted([("1", "a b c d"), ("3", "other words here now"), ("4", "x y z w v"), ("5", "None"), ("None", "a b c d")])
    assert simhash_bk.first_of_each(docs.limit(0)).collect() == []
