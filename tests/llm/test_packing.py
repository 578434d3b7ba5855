import itertools
import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from creditloom.llm import packing, unit_tokens
from creditloom.session import cut_lineage

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_fullest_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(60):
        lengths = [rng.randint(1, 12) for _ in range(7)]
        counts = {n: lengths.count(n) for n in lengths}
        room = rng.randint(1, 40)
        best = max(
            sum(c) for k in range(8) for c in itertools.combinations(lengths, k) if sum(c) <= room
        )
        found = packing.fullest(counts, room)
        assert sum(n * k for n, k in found.items()) == best
        assert all(k <= counts[n] for n, k in found.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(6)
    histogram = {n: rng.randint(0, 9) for n in range(1, 65)}
    fillings = packing.plan(histogram, 64)
    used = {}
    for filling, bins in fillings:
        assert bins > 0 and sum(n * k for n, k in filling.items()) <= 64
        for n, k in filling.items():
            used[n] = used.get(n, 0) + k * bins
    assert used == {n: c for n, c in histogram.items() if c}


@pytest.fixture
def odd_docs(spark):
    rows = [
        (1, "", "x"), (2, None, None), (3, "A few  words\there, and\na line", "x"), (3, "A few  words\there, and\na line", "x"),
        (4, "long words " * 9000, "y"), (None, "no id", "x"), (6, "Ünïcode é ß   İ <|endoftext|> 𝄞", None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, start string").withColumnRenamed("start", "length")


def test_pack_matches_plain_tokenisation(spark, odd_docs):
    found = packing.pack(odd_docs, PATH).collect()
    tokenizer, expected = Tokenizer.from_file(PATH), []
    for row in odd_docs.collect():
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            raw = b"".join(i.to_bytes(4, "little") for i in part)
            expected.append((row.doc_id, piece, at, len(part), zlib.crc32(raw)))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r[:5]) for r in found), key=key) == sorted(expected, key=key)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 2048


def test_pack_of_an_empty_table(spark, odd_docs):
    assert packing.pack(odd_docs.limit(0), PATH).collect() == []


def test_empty_texts_are_not_gathered_without_end():
    batches = (([i] * 256, [""] * 256) for i in range(1000))
    sizes = [len(ids) for ids, _ in unit_tokens.encoded(batches, PATH, False)]
    assert sum(sizes) == 256_000 and max(sizes) <= 100_000


def test_a_worker_holds_few_bytes_of_units_and_counts_write_no_file(spark, monkeypatch):
    encode, written = unit_tokens.UnitEncoder(PATH, False), []
    letters, rng = "abcdefghijklmnopqrstuvwxyzéßñ", random.Random(9)
    for _ in range(4):
        encode.encode([" ".join("".join(rng.choices(letters, k=9)) for _ in range(200_000))])
        assert unit_tokens._bytes(encode.units, encode.flat, encode.size) <= 25 << 20
    monkeypatch.setattr(packing, "cut_lineage", lambda df: written.append(df.columns) or cut_lineage(df))
    packing.pack(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), PATH)
    assert len(written) == 1


def test_pack_is_near_the_lower_bound(spark):
    from creditloom.llm.queries import QUERIES

    rows = QUERIES["op1_packing"](spark, "/root/testdata/sf0.01").collect()
    assert len({r.sequence_id for r in rows}) <= 1.01 * -(-sum(r.length for r in rows) // 2048) + 1
