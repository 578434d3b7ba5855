import heapq
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from creditloom.llm import huffman, unit_tokens
from creditloom.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    counts = (rng.pareto(1.0, 300) * 50).astype(np.int64)
    bits = huffman.code_lengths(counts, 30)
    assert (counts * bits).sum() == huffman_cost(counts.tolist())
    steep = np.array([2**i for i in range(40)])
    limited = huffman.code_lengths(steep, 8)
    assert limited.max() <= 8 and sum(2.0 ** -int(b) for b in limited if b) == 1.0


def test_codes_have_no_prefix_among_them():
    bits = huffman.code_lengths(np.array([5, 0, 9, 1, 1, 30, 7]))
    codes = huffman.canonical(bits)
    words = [f"{int(c):0{b}b}" for c, b in zip(codes, bits) if b]
    assert not any(a != b and b.startswith(a) for a in words for b in words)


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 700, 256, 255, 257, 3, 5000])
    ids = np.minimum(rng.geometric(0.01, sizes.sum()) - 1, 999)
    bits = huffman.code_lengths(np.bincount(ids, minlength=1000))
    coded, strides = huffman.encode_documents(ids, sizes, bits, huffman.canonical(bits))
    base, points = 0, []
    for c, s in zip(coded, strides):
        points += [base + x for x in s]
        base += 8 * len(c)
    found = huffman.decode_block(b"".join(coded), sizes, np.array(points), huffman.decode_table(bits))
    assert (found == ids).all()


def plain(rows):
    tokenizer = Tokenizer.from_file(PATH)
    return [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]


def test_files_hold_every_document_in_order(spark, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 500)
    rng = random.Random(4)
    rows = [(i * 7 - 20, " ".join(rng.choice(["alpha", "Beta,", "γ", "x\n\ny", "  two", "tab\there ", "\x1c."]) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 20_000), (1003, "same"), (1003, "same")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int")
    path = scratch_path(spark, "coded")
    huffman.write(docs, path, PATH, 2)
    found = sorted(huffman.read(spark, path).collect(), key=lambda r: r.start)
    want, start = [], 0
    for doc_id, ids in sorted(plain(rows)):
        want.append((doc_id, start, len(ids), b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in found] == want


def test_empty_table_and_missing_id(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "c")], "doc_id long, text string")
    path = scratch_path(spark, "coded")
    huffman.write(docs, path, PATH, 2)
    found = sorted(huffman.read(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, zlib.crc32(bytes(r.ids))) for r in found] == [
        (i, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))) for i, ids in plain([(None, "a b"), (5, "c")])
    ]
    path = scratch_path(spark, "coded")
    huffman.write(docs.limit(0), path, PATH, 2)
    assert huffman.read(spark, path).collect() == []


def test_words_of_letters_go_by_the_model_with_the_ids_of_the_whole_tokenizer():
    rng = random.Random(12)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "abcXYZ", "aéßñÿÀÖØÞçü", "ab'st", "a1b2", "áe\u0301ªµ×÷", "日本a", "ĀĠaŁ", "İıſK", "a-.,!$"]
    texts = [" ".join("".join(rng.choices(rng.choice(kinds), k=rng.randint(1, 12))) for _ in range(400)) for _ in range(60)]
    for name, spaces_matter in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        whole, encode, seen = Tokenizer.from_file(path), unit_tokens.UnitEncoder(path, spaces_matter), []

        class Counted:
            def encode_batch_fast(self, units, **kinds):
                seen.extend(units)
                return whole.encode_batch_fast(units, **kinds)

        encode.tokenizer = Counted()
        for text, coded in zip(texts, encode.encode(texts)):
            assert np.frombuffer(coded, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert seen and not any(unit.strip().isascii() and unit.strip().isalpha() and unit.islower() for unit in seen)
