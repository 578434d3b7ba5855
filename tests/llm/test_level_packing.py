import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from creditloom.llm import level_packing
from creditloom.llm.level_packing import Packer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _padding(windows, size):
    """Padding of windows given as lists of (offset, length), which must be gapless."""
    padding = 0
    for placed in windows:
        end = 0
        for offset, length in sorted(placed):
            assert offset == end and length > 0
            end += length
        assert end <= size
        padding += size - end if end & (end - 1) else 0
    return padding


@pytest.mark.parametrize("most_open", [1, 4, 4096])
@pytest.mark.parametrize("seed", range(8))
def test_every_id_is_packed_once(most_open, seed):
    rng = random.Random(seed)
    size = rng.choice([16, 64, 1024])
    packer, docs = Packer(size, 0, most_open), []
    for doc in range(rng.randint(0, 800)):
        length = rng.choice([1, rng.randint(1, 3 * size), rng.randint(1, size // 2), int(0.6 * size)])
        docs.append(np.random.default_rng(doc).integers(0, 99, length).astype("<u4").tobytes())
        packer.add(doc, docs[-1])
        assert packer.n_open <= most_open
    packer.finish()
    parts, windows = defaultdict(dict), defaultdict(list)
    for (doc, start, raw, total), window, offset in packer.done:
        assert start not in parts[doc] and total == len(docs[doc]) >> 2
        parts[doc][start] = raw
        windows[window].append((offset, len(raw) >> 2))
    assert [b"".join(parts[d][s] for s in sorted(parts[d])) for d in range(len(docs))] == docs
    assert _padding(windows.values(), size) == 0


def test_level_is_the_least_sum_of_squares():
    rng = random.Random(3)
    for _ in range(200):
        size = 12
        packer = Packer(size, 0)
        for level in range(1, size):
            packer.counts[level] = rng.choice([0, 0, 1, 2, 5])
        length = rng.randint(1, size - 1)

        def squares(level):
            counts = packer.counts.copy()
            if level:
                counts[level] -= 1
            if level + length < size:
                counts[level + length] += 1
            return int((counts[1:size] ** 2).sum())

        allowed = [h for h in range(size - length + 1) if h == 0 or packer.counts[h]]
        found = packer.level(length)
        assert found in allowed
        assert (squares(found), -found) == min((squares(h), -h) for h in allowed)


def test_pack_matches_plain_tokenisation(spark):
    rows = [
        (1, "", "x"), (2, None, None), (3, "A few  words\there, and\na line", "x"), (3, "A few  words\there, and\na line", "x"),
        (4, "long words " * 9000, "y"), (None, "no id", "x"), (6, "Ünïcode é ß   İ <|endoftext|> 𝄞", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    found = level_packing.pack(docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    coded = defaultdict(list)
    for doc, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        coded[doc].append(np.array(ids, dtype="<u4").tobytes())
    windows, lengths = defaultdict(list), defaultdict(int)
    for r in found:
        raw = coded[r.doc_id][0]
        assert r.doc_tokens == len(raw) >> 2
        assert r.ids_crc32 == zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)])
        windows[r.sequence_id].append((r.offset, r.length))
        lengths[r.doc_id] += r.length
    assert lengths == {doc: sum(len(raw) >> 2 for raw in copies) for doc, copies in coded.items()}
    assert _padding(windows.values(), 1024) == 0
    assert level_packing.pack(docs.limit(0), PATH).collect() == []


def test_most_documents_stay_whole(spark):
    from creditloom.llm.queries import QUERIES

    rows = QUERIES["op12_levels"](spark, "/root/testdata/sf0.1").collect()
    windows, short = defaultdict(list), set()
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        if r.doc_tokens < 1024:
            short.add(r.doc_id)
    assert _padding(windows.values(), 1024) == 0
    assert len({r.doc_id for r in rows if r.doc_id in short and r.length < r.doc_tokens}) < 0.1 * len(short)
