"""Token ids in files of canonical, length-limited Huffman code.

The code is built from the global counts of ids (at most one row per vocabulary entry). A file is a Parquet
table of blocks, so Spark's writer commits it and any store can hold it:

``codes``   id, bits: the code lengths; canonical codes follow from them, shorter first, then by id.
``blocks``  bucket, block: place in ascending document order; doc_ids, doc_tokens: the documents of the block;
            checkpoints: bit offsets in ``payload`` of every ``STRIDE``-th id of a document, its first included;
            payload: codes, highest bit first, every document from a new byte.

A block is read without any other; within it all strides are decoded side by side from one lookup table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from creditloom.llm.base import map_rows, ready, texts
from creditloom.llm.unit_tokens import encoded
from creditloom.session import scratch_path

MAX_BITS = 20
STRIDE = 256
BLOCK_IDS = 1 << 18
BLOCK_SCHEMA = "bucket int, block int, doc_ids array<long>, doc_tokens array<int>, checkpoints array<long>, payload binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for the ids with a count, by package-merge; 0 for the others."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), dtype=np.int64)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids do not fit codes of {max_bits} bits")
    if len(used) <= 1:
        bits[used] = 1
        return bits
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, is_leaf = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(max_bits - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, packages))
        rank = np.argsort(both, kind="stable")
        row, mark = both[rank], rank < len(leaves)
        is_leaf.append(mark)
    take = 2 * len(leaves) - 2
    for mark in reversed(is_leaf):
        own = int(mark[:take].sum())
        bits[order[:own]] += 1
        take = 2 * (take - own)
    return bits


def canonical(bits: np.ndarray) -> np.ndarray:
    """Codes of the given lengths: shorter first, then by id."""
    codes, code, last = np.zeros(len(bits), dtype=np.uint64), 0, 0
    for i in np.lexsort((np.arange(len(bits)), bits)):
        if bits[i]:
            code <<= int(bits[i]) - last
            codes[i], last = code, int(bits[i])
            code += 1
    return codes


def decode_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next ``width`` bits: the id, the length of its code."""
    width = max(int(bits.max(initial=1)), 1)
    order = [i for i in np.lexsort((np.arange(len(bits)), bits)) if bits[i]]
    spread = [1 << (width - int(bits[i])) for i in order]
    ids = np.repeat(np.array(order, dtype=np.uint32), spread)
    lengths = np.repeat(bits[order].astype(np.uint8) if order else np.zeros(0, np.uint8), spread)
    pad = (1 << width) - len(ids)
    return np.concatenate((ids, np.zeros(pad, np.uint32))), np.concatenate((lengths, np.ones(pad, np.uint8))), width


def encode_documents(ids: np.ndarray, sizes: np.ndarray, bits: np.ndarray, codes: np.ndarray):
    """Code of every document, from a new byte each, and the bit offsets of its strides."""
    if not len(ids):
        return [b""] * len(sizes), [[] for _ in sizes]
    length = bits[ids]
    ends = np.cumsum(length)
    doc_end = np.concatenate(([0], np.cumsum(sizes)))
    total = np.concatenate(([0], ends))
    doc_bits = total[doc_end[1:]] - total[doc_end[:-1]]
    doc_bytes = (doc_bits + 7) // 8
    byte_at = np.concatenate(([0], np.cumsum(doc_bytes)))
    shift = np.repeat(byte_at[:-1] * 8 - total[doc_end[:-1]], sizes)
    at = ends - length + shift
    value = codes[ids] << (64 - (at & 31) - length).astype(np.uint64)
    word, room = at >> 5, int(byte_at[-1] // 4 + 3)
    # Codes do not overlap, so sums of their bits below 2^32 are exact.
    words = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=room)
    words += np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=room)
    raw = words.astype(np.uint64).astype(">u4").tobytes()
    coded = [raw[byte_at[i] : byte_at[i + 1]] for i in range(len(sizes))]
    strides = [
        (at[doc_end[i] : doc_end[i + 1] : STRIDE] - byte_at[i] * 8).tolist() for i in range(len(sizes))
    ]
    return coded, strides


def decode_block(payload: bytes, doc_tokens: np.ndarray, checkpoints: np.ndarray, table) -> np.ndarray:
    """All ids of a block; every stride is a lane, and the lanes advance together."""
    symbols, lengths, width = table
    data = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    out = np.zeros(int(doc_tokens.sum()), dtype=np.uint32)
    lanes_of = (doc_tokens + STRIDE - 1) // STRIDE
    first = np.repeat(np.cumsum(doc_tokens) - doc_tokens, lanes_of)
    number = np.arange(len(first)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
    place = first + number * STRIDE
    size = np.minimum(np.repeat(doc_tokens, lanes_of) - number * STRIDE, STRIDE)
    order = np.argsort(-size, kind="stable")
    place, size, at = place[order], size[order], checkpoints[order].copy()
    active = np.searchsorted(-size, -np.arange(STRIDE), side="left")
    for step in range(STRIDE):
        n = active[step]
        if not n:
            break
        here = at[:n]
        peek = (window[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[place[:n] + step] = symbols[peek]
        here += lengths[peek]
    return out


def tokens(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, ids): the n ids of the whole text with ``end_id`` last, little-endian, 16 bits each if all fit, else 32."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        for ids, coded in encoded(batches, tokenizer_path, True):
            wide = [np.frombuffer(c + end, dtype="<u4") for c in coded]
            yield [ids, [len(w) for w in wide], [(w.astype("<u2") if w.max() < 65_536 else w).tobytes() for w in wide]]

    return map_rows(texts(docs, key, text), run, "doc_id long, n int, ids binary")


def _wide(n: int, coded: bytes) -> np.ndarray:
    return np.frombuffer(coded, dtype="<u2" if len(coded) == 2 * n else "<u4").astype(np.int64)


def _counts(batches):
    total = np.zeros(0, dtype=np.int64)
    for sizes, bodies in batches:
        seen = np.bincount(np.concatenate([_wide(n, b) for n, b in zip(sizes, bodies)]))
        if len(seen) > len(total):
            seen[: len(total)] += total
            total = seen
        else:
            total[: len(seen)] += seen
    used = np.flatnonzero(total)
    yield [used.tolist(), total[used].tolist()]


def _blocks(batches):
    """Documents in order become blocks; a block ends at ``BLOCK_IDS`` ids or where the bucket ends."""
    state = {"bucket": None, "block": 0}
    held: list[tuple] = []

    def flush():
        base, checkpoints = 0, []
        for _, _, strides, coded in held:
            checkpoints += [base + s for s in strides]
            base += 8 * len(coded)
        row = [state["bucket"], state["block"], [h[0] for h in held], [h[1] for h in held], checkpoints, b"".join(h[3] for h in held)]
        held.clear()
        state["block"] += 1
        return [[value] for value in row]

    size = 0
    for buckets, ids, sizes, strides, coded in batches:
        for bucket, *row in zip(buckets, ids, sizes, strides, coded):
            if held and (bucket != state["bucket"] or size >= BLOCK_IDS):
                yield flush()
                size = 0
            if bucket != state["bucket"]:
                state.update(bucket=bucket, block=0)
            held.append(tuple(row))
            size += row[1]
    if held:
        yield flush()


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write all documents in ascending id order (nulls first) below ``path``.

    A null or empty text is its end id alone; repeated rows are written as often as they occur; an empty table
    gives files without blocks. Texts are tokenised once, to an intermediate table; what is shuffled is the
    code, not the ids. The driver sees counts and code lengths (one row per id) and the bucket bounds.
    """
    spark = ready(docs.sparkSession)
    stage = scratch_path(spark, "ids")
    tokens(docs, tokenizer_path, end_id, key, text).write.option("compression", "zstd").parquet(stage)
    staged = spark.read.parquet(stage)
    rows = map_rows(staged.select("n", "ids"), _counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    bits = code_lengths(counts)
    codes = canonical(bits)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / buckets for i in range(1, buckets)] or [0.5]
    bounds = staged.agg(F.percentile_approx("doc_id", cuts, 10_000)).first()[0] or []

    def code(batches):
        for ids, sizes, bodies in batches:
            whole = np.concatenate([_wide(n, b) for n, b in zip(sizes, bodies)])
            coded, strides = encode_documents(whole, np.array(sizes), bits, codes)
            bucket = np.searchsorted(bounds, [i if i is not None else -(1 << 63) for i in ids], side="left")
            yield [bucket.tolist(), ids, sizes, strides, coded]

    coded = map_rows(staged, code, "bucket int, doc_id long, n int, strides array<long>, code binary")
    ordered = coded.repartition(buckets, "bucket").sortWithinPartitions("bucket", "doc_id")
    map_rows(ordered, _blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame([(int(i), int(bits[i])) for i in np.flatnonzero(bits)], "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")


def read(spark: SparkSession, path: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids as little-endian unsigned 32-bit integers.

    ``keep``: columns made of ``ids``, in its place. They are made before documents meet their start by a join, so
    a digest does not send the ids through a shuffle.
    """
    ready(spark)
    keep = keep or {"ids": F.col("ids")}
    rows = spark.read.parquet(f"{path}/codes").collect()
    bits = np.zeros(max((r["id"] for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        bits[r["id"]] = r["bits"]

    def run(batches):
        table = decode_table(bits)
        for columns in batches:
            for bucket, block, ids, sizes, checkpoints, payload in zip(*columns):
                sizes = np.array(sizes, dtype=np.int64)
                raw = decode_block(payload, sizes, np.array(checkpoints, dtype=np.int64), table).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                n = len(ids)
                yield [[bucket] * n, [block] * n, ids, starts, sizes, [raw[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist())]]

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    found = map_rows(blocks, run, "bucket int, block int, doc_id long, inside long, n_tokens long, ids binary").select(
        "bucket", "block", "doc_id", "inside", "n_tokens", *[column.alias(name) for name, column in keep.items()]
    )
    sizes = blocks.select("bucket", "block", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    within = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket of the file
    by_bucket = sizes.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before_bucket"))
    starts = sizes.select("bucket", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before_block")).join(by_bucket, "bucket")
    return found.join(starts, ["bucket", "block"]).select(
        "doc_id", (F.col("before_bucket") + F.col("before_block") + F.col("inside")).alias("start"), "n_tokens", *keep
    )
