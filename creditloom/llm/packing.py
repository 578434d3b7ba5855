"""Best-fit packing of token sequences by minimum bin slack.

Only the number of pieces of each length decides a packing, so the plan is made from the histogram of lengths
(at most ``size`` rows, whatever the data). Per bin, the largest length left is set, and a subset-sum bitset over
the lengths left finds the fullest feasible rest; the same filling is repeated as often as the counts allow. The
pieces then look up their place by their rank among the pieces of the same length.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from creditloom.llm.base import map_rows, texts
from creditloom.llm.unit_tokens import encoded
from creditloom.session import cut_lineage

SIZE = 2048
END_ID = 0
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place_in_part long"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum that fits ``room``, longer lengths first."""
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & ((1 << (room + 1)) - 1)
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Fillings and how many bins get each of them. Every count is used up."""
    left = {n: c for n, c in histogram.items() if c}
    fillings = []
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        filling = fullest(rest, size - longest)
        filling[longest] = filling.get(longest, 0) + 1
        bins = min(left[n] // k for n, k in filling.items())
        for n, k in filling.items():
            left[n] -= k * bins
            if not left[n]:
                del left[n]
        fillings.append((filling, bins))
    return fillings


def slots(fillings: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, copies per bin, first bin, offset of the first copy), by first rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for filling, bins in fillings:
        offset = 0
        for length, copies in sorted(filling.items(), reverse=True):
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, copies, first_bin, offset))
            used[length] = rank + copies * bins
            offset += length * copies
        first_bin += bins
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of at most ``size`` ids per document, with their number within (task, length)."""

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        end = END_ID.to_bytes(4, "little")
        for ids, texts_coded in encoded(batches, tokenizer_path, False):
            out = [[] for _ in range(7)]
            for doc_id, coded in zip(ids, texts_coded):
                coded += end
                total = len(coded) // 4
                for number, start in enumerate(range(0, total, size)):
                    length = min(size, total - start)
                    crc = zlib.crc32(memoryview(coded)[4 * start : 4 * (start + length)])
                    for column, value in zip(out, (doc_id, number, start, length, crc, part, int(seen[length]))):
                        column.append(value)
                    seen[length] += 1
            yield out

    return map_rows(texts(docs, key, text), cut, PIECE_SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with its sequence and the place in it.

    Null and empty texts are the end id alone. Only documents longer than ``size`` ids are cut. Repeated rows are
    packed as often as they occur, a null id is kept. An empty table gives no rows. Texts are tokenised once: the pieces (without
    ids) are written to the shared folder; the driver sees the histogram of lengths, at most ``size`` rows.
    """
    made = cut_lineage(pieces(docs, tokenizer_path, size, key, text))
    # Two columns are read twice: cheaper than a file per shuffle partition.
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    per_part = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    table = slots(plan(histogram, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"))

    def place(batches):
        for columns in batches:
            length = np.array(columns[3], dtype=np.int64)
            rank = np.array(columns[5], dtype=np.int64)
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                of = np.flatnonzero(length == n)
                rows = table[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[of], side="right") - 1]
                inside = rank[of] - row[:, 0]
                sequence[of] = row[:, 2] + inside // row[:, 1]
                offset[of] = row[:, 3] + inside % row[:, 1] * n
            yield [*columns[:5], sequence, offset]

    ranked = made.join(offsets, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("ranks_before") + F.col("place_in_part")).alias("rank")
    )
    return map_rows(
        ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
