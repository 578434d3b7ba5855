"""Online packing by the sum of squares.

Documents are packed as they come. A level array counts the windows open at each fill; a document (what is left of it
after its full windows) goes to the level that leaves the sum of squared counts smallest, so no fill becomes common
among open windows and most documents meet a window with just the gap they need. The state is one array of ``size``
counts and at most ``OPEN`` open windows, whatever the number of documents, so every task packs its own rows and
nothing is shuffled.

Documents may be cut. While fewer than ``OPEN`` windows are open none is (but at full windows); at that bound one that
would open another fills the fullest window instead and goes on with its rest. What is open when the rows end is
filled up from its emptiest windows, and the last rest is dealt to windows whose sizes are powers of two: they need no
padding, so there is none at all.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from creditloom.llm.base import map_rows, texts
from creditloom.llm.unit_tokens import encoded

SIZE = 1024
END_ID = 0
# Windows open at a time in a task; with 32-bit ids they hold at most 16 MB. A smaller bound cuts more documents.
OPEN = 4096
# Sequence numbers of a task start at its number times this, as row numbers of Spark do.
PER_TASK = 1 << 33
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """The level array of one task. Pieces are (doc, start, raw ids, doc_tokens); ``done`` gets (piece, window, offset)."""

    def __init__(self, size: int, first_window: int, most_open: int = OPEN):
        self.size, self.most_open, self.next_window = size, most_open, first_window
        self.counts = np.zeros(size + 1, dtype=np.int64)
        # Per fill, the open windows; a window is the list of its pieces.
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.n_open, self.done = 0, []

    def _close(self, pieces: list) -> None:
        at = 0
        for piece in pieces:
            self.done.append((piece, self.next_window, at))
            at += len(piece[2]) >> 2
        self.next_window += 1

    def level(self, length: int) -> int:
        """The fill (0: a new window) to put ``length`` ids on. Of equal ones, the fullest.

        The sum of squares changes by 1 - 2 n where a window leaves a level, by 1 + 2 n where it arrives; a full window
        arrives nowhere and a new one leaves nowhere.
        """
        counts = self.counts[: self.size - length + 1]
        change = 1 - 2 * counts
        change[1:][counts[1:] == 0] = np.iinfo(np.int64).max >> 1
        change[0] = 0
        change[: len(counts) - 1] += 1 + 2 * self.counts[length : self.size]
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def _take(self, level: int) -> list:
        self.counts[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, pieces: list, level: int) -> None:
        if level == self.size:
            self._close(pieces)
        else:
            self.counts[level] += 1
            self.n_open += 1
            self.open[level].append(pieces)

    def add(self, doc, raw: bytes) -> None:
        total, at = len(raw) >> 2, 0
        while total - at >= self.size:
            self._close([(doc, at, raw[4 * at : 4 * (at + self.size)], total)])
            at += self.size
        while at < total:
            length = total - at
            level = self.level(length)
            if level == 0 and self.n_open >= self.most_open:
                # The fullest window that is open takes what fits.
                level = int(np.flatnonzero(self.counts)[-1])
                length = min(length, self.size - level)
            piece = (doc, at, raw[4 * at : 4 * (at + length)], total)
            self._put([*(self._take(level) if level else []), piece], level + length)
            at += length

    def finish(self) -> None:
        """Fill what is open, the fullest windows first, from the emptiest; a rest ends in powers of two."""
        left = [pieces for of_level in self.open for pieces in of_level]
        self.open, self.n_open = [[] for _ in range(self.size + 1)], 0
        self.counts[:] = 0
        low, high = 0, len(left) - 1
        while low < high:
            room = self.size - sum(len(p[2]) >> 2 for p in left[high])
            while room and low < high:
                doc, start, raw, total = left[low].pop()
                kept = max(len(raw) - 4 * room, 0)
                # The end of the piece moves, so that what stays keeps its place.
                left[high].append((doc, start + (kept >> 2), raw[kept:], total))
                room -= (len(raw) - kept) >> 2
                if kept:
                    left[low].append((doc, start, raw[:kept], total))
                elif not left[low]:
                    low += 1
            if room:
                break
            self._close(left[high])
            high -= 1
        if low <= high and left:
            self._powers(left[low])

    def _powers(self, pieces: list) -> None:
        """Windows of falling powers of two that hold the pieces exactly."""
        rest, window, room = sum(len(p[2]) >> 2 for p in pieces), [], 0
        for doc, start, raw, total in pieces:
            while raw:
                if not room:
                    room = 1 << (rest.bit_length() - 1)
                    rest -= room
                took = raw[: 4 * room]
                window.append((doc, start, took, total))
                start, raw, room = start + (len(took) >> 2), raw[len(took) :], room - (len(took) >> 2)
                if not room:
                    self._close(window)
                    window = []


def pack(
    docs: DataFrame, tokenizer_path: str, size: int = SIZE, key: str = "doc_id", text: str = "text", most_open: int = OPEN
) -> DataFrame:
    """One row per piece with its sequence and the place in it; see the module for what is cut.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they occur, a null id is kept, an empty
    table gives no rows, other columns may have any name. A text's ids are held while it is packed, and those of the open windows until they close.
    A task that runs again packs the same rows in the same way.
    """

    def run(batches):
        packer = Packer(size, TaskContext.get().partitionId() * PER_TASK, most_open)
        end = END_ID.to_bytes(4, "little")

        def rows():
            out = [[] for _ in range(7)]
            for (doc, start, raw, total), window, offset in packer.done:
                for column, value in zip(out, (doc, start, len(raw) >> 2, zlib.crc32(raw), total, window, offset)):
                    column.append(value)
            packer.done = []
            return out

        for ids, coded in encoded(batches, tokenizer_path, True):
            for doc, raw in zip(ids, coded):
                packer.add(doc, raw + end)
            yield rows()
        packer.finish()
        yield rows()

    return map_rows(texts(docs, key, text), run, SCHEMA)
