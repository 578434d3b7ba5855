"""Whole-text tokenisation through a bounded cache of units that the tokenizer never joins.

A tokenizer run over 100 TB spends nearly all its time on words it has met before. Texts are cut where the
tokenizer is sure to cut, each unit is encoded once per worker, and a text's ids are the joined units.
"""

from __future__ import annotations

import os
import re
from itertools import chain
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of units and ids that a Python worker holds. When they are exceeded, what was met again since the last time stays,
# or nothing if that is more than half of them. Long units are not held.
CACHE_BYTES = 24 << 20
CACHE_UNIT_CHARS = 128
# What a held unit takes beside its characters and ids: offsets, sizes and a mark.
_UNIT_BYTES = 24

# Unicode white space (the property White_Space), written as a character class. Fixed values.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_OTHER_WHITE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_UNITS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_MARK_BEFORE_STOP = re.compile(r"[.,](?<=[\W_\u0130][.,])[ \n]")

# Characters cut into units at a time; longer texts are cut before a single space.
PART_CHARS = 1 << 22
_CUT = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
# What a row counts beside its characters, so that empty texts are not gathered without end.
_ROW_CHARS = 64

# Units of these letters alone are one word to every splitting rule. In a byte-level vocabulary a space is Ġ, and a letter
# beyond ASCII is its two UTF-8 bytes, written as characters: bytes without one of their own follow from U+0100 on.
_LETTERS = {True: "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$", False: "^[a-zß-öø-ÿ]+$"}
_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_AS_BYTES = {ord(c): "".join(chr(b if b in _SHOWN else 256 + _HIDDEN.index(b)) for b in c.encode()) for c in " " + _ACCENTED}

_ENCODERS: dict[tuple[str, bool], "UnitEncoder"] = {}


def encoder(path: str, spaces_matter: bool) -> "UnitEncoder":
    """The worker's encoder for a tokenizer file; its cache outlives the task."""
    if (path, spaces_matter) not in _ENCODERS:
        _ENCODERS[path, spaces_matter] = UnitEncoder(path, spaces_matter)
    return _ENCODERS[path, spaces_matter]


def encoded(batches, path: str, spaces_matter: bool):
    """(ids, coded texts) of batches of (ids, texts), gathered up to ``PART_CHARS``: larger parts repeat more units."""
    encode, held, texts, size = encoder(path, spaces_matter).encode, [], [], 0
    for ids, bodies in batches:
        held += ids
        texts += bodies
        size += sum(map(len, bodies)) + _ROW_CHARS * len(bodies)
        if size >= PART_CHARS:
            yield held, encode(texts)
            held, texts, size = [], [], 0
    if held:
        yield held, encode(texts)


def _has_runs(text: str) -> bool:
    """White space beside white space, or of a kind other than space and line end."""
    if any(run in text for run in ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")):
        return True
    return not text.isascii() and bool(_OTHER_WHITE.search(text))


def _is_latin(text: str) -> bool:
    """Only characters whose lower case is the same everywhere."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _bytes(units: pa.Array, flat: np.ndarray, size: np.ndarray) -> int:
    return units.nbytes + flat.nbytes + _UNIT_BYTES * len(size)


class UnitEncoder:
    """ids of texts as little-endian unsigned 32-bit integers.

    ``spaces_matter``: the vocabulary keeps white space, a word carries its leading space (byte-level BPE with
    the usual split pattern). Otherwise the tokenizer drops white space between words.
    """

    def __init__(self, path: str, spaces_matter: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaces_matter = Tokenizer.from_file(path), spaces_matter
        self._hold(pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int32))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        words = [a + b + end for a in ascii_lowercase for b in ascii_lowercase for end in ("", "ing")]
        words += [c + "a" for c in _ACCENTED if spaces_matter or c >= "ß"]
        words += [w for word in words for w in (" " + word, word.capitalize() if word.isascii() else word)] if spaces_matter else []
        # The model alone takes a third of the time, where the steps before it leave letters as they are.
        self.direct = self._words(words) == [one.ids for one in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[list[int]]:
        """ids of words of these letters, by the model of the tokenizer."""
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(w.replace(" ", "Ġ") if w.isascii() else w.translate(_AS_BYTES))] for w in words]

    def _marked(self, text: str) -> str:
        """The text with a separator wherever the tokenizer is sure to cut (for the other kind, spaces are it)."""
        # A comma or full stop that ends a word is a unit of its own, unless no letter or digit stands before it:
        # the tokenizer keeps runs of marks together.
        stops = not _MARK_BEFORE_STOP.search(text)
        if not self.spaces_matter:
            # White space parts words and is dropped; what is not a space or line end stays inside a unit.
            flat = text.replace("\n", " ")
            if _is_latin(flat):
                flat = flat.lower()
            return flat.replace(", ", " , ").replace(". ", " . ") if stops else flat
        if _has_runs(text):
            return "\0".join(_UNITS.findall(text))
        # Single white space only: a word starts at its space, a line end stands alone.
        flat = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        return flat.replace(",\0", "\0,\0").replace(".\0", "\0.\0") if stops else flat

    def _parts(self, text: str) -> list[str]:
        """The text in parts that the tokenizer never joins."""
        if len(text) <= PART_CHARS:
            return [text]
        parts, at = [], 0
        while cut := _CUT.search(text, at + PART_CHARS):
            parts.append(text[at : cut.start()])
            at = cut.start()
        return [*parts, text[at:]]

    def encode(self, batch: list[str]) -> list[bytes]:
        found, held, size = [], [], 0
        for text in batch:
            lowered = text.lower() if "<" in text else ""
            if "\0" in text or any(token in lowered for token in self.special):
                # Special tokens cut texts in ways of their own, and the separator must be free.
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                found.append(b"".join(i.to_bytes(4, "little") for i in ids))
                continue
            found.append(None)
            for part in self._parts(text):
                held.append((len(found) - 1, part))
                size += len(part)
                if size >= PART_CHARS:
                    self._join(found, held)
                    held, size = [], 0
        self._join(found, held)
        return found

    def _join(self, found: list, held: list[tuple[int, str]]) -> None:
        for (place, _), coded in zip(held, self._encode([part for _, part in held])):
            found[place] = coded if found[place] is None else found[place] + coded

    def _hold(self, units: pa.Array, flat: np.ndarray, size: np.ndarray) -> None:
        """The units held, the ids of all of them, and how many each has."""
        self.units, self.flat, self.size = units, flat, size
        self.first = np.cumsum(size, dtype=np.int32) - size
        self.met = np.zeros(len(size), dtype=bool)

    def _encode(self, batch: list[str]) -> list[bytes]:
        """ids of texts: distinct units are looked up once, their ids gathered for all places."""
        if not batch:
            return []
        split = pc.split_pattern(pa.array([self._marked(text) for text in batch]), "\0" if self.spaces_matter else " ")
        units = split.flatten().dictionary_encode()
        flat, first, size = self._lookup(units.dictionary)
        index = units.indices.to_numpy()
        own = size[index]
        ends = np.cumsum(own, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(first[index] - ends + own, own) + np.arange(total, dtype=np.int32)]
        cuts = np.concatenate(([0], ends))[split.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _lookup(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place of the first, number) of distinct units; those not held are encoded."""
        place = pc.index_in(units, value_set=self.units).to_numpy(zero_copy_only=False)
        unseen = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(place), dtype=bool)
        place = np.nan_to_num(place).astype(np.int32)
        self.met[place[~unseen]] = True
        if not unseen.any():
            return self.flat, self.first[place], self.size[place]
        at = np.flatnonzero(unseen)
        plain = pc.match_substring_regex(units.take(pa.array(at)), _LETTERS[self.spaces_matter]).to_numpy(zero_copy_only=False) & self.direct
        at = np.concatenate((at[plain], at[~plain]))
        fresh = units.take(pa.array(at))
        n_plain, texts = int(plain.sum()), fresh.to_pylist()
        made = self._words(texts[:n_plain])
        texts = texts[n_plain:]
        for at_text in range(0, len(texts), 4096):
            made += [one.ids for one in self.tokenizer.encode_batch_fast(texts[at_text : at_text + 4096], add_special_tokens=False)]
        size = np.fromiter(map(len, made), dtype=np.int32, count=len(made))
        flat = np.fromiter(chain.from_iterable(made), dtype=np.uint32, count=int(size.sum()))
        place[at] = len(self.size) + np.arange(len(made), dtype=np.int32)
        flat, size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        first = np.cumsum(size, dtype=np.int32) - size
        self._learn(fresh, flat, size)
        return flat, first[place], size[place]

    def _learn(self, fresh: pa.Array, flat: np.ndarray, size: np.ndarray) -> None:
        """Hold new units that are short; when all are too large, let go of those not met again."""
        old = len(self.size)
        short = pc.less_equal(pc.utf8_length(fresh), CACHE_UNIT_CHARS).to_numpy(zero_copy_only=False)
        units, met = pa.concat_arrays([self.units, fresh]), np.concatenate([self.met, np.zeros(len(short), dtype=bool)])

        def held(keep: np.ndarray) -> tuple:
            return units.filter(pa.array(keep)), flat[np.repeat(keep, size)], size[keep]

        kept, marks = np.concatenate([np.ones(old, dtype=bool), short]), met
        if _bytes(units, flat, size) > CACHE_BYTES:
            kept, marks = kept & met, np.zeros(len(met), dtype=bool)
        made = (units, flat, size) if kept.all() else held(kept)
        if _bytes(*made) > CACHE_BYTES // 2 and not kept.all() and marks is not met:
            kept = np.zeros(len(met), dtype=bool)
            made = held(kept)
        self._hold(*made)
        self.met = marks[kept]
