"""Encoding of texts piece by piece, with a bounded memo of the pieces' ids.

A space before which stands no white space is a safe boundary of the byte-level patterns used here: a match may begin
with such a space, but none goes on across it. So a text is split there and every piece encoded for itself, which gives
the ids of the whole text; most pieces are words met before.
"""

from __future__ import annotations

import array
import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BOUNDARY = re.compile(r"(?<=\S) ")
#: A line break between other characters is a match of its own; so is a run of punctuation after a letter or digit.
LINE_BREAK = re.compile(r"(?<=\S)\n(?=\S)")
TAIL = re.compile(r"(?<=[^\W_])[!-/:-@\[-`{-~]+\Z")


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array.array("I", ids)
    if a.itemsize != 4:
        raise RuntimeError("unsigned int has not four bytes here")
    import sys

    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def give_back() -> None:
    """What was allocated and freed goes back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


class PieceEncoder:
    """encode_many maps strings to lists of ids. limit: pieces kept (a third as many other strings). Words of more
    than longest letters, and other pieces of more than mixed characters, rarely come again and are not kept.

    Pieces that are new are cut further where that is safe as well, at single line breaks between other characters and
    before punctuation that ends a word, so that what has to be encoded is mostly plain words. New plain words are encoded
    many at a time, as one text of words that each follow a space: starts tells which ids begin with a space, and so where
    each word's ids begin.
    """

    #: Words that are encoded as one text.
    RUN = 4096

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], starts: np.ndarray, limit: int = 450_000, longest: int = 20, mixed: int = 12):
        self.encode_many, self.starts, self.limit, self.longest, self.mixed = encode_many, starts, limit, longest, mixed
        self.memo: dict[str, bytes] = {}  # of pieces that follow a space
        self.units: dict[str, bytes] = {}  # of encoded strings that follow no space

    def _units(self, piece: str) -> list[str]:
        if piece.isalpha():
            return [" " + piece]
        out = []
        for k, part in enumerate(LINE_BREAK.split(" " + piece) if "\n" in piece else (" " + piece,)):
            if k:
                out.append("\n")
            tail = TAIL.search(part)
            out += [part[: tail.start()], tail[0]] if tail else [part]
        return out

    def _encoded(self, wanted: list[list[str]]) -> list[bytes]:
        """The ids of each list of units."""
        units, memo, found = self.units, self.memo, {}
        for parts in wanted:
            for u in parts:
                if u not in found:
                    found[u] = memo.get(u[1:]) if u[:1] == " " else units.get(u)
        todo = [u for u, b in found.items() if b is None]
        new = dict(zip(todo, map(packed, self.encode_many(todo)))) if todo else {}
        found |= new
        if len(units) > self.limit // 3:
            units.clear()
        for u, b in new.items():
            if len(u) <= self.longest and not u[-1:].isspace():
                if u[:1] != " ":
                    units[u] = b
                elif 1 < len(u) and u[1:].isalpha():
                    memo[u[1:]] = b
        return [b"".join([found[u] for u in parts]) for parts in wanted]

    def clear(self) -> None:
        self.memo.clear()
        self.units.clear()

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of plain words, each of which follows a space."""
        out: list[bytes] = []
        runs = [words[at : at + self.RUN] for at in range(0, len(words), self.RUN)]
        for run, ids in zip(runs, self.encode_many([" " + " ".join(run) for run in runs])):
            ids = np.array(ids, np.uint32)
            at = np.flatnonzero(self.starts[ids])
            if len(at) != len(run):  # something in the run is not one word to the pattern
                out += map(packed, self.encode_many([" " + w for w in run]))
                continue
            data, ends = ids.astype("<u4").tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            out += [data[a:b] for a, b in zip(ends, ends[1:])]
        return out

    def _new(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces that are not kept yet, each of which follows a space; those that may come again are
        kept from now on."""
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        plain = [len(p) <= self.RUN and p.isalpha() for p in pieces]
        words, others = [p for p, x in zip(pieces, plain) if x], [p for p, x in zip(pieces, plain) if not x]
        found, rest = self._words(words), self._encoded([self._units(p) for p in others])
        memo.update((p, b) for p, b in zip(words, found) if len(p) <= self.longest)
        memo.update((p, b) for p, b in zip(others, rest) if p and len(p) <= self.mixed and "\n" not in p and not p[-1].isspace())
        found, rest = iter(found), iter(rest)
        return [next(found) if x else next(rest) for x in plain]

    def _cut(self, text: str) -> bytes:
        """A text's ids, where a space may follow white space."""
        head, *pieces = BOUNDARY.split(text)
        found = {p: self.memo.get(p) for p in pieces}
        todo = [p for p, b in found.items() if b is None]
        found |= zip(todo, self._new(todo))
        return b"".join([*self._encoded([[head]]), *map(found.__getitem__, pieces)])

    def _joined(self, texts: pa.Array) -> list[bytes]:
        """The texts are split at all spaces, the distinct pieces are encoded, and their ids are gathered in the pieces'
        order: only what is distinct is ever a Python object. Texts where a space follows white space go another way."""
        parts = pc.split_pattern(texts, " ")
        start, pieces = parts.offsets.to_numpy(), parts.flatten().dictionary_encode()
        at, words = pieces.indices.to_numpy().copy(), pieces.dictionary.to_pylist()
        first = start[:-1]
        heads = [words[k] for k in at[first].tolist()]
        # what is kept does not end with white space
        ids = list(map(self.memo.get, words))
        todo, loose = [], np.zeros(len(words), bool)
        for k, b in enumerate(ids):
            if b is None:
                w = words[k]
                if not w or w[-1].isspace():
                    loose[k], ids[k] = True, b""
                else:
                    todo.append(k)
        for k, b in zip(todo, self._new([words[k] for k in todo])):
            ids[k] = b
        unsafe = loose[at]
        unsafe[first] = [h[-1:].isspace() for h in heads]
        whole = self._encoded([[h] for h in heads])
        for k in np.flatnonzero(np.logical_or.reduceat(unsafe, first)).tolist():
            whole[k] = self._cut(texts[k].as_py())
            at[start[k] : start[k + 1]] = len(words) + len(whole)
        at[first] = len(words) + np.arange(len(whole))
        joined = pa.array(ids + whole + [b""], pa.large_binary()).take(pa.array(at))
        end, data = np.frombuffer(joined.buffers()[1], np.int64), memoryview(joined.buffers()[2] or b"")
        return [bytes(data[end[a] : end[b]]) for a, b in zip(start[:-1].tolist(), start[1:].tolist())]

    def encode_column(self, column: pa.Array, size: int = 8 << 20) -> Iterator[bytes]:
        """For each text of a column without nulls its ids, packed; texts of about ``size`` bytes are held as pieces at once,
        and what they took is given back to the system at the column's end."""
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(column):
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")) - at)
            yield from self._joined(column.slice(at, n))
            at += n
        give_back()

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, packed."""
        return list(self.encode_column(pa.array(texts, pa.string())))
