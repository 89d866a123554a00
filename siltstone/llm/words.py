"""Words of a text's bytes: ASCII letters and digits and whatever is not ASCII, with only A-Z lower-cased."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]")
_SEPARATOR = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: What stands for each byte: separators become spaces. Bytes of a character outside of ASCII stay, as all of them are above 7F.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if _WORD.match(bytes([b])) else 32 for b in range(256))
#: Bytes of a text that are split at once.
RUN = 1 << 20


def word_runs(text: bytes, size: int = RUN) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists that each come from about ``size`` bytes; no word is cut."""
    at = 0
    while at < len(text):
        cut = _SEPARATOR.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end].translate(_TABLE).split()
        at = end


def each_bytes(column: pa.Array, rows: int = 64) -> Iterator[bytes | None]:
    """The texts of a batch's column as UTF-8, few of them as Python objects at a time; None for nulls."""
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()
