"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of consecutive words of benchmark items. A search looks at the block of two words that ends at its
place. The shift table says how far any window must still be moved for that block to stand in it; most blocks stand in
none, so of ten words about one is looked at. Where the shift is 0, the block is the end of some window: the bucket of that
suffix holds the windows that end so, and one that equals the words before the place, word by word, occurs there.

Windows of one length have tables of their own: items of at least ``WINDOW`` words have windows of that length, and a shorter
item is one window. Items go over the documents in blocks whose words are bounded, a document keeps what earlier blocks
have found in it, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialise
from siltstone.llm.words import each_bytes, word_runs

WINDOW = 10
#: Words of the items that are searched at once, about: an item is never split. Blocks between two written tables.
BLOCK_WORDS, CHAINED = 200_000, 4


class Tables:
    """The shift table and suffix buckets of windows of one length."""

    def __init__(self, length: int) -> None:
        self.length = length
        #: last word of a block, then the word before it: the shift. A single word has no word before it.
        self.shift: dict[bytes, dict[bytes, int]] = {}
        self.buckets: dict[tuple[bytes, bytes], dict[tuple[bytes, ...], list]] = {}

    def add(self, window: tuple[bytes, ...], item: str) -> None:
        last = self.length - 1
        for j in range(min(1, last), self.length):
            row, before = self.shift.setdefault(window[j], {}), window[j - 1] if last else b""
            row[before] = min(row.get(before, last), last - j)
        items = self.buckets.setdefault((window[-2] if last else b"", window[-1]), {}).setdefault(window, [])
        if not items or items[-1] != item:
            items.append(item)

    def search(self, words: list[bytes], at: int) -> Iterator[tuple[int, list]]:
        """(end, items) of every window that ends at place ``at`` or behind it."""
        shift, buckets, m = self.shift, self.buckets, self.length
        most, at, n = max(m - 1, 1), max(at, m - 1), len(words)
        while at < n:
            row = shift.get(words[at])
            if row is None:
                at += most
                continue
            before = words[at - 1] if m > 1 else b""
            ahead = row.get(before, most)
            if ahead:
                at += ahead
                continue
            items = buckets[before, words[at]].get(tuple(words[at - m + 1 : at + 1]))
            if items:
                yield at + 1, items
            at += 1


def tables(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[Tables]:
    """The tables of items (id, text), by length."""
    found: dict[int, Tables] = {}
    for item, text in items:
        words = [w for run in word_runs(text) for w in run]
        m = min(len(words), window)
        if m:
            own = found.setdefault(m, Tables(m))
            for j in range(len(words) - m + 1):
                own.add(tuple(words[j : j + m]), item)
    return [found[m] for m in sorted(found)]


def search(text: bytes, every: list[Tables], window: int = WINDOW) -> tuple[int, list[list[int]], set[str]]:
    """A text's number of words, the spans of its words in windows (ascending and apart), and the items of these. A very long
    text is searched run by run, with the last words of one before the next."""
    n, carried, found, items = 0, [], [], set()
    for run in word_runs(text):
        words = carried + run
        first = n - len(carried)
        for own in every:
            for end, who in own.search(words, len(carried)):
                found.append((first + end - own.length, first + end))
                items.update(who)
        n += len(run)
        carried = words[max(0, len(words) - window + 1) :]
    spans: list[list[int]] = []
    for start, end in sorted(found):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return n, spans, items


def merged(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """The union of two lists of spans."""
    out: list[list[int]] = []
    for start, end in sorted(map(tuple, a + b)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans (arrays of start and end in words, end exclusive), items (ids as strings, sorted as such) of
    every document.

    Null and empty texts have no words. Every row is a document, repeated ones and those without an id too. Rows of one
    item id are one item, whose windows are those of all its texts; an item without an id has the empty string for one;
    items without words have no windows. Without items nothing is hit. Other columns are not read.
    """
    asked = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text")).filter("text is not null").distinct()
    # a word takes two bytes with its separator at least
    held = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-held // (2 * block_words)))
    if blocks > 1:
        asked = materialise(asked, "items")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_words long, spans array<array<long>>, items array<string>"
    empty = F.array()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), empty.cast("array<array<long>>").alias("spans"), empty.cast("array<string>").alias("items"))

    def searched(some: list[tuple[str, bytes]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every = tables(some, window)
            for batch in batches:
                counts, spans, found = [], [], []
                for text, old, had in zip(each_bytes(batch.column(1)), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                    n, own, who = search(text or b"", every, window)
                    counts.append(n)
                    spans.append(merged(old, own) if old else own)
                    found.append(sorted([*had, *who]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "spans", "items"])

        return run

    for block in range(blocks):
        rows = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        out = out.mapInArrow(searched([(r["item"], r["text"].encode("utf-8", "surrogatepass")) for r in rows.collect()]), schema)
        if block % CHAINED == CHAINED - 1 and block < blocks - 1:
            out = materialise(out, f"searched-{block}")
    return out.drop("text")
