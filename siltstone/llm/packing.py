"""Packing of tokenised documents into sequences of bounded length.

Each document's ids are cut every ``length`` ids; a cut piece of full length is a sequence by itself. The remainders
are packed by first-fit decreasing in randomised groups of about ``group_docs`` documents, so that a task holds one
group at a time, whatever the size of the input. The ids themselves never leave the task that made them.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.common import cache_cleared_by, claim, text_of
from siltstone.llm.token_pieces import PieceEncoder


class TournamentTree:
    """Bins' free room at the leaves, each inner node holding the most below it: the first bin with room in log(n) steps."""

    def __init__(self, bins: int, room: int):
        self.size = 1
        while self.size < max(bins, 1):
            self.size *= 2
        self.room = [room] * (2 * self.size)

    def take(self, need: int) -> tuple[int, int]:
        """The first bin with that much room, and the room it had; the room is taken."""
        room, at = self.room, 1
        if room[1] < need:
            raise ValueError("no bin has so much room")
        while at < self.size:
            at *= 2
            if room[at] < need:
                at += 1
        had = room[at]
        room[at] -= need
        bin_, at = at - self.size, at // 2
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at], at = best, at // 2
        return bin_, had


def first_fit_decreasing(sizes: list[int], length: int) -> list[tuple[int, int]]:
    """For sizes in falling order, each one's bin and its offset there."""
    tree = TournamentTree(len(sizes), length)
    return [(bin_, length - had) for bin_, had in (tree.take(n) for n in sizes)]


@lru_cache(2)
def encoder(tokenizer_file: str) -> PieceEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_file)
    # a special token's string in a text is ordinary text, as the description of these vocabularies has it
    own.encode_special_tokens = True

    starts = np.zeros(own.get_vocab_size(), bool)
    starts[[i for token, i in own.get_vocab(with_added_tokens=False).items() if token.startswith(SPACE)]] = True
    return PieceEncoder(lambda pieces: [e.ids for e in own.encode_batch_fast(pieces, add_special_tokens=False)], starts)


cache_cleared_by("packing", encoder.cache_clear)


#: The space as byte-level vocabularies write it.
SPACE = "\u0120"


PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_file: str, groups: int, length: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece of each document, with the random group that packs it."""
    rows = docs.select("doc_id", text_of().alias("text"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing")
        own, met = encoder(tokenizer_file), Counter()
        for batch in batches:
            names, out = batch.column(0), [[] for _ in range(6)]
            k = 0
            for ids in own.encode_column(batch.column(1)):
                ids += end
                n = len(ids) // 4
                # equal rows are counted, so that many of them are dealt to many groups, in whatever order they come
                same = f"{names[k].as_py()}:{zlib.crc32(ids)}".encode()
                met[same] += 1
                group = zlib.crc32(b"%b:%d" % (same, met[same])) % groups
                for at in range(0, n, length):
                    piece = ids[4 * at : 4 * (at + length)]
                    for column, x in zip(out, (k, at, len(piece) // 4, zlib.crc32(piece), n, group)):
                        column.append(x)
                k += 1
            yield pa.RecordBatch.from_arrays([names.take(pa.array(out[0], pa.int64())), *(pa.array(x, pa.int64()) for x in out[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pack_group"])

    return rows.mapInArrow(run, PIECES.format(rows.schema["doc_id"].dataType.simpleString()) + ", pack_group long")


def pack(docs: DataFrame, tokenizer_file: str, length: int = 1024, end_id: int = 0, group_docs: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and gives the end id alone. Null ids and repeated rows are documents of their own, dealt to
    groups by a hash of id, content and how many such rows the task has met, so that no value makes a group large and a
    task that is run again deals its rows as before; within a
    group, equal lengths are taken by id, start and checksum. sequence_id: the group's number times 2**32, plus the
    sequence's number in it. An empty table gives no rows. Other columns are not read.
    """
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(docs, tokenizer_file, groups, length, end_id)

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        at = first_fit_decreasing(group["length"].to_pylist(), length)
        base = group["pack_group"][0].as_py() << 32
        return group.drop_columns("pack_group").append_column("sequence_id", pa.array([base + b for b, _ in at], pa.int64())).append_column("offset", pa.array([o for _, o in at], pa.int64()))

    kind = cut.schema["doc_id"].dataType.simpleString()
    return cut.groupBy("pack_group").applyInArrow(packed, PIECES.format(kind) + ", sequence_id long, offset long")
