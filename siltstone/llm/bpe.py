"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cache_cleared_by, claim, text_of
from siltstone.llm.token_pieces import PieceEncoder

#: Pieces of more characters than this are matched by the regex module, whose matching does not recurse on long white space.
LONG_PIECE = 2_000


@lru_cache(2)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file (``base64-token rank`` lines), without special tokens."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(f"local-{len(ranks)}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def encoder(rank_file: str, pattern: str) -> PieceEncoder:
    import regex

    own, matches = encoding(rank_file, pattern), regex.compile(pattern)

    def encode_one(piece: str) -> list[int]:
        # words that each follow one space are safe at any length
        if len(piece) <= LONG_PIECE or "  " not in piece and piece.replace(" ", "").isalpha():
            return own.encode_ordinary(piece)
        return [i for m in matches.finditer(piece) for i in own._encode_single_piece(m[0])]

    starts = np.zeros(own.n_vocab, bool)
    starts[[rank for token, rank in own._mergeable_ranks.items() if token.startswith(b" ")]] = True
    return PieceEncoder(lambda pieces: [encode_one(p) for p in pieces], starts)


cache_cleared_by("bpe", encoder.cache_clear)


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit) and ``n_tokens`` to the rows of docs.

    Null texts count as empty and have no ids. Rows are independent: repeated rows, ties and other columns, whatever
    their names, pass through, save that columns named ids and n_tokens are replaced.
    """
    others = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    rows = docs.select(*others, text_of(text).alias("_bpe_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        own = encoder(rank_file, pattern)
        for batch in batches:
            ids = list(own.encode_column(batch.column(len(others))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=[*others, "ids", "n_tokens"])

    return rows.mapInArrow(run, rows.drop("_bpe_text").schema.add("ids", "binary").add("n_tokens", "long"))


def decode_bytes(ids: bytes, rank_file: str, pattern: str) -> bytes:
    """The raw bytes of packed ids; these need not be whole UTF-8."""
    return encoding(rank_file, pattern).decode_bytes(memoryview(ids).cast("I").tolist())


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded, then decoded to bytes.

    A null text counts as empty: no ids, and the digests of nothing. Null ids and repeated rows each keep a row. Very long
    texts are encoded piece by piece like others. An empty table gives no rows; columns other than doc_id and text, whatever
    their names, are not read.
    """
    rows = docs.select("doc_id", text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        own, enc = encoder(rank_file, pattern), encoding(rank_file, pattern)
        for batch in batches:
            n, digests, decoded = [], [], []
            for ids in own.encode_column(batch.column(1)):
                n.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(enc.decode_bytes(memoryview(ids).cast("I").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
