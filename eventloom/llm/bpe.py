"""Byte-level BPE encoding and decoding with a local rank file (operator 6).

``tiktoken`` encodes every whole text; texts beyond ``PIECE`` characters are cut first, and only
where the splitting pattern always ends a match: before a space that follows an ASCII letter or
digit, and between a character of the scripts that are written without spaces (Han, kana, Hangul,
Thai) and the full stop, comma or other mark of ``_MARKS`` that follows it. No match holds a
non-space character followed by a space, or a letter followed by a mark, and the look-ahead of the
white-space branch looks forward only, so the pieces' ids joined are the ids of the whole text.
Decoding joins the raw bytes of the ids. One map over the rows, no shuffle; a worker loads the
rank file once, from a path that every executor must see.

Null counts as the empty text: no ids. Texts in which no such place occurs are encoded whole.
Memory is bounded by ``PIECE`` and by a text with its ids.
Rows are independent, so ties, repeated rows and extra columns change nothing; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 200_000
_MARKS = "。、，．！？；：．.,!?;:"
_SAFE = re.compile(rf"(?<=[0-9A-Za-z]) |(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3\u0e01-\u0e2e])(?=[{_MARKS}])")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file (a line: base64 bytes, rank), without special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of at least ``size`` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode(enc, text: str | None, size: int = PIECE) -> np.ndarray:
    parts = [enc.encode_to_numpy(x, disallowed_special=()) for x in pieces(text or "", size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _column(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return source, source.schema["_key"].dataType.simpleString()


def encode_rows(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", carried: tuple[str, ...] = (), proven: bool = False) -> DataFrame:
    """(key, *carried, ids array<int>, n_tokens) of every row; ``proven`` decodes the ids again and adds the
    digest of these bytes as decoded_sha256."""
    source = docs.select(F.col(text).alias("_text"), key, *carried)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    names = [key, *carried, "ids", "n_tokens", *(["decoded_sha256"] if proven else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode(enc, t.as_py()) for t in part.column(0)]
                ends = np.cumsum([0, *map(len, ids)])
                values = pa.array(np.concatenate(ids).astype(np.int32))
                columns = [*part.columns[1:], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values), pa.array(np.diff(ends))]
                if proven:
                    columns.append(pa.array([hashlib.sha256(enc.decode_bytes(x.tolist())).hexdigest() for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, f"{kinds}, ids array<int>, n_tokens long" + (", decoded_sha256 string" if proven else ""))


def decode_rows(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, decoded binary): the raw bytes of each row's ``ids``; null ids give no bytes."""
    source = encoded.select(F.col(key).alias("_key"), "ids")
    kind = source.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([enc.decode_bytes(x.as_py() or []) for x in part.column(1)], pa.binary())], names=[key, "decoded"])

    return source.mapInArrow(run, f"`{key}` {kind}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of the ids as little-endian unsigned
    32-bit integers and of the bytes decoded from them, in one pass."""
    source, kind = _column(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            n, ids_sha, back_sha = [], [], []
            for value in batch.column(1):
                ids = encode(enc, value.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back_sha.append(hashlib.sha256(enc.decode_bytes(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
