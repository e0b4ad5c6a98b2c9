"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Method: a text is cut at boundaries where every match of the pre-splitting pattern ends whatever surrounds it
(before a run of white space that follows another character). The pieces between are short and recur, so each
worker keeps a bounded cache from piece to ids; a piece that isn't in the cache goes to tiktoken. Very long runs of
white space, on which the pattern's backtracking overflows the stack, are matched by the `regex` library instead,
each match being encoded on its own as tiktoken does. Decoding joins the raw bytes of ids, so ids that cut a
character in two still give back the exact bytes.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows give repeated results; ids,
texts and document ids that are null or repeated are passed on as they are; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Unicode White_Space, as `\s` of the rank file's pattern means it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
LONG_SPACE = 2_000  #: a run of white space from which `regex` matches in tiktoken's place
CACHE_PIECES, CACHED_CHARS = 400_000, 64


class Codec:
    """One worker's encoder: tiktoken's ranks with a bounded cache of short pieces."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.inner = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.matches = regex.compile(pattern)
        self.table = {i: b for b, i in ranks.items()}
        self.cache: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        from array import array

        if len(text) > LONG_SPACE and re.search(f"[{SPACE}]{{{LONG_SPACE},}}", text):
            ids: list[int] = []
            for m in self.matches.finditer(text):
                ids += self.inner.encode_single_piece(m[0]) if hasattr(self.inner, "encode_single_piece") else self.inner._encode_single_piece(m[0])
        else:
            ids = self.inner.encode_ordinary(text)
        out = array("I", ids).tobytes()
        if len(text) <= CACHED_CHARS:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[text] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known = self.cache
        return b"".join([known.get(p) or self.piece(p) for p in PIECE.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary): each text's ids as little-endian unsigned 32-bit integers. One narrow pass, no shuffle."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for whole in batches:
            for b in slices(whole, 1):
                ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encode()'s rows with `decoded` binary: the raw bytes of the ids."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for whole in batches:
            for b in slices(whole, 2):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.decode(x or b"") for x in b.column(2).to_pylist()], pa.binary())], ["id", "n_tokens", "ids", "decoded"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of the ids and of the bytes decoded from them."""
    both = decode(encode(docs, ranks_path, pattern), ranks_path, pattern)
    return both.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
