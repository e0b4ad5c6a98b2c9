"""Token ids in binary files: documents encoded with a `tokenizers` file, ids coded with Simple-8b, files read back.

Documents are range-partitioned and sorted by id, so that partition by partition, and file by file within one, ids
stand in ascending document order. Each task encodes its documents and writes files of about FILE_IDS ids; a file's
layout, all little-endian, is: magic `S8BK`, version u32, ids u64, documents u64, words u64, block size u64; then per
document id i64, its presence u8 and number of ids u64; then per block the index of its first word u64; then the words.
A file is written under a name of the attempt and renamed, so a task that runs again replaces it by the same bytes.
The list of files is a table in the shared folder; a running sum over it gives every file's first position.

Encoding uses the library's model: a text is split at ASCII white space, which the tokenizer drops anyway, and each
distinct piece is encoded once per worker and kept in a bounded cache. Pieces that are lower-case Latin letters, for
which normalising changes nothing, go to the model's BPE directly; all others through the whole tokenizer.

Defined results: a null text counts as empty and still ends with the end id; a null doc_id comes after all others;
rows of equal doc_id are ordered by text; an empty table gives no file and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, settle, shared_uri, slices, written

FILE_IDS = 4_000_000
CACHE_PIECES = 1_000_000
HEAD = 48
#: White space to str.split(), but not to this module, which cuts at ASCII white space alone.
OTHER_SPACE = [chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


class PieceEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.cache = self.whole.model, {}
        self.simple = re.compile("[a-zß-öø-ÿ]+").fullmatch
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level BPE
        rest = [b for b in range(256) if b not in own]
        self.letters = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def piece(self, text: str) -> bytes:
        from array import array

        if self.simple(text):
            ids = [t.id for t in self.model.tokenize(text if text.isascii() else "".join([self.letters[b] for b in text.encode()]))]
            out = array("I", ids).tobytes()
        elif len(text) > 1 and text[-1] in ".,!?;:|" and text[-2].isascii() and text[-2].isalpha():
            out = self.get(text[:-1]) + self.get(text[-1])  # a letter and such a sign never share a match
        elif text.isascii() and text.isalpha():
            out = self.get(text.lower())
        else:
            out = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(text) <= 64:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[text] = out
        return out

    def get(self, text: str) -> bytes:
        return self.cache.get(text) or self.piece(text)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known = self.cache.get
        odd = OTHER_SPACE[:4] if text.isascii() else OTHER_SPACE
        pieces = re.findall(r"[^\t-\r ]+", text) if any(c in text for c in odd) else text.split()
        return b"".join([known(p) or self.piece(p) for p in pieces])


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def pack_file(doc_ids: list, counts, ids, block: int) -> bytes:
    import numpy as np

    from . import simple8b

    words, offsets = simple8b.encode(ids, block)
    head = b"S8BK" + (1).to_bytes(4, "little") + b"".join(int(x).to_bytes(8, "little") for x in (len(ids), len(doc_ids), len(words), block))
    there = np.array([i is not None for i in doc_ids], "u1")
    return b"".join([head.ljust(HEAD, b"\0"), np.array([i or 0 for i in doc_ids], "<i8").tobytes(), there.tobytes(), np.array(counts, "<u8").tobytes(), offsets.tobytes(), words.tobytes()])


def unpack_file(data: bytes):
    """(doc_ids with None, counts, ids) of a file's bytes."""
    import numpy as np

    from . import simple8b

    assert data[:4] == b"S8BK", "not a token file"
    n, docs, words, block = (int.from_bytes(data[8 + 8 * k : 16 + 8 * k], "little") for k in range(4))
    ids = np.frombuffer(data, "<i8", docs, HEAD).tolist()
    there = np.frombuffer(data, "u1", docs, HEAD + 8 * docs)
    counts = np.frombuffer(data, "<u8", docs, HEAD + 9 * docs).astype("i8")
    at = HEAD + 17 * docs + 8 * (-(-n // block))
    return [i if t else None for i, t in zip(ids, there)], counts, simple8b.decode(np.frombuffer(data, "<u8", words, at), n, block)


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, file_ids: int = FILE_IDS, block: int = 4096) -> DataFrame:
    """Write the token files of docs (doc_id, text) into folder (a URI); return the list of files: path, first, n_ids, n_docs."""

    def run(batches):
        import numpy as np
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder, end = piece_encoder(tokenizer_path), int(end_id).to_bytes(4, "little")
        doc_ids, parts, total, number = [], [], 0, 0

        def close():
            system, base = fs.FileSystem.from_uri(folder)
            system.create_dir(base, recursive=True)
            name = f"{base}/ids-{task.partitionId():06d}-{number:06d}.s8b"
            data = pack_file(doc_ids, [len(x) // 4 for x in parts], np.frombuffer(b"".join(parts), "<u4"), block)
            with system.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
                out.write(data)
            settle(system, f"{name}.{task.taskAttemptId()}", name)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, task.partitionId(), number, total, len(doc_ids))], ["path", "part", "number", "n_ids", "n_docs"])

        for whole in batches:
            for b in slices(whole, 1):
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    doc_ids.append(i)
                    parts.append(encoder.encode(text or "") + end)
                    total += len(parts[-1]) // 4
                    if total >= file_ids:
                        yield close()
                        doc_ids, parts, total, number = [], [], 0, number + 1
        if doc_ids:
            yield close()

    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(docs.sparkSession), order[0]).sortWithinPartitions(*order)
    files = written(rows.mapInArrow(run, "path string, part long, number long, n_ids long, n_docs long"), "files")
    before = F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    return files.select("path", F.coalesce(before, F.lit(0)).alias("first"), "n_ids", "n_docs")


def read(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, start the number of ids before the document's."""

    def run(batches):
        import numpy as np
        from pyarrow import fs

        system = fs.FileSystem.from_uri(folder)[0]
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with system.open_input_file(path) as f:
                    doc_ids, counts, ids = unpack_file(f.read())
                ends = np.cumsum(counts)
                for k in range(0, len(doc_ids), 1000):
                    cut = slice(k, k + 1000)
                    own = [ids[e - c : e].astype("<u4").tobytes() for e, c in zip(ends[cut], counts[cut])]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[cut], pa.int64()), pa.array(ends[cut] - counts[cut] + first), pa.array(counts[cut]), pa.array(own, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    spread = files.select("path", "first").repartition(partitions(files.sparkSession), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def store(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write docs to a new folder in the shared folder and read them back: read()'s rows."""
    folder = f"{shared_uri(spark)}/ids-{uuid.uuid4().hex}"
    return read(write(docs, folder, tokenizer_path, end_id), folder)

