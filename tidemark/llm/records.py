"""Token ids as length-delimited binary records with a separate offset index.

A record is: length of the payload (unsigned 64-bit), masked checksum of those eight bytes, payload,
masked checksum of the payload (all little-endian). The checksum is CRC-32, rotated and shifted by a
constant so that a checksum of data that holds checksums stays meaningful. The payload is one byte for
the width of an id (2 or 4), and the ids. The index is a Parquet table with one row per record; it is
all that a reader needs to read records in any order, or only some of them.

Documents are range-partitioned by id, so files follow each other in ascending order and tasks never
hold more than a batch. Writing happens in tasks; the index names the files of successful attempts.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import map_arrow, partitions_for
from tidemark.llm.files import Reader, attempt_name, open_fs
from tidemark.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
FOOT = struct.Struct("<I")
READ_SPAN = 8 << 20

INDEX = "doc_id long, file_no int, file string, offset long, length long, start_in_file long, n_tokens long"


def masked_crc(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return HEAD.pack(len(payload), masked_crc(size)) + payload + FOOT.pack(masked_crc(payload))


def unframe(data: memoryview) -> memoryview:
    """Payload of one framed record; raises if a length or checksum does not hold."""
    size, check = HEAD.unpack_from(data)
    if masked_crc(data[:8]) != check or HEAD.size + size + FOOT.size != len(data):
        raise ValueError("broken record length")
    payload = data[HEAD.size : HEAD.size + size]
    if masked_crc(payload) != FOOT.unpack_from(data, HEAD.size + size)[0]:
        raise ValueError("broken record")
    return payload


# A word with the space before it, or white space the way the tokenizer's own pattern cuts it. The
# tokenizer never merges across these cuts, so a piece has the same ids in every text.
_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_FINE = regex.compile(public_tokenizers.PATTERN)
_STOPS = frozenset(".,;:!?")
# White space on which two regex engines may differ, and text that may be a special token: encoded whole.
_ODD = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]|<\|")
_MEMO_ROWS = 900_000
_MEMO_PIECE = 64
_TEXTS = 512
_STATE: dict = {}


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = _byte_letters()


class Encoder:
    """Encodes texts with a byte-level tokenizer of the tokenizers library, each distinct piece once.

    A text is cut the way the tokenizer's own pattern cuts it; each piece goes through the library's model.
    Ids of pieces are kept for the life of the worker process in two generations of a fixed size: when the
    younger is full it becomes the older, so pieces in use stay.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, piece: str) -> bytes | None:
        found = self.young.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is not None:
                self._keep(piece, found)
        return found

    def _keep(self, piece: str, ids: bytes) -> None:
        if len(piece) <= _MEMO_PIECE:
            if len(self.young) >= _MEMO_ROWS:
                self.young, self.old = {}, self.young
            self.young[piece] = ids

    def _modelled(self, piece: str) -> bytes:
        letters = piece.replace(" ", "Ġ") if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(_LETTERS)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece between white space: one or several pieces of the tokenizer's pattern."""
        found = self._known(piece)
        if found is not None:
            return found
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha():
            ids = self._modelled(piece)
        else:
            fine = [piece[:-1], piece[-1]] if word[-1:] in _STOPS and word[:-1].isalpha() else _FINE.findall(piece)
            ids = self._modelled(piece) if len(fine) == 1 else b"".join(map(self._piece, fine))
        self._keep(piece, ids)
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if _ODD.search(t) else _PIECES.findall(t) for t in texts]
        ids = {p: self.young.get(p) or self._piece(p) for p in set().union(*(pieces for pieces in cut if pieces))}
        whole = iter(self._whole([t for t, pieces in zip(texts, cut, strict=True) if pieces is None]))
        return [next(whole) if pieces is None else b"".join(map(ids.__getitem__, pieces)) for pieces in cut]


def encoder(path: str) -> Encoder:
    if path not in _STATE:
        _STATE[path] = Encoder(path)
    return _STATE[path]


def _writer(folder: str, tokenizer: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([END_ID], enc.dtype).tobytes()
        width = bytes([enc.dtype.itemsize])
        name, number = attempt_name(".rec"), TaskContext.get().partitionId()
        out, offset, start = None, 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(lo, _TEXTS)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    if out is None:
                        filesystem, root = open_fs(folder)
                        out = filesystem.open_output_stream(f"{root}/{name}")
                    record = frame(width + ids + end)
                    out.write(record)
                    n = len(ids) // enc.dtype.itemsize + 1
                    rows.append((doc_id, number, name, offset, len(record), start, n))
                    offset += len(record)
                    start += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _INDEX_TYPES, strict=True)], _INDEX_NAMES
                )
        if out is not None:
            out.close()

    return write


_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_INDEX_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in INDEX.split(", ")]


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None) -> None:
    """Write ``docs(doc_id, text)`` as records under ``folder/data``, their index under ``folder/index``.

    Order is ascending ``doc_id``, NULL first; rows of one id follow in the order of their text's hash.
    NULL texts are empty: a record of the end id alone. An empty table writes an empty index.
    """
    filesystem, root = open_fs(f"{folder}/data")
    filesystem.create_dir(root, recursive=True)
    n = partitions_for(docs, 24)
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    write = _writer(f"{folder}/data", tokenizer or public_tokenizers.path(TOKENIZER))
    map_arrow(ordered.select("doc_id", "text"), write, INDEX).write.parquet(f"{folder}/index")


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Reader(folder)
        for batch in batches:
            rows = batch.to_pylist()
            ids = []
            i = 0
            while i < len(rows):  # neighbours in a file are read together
                j, size = i, 0
                while j < len(rows) and rows[j]["file"] == rows[i]["file"] and rows[j]["offset"] == rows[i]["offset"] + size and (j == i or size + rows[j]["length"] <= READ_SPAN):
                    size += rows[j]["length"]
                    j += 1
                span = files.read(rows[i]["file"], rows[i]["offset"], size)
                at = 0
                for row in rows[i:j]:
                    payload = unframe(span[at : at + row["length"]])
                    ids.append(np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4"))
                    at += row["length"]
                i = j
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("int64")
            flat = pa.array(np.concatenate(ids).view("<i4") if ids else np.zeros(0, "<i4"))
            crc = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())
            keep = [batch.column(batch.schema.names.index(c)) for c in ("doc_id", "file_no", "start_in_file")]
            yield pa.RecordBatch.from_arrays([*keep, pa.LargeListArray.from_arrays(pa.array(offsets), flat).cast(pa.list_(pa.int32())), crc], ["doc_id", "file_no", "start_in_file", "ids", "ids_crc32"])
        files.close()

    return read


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """``doc_id, file_no, start_in_file, ids, ids_crc32`` of the records that ``index`` rows point to.

    The rows may be any subset in any order and partitioning (a shuffled read). Lengths and checksums
    are verified; a broken record fails the job.
    """
    return map_arrow(index, _reader(f"{folder}/data"), "doc_id long, file_no int, start_in_file long, ids array<int>, ids_crc32 long")


def file_starts(index: DataFrame) -> DataFrame:
    """``file_no, file_start``: tokens of all files before; one row per file, of which there are few."""
    totals = index.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def token_records(docs: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, read back from records written in the shared folder.

    One row per row of ``docs``. ``start`` counts the ids of all records before. Columns other than
    ``doc_id`` and ``text`` are not read.
    """
    spark = spark or docs.sparkSession
    folder = scratch_path(spark, "records")
    write_records(docs, folder)
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    n = partitions_for(index, 1)
    spread = index.repartitionByRange(n, "file_no", "offset").sortWithinPartitions("file_no", "offset")
    back = read_records(spread, folder).select("doc_id", "file_no", "start_in_file", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32")
    placed = back.join(file_starts(index), "file_no")
    return placed.select("doc_id", (F.col("file_start") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")
