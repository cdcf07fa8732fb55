"""Token ids as files of length-delimited binary records, with an offset index beside each file.

A record is framed as: its payload's length (unsigned 64 bits), a masked checksum of those eight bytes, the
payload, a masked checksum of the payload. A checksum is CRC-32, rotated right by 15 bits plus a constant
modulo 2**32, so that a record which holds other records' checksums doesn't look valid by chance. A payload is
a flag word (1: the id is null; 2: wide tokens), the document's id (signed 64 bits) and the token ids, all
little-endian. Token ids have 16 bits where all of a record's fit, else 32. ``part-N.idx`` has 32 bytes a record: its offset in ``part-N.rec``, its size, its number of
tokens, the document's id; a shuffled read seeks by it.

Files are numbered in ascending doc_id order (null ids first; equal ids by their text's hash), and so are the
records inside each. A task writes under a name of its own and then renames, so a repeated task replaces its
file by the same bytes. All I/O goes through pyarrow's file systems in the folder the executors share.

Edge cases: a null or empty text is a record of the end id alone; repeated rows are records each; an empty
table gives no records. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage, stage_path, table, text_batches
from .word_encoder import encoder, vocabulary_path

MASK_DELTA = 0xA282EAD8
END_ID = 1
INDEX = np.dtype([("offset", "<u8"), ("size", "<u8"), ("n_tokens", "<u8"), ("doc_id", "<i8")])
HEAD, HEAD_SIZE = "<QI", 12
PAYLOAD, PAYLOAD_SIZE = "<Iq", 12
BUFFER = 4 << 20


class CorruptRecord(ValueError):
    pass


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked_crc(size)) + payload + struct.pack("<I", masked_crc(payload))


def _file_system(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return (fs.LocalFileSystem(), path[5:] if path.startswith("file:") else path)


def read_frames(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of every record; both checksums are verified."""
    at = 0
    while head := stream.read(HEAD_SIZE):
        if len(head) < HEAD_SIZE or masked_crc(head[:8]) != struct.unpack(HEAD, head)[1]:
            raise CorruptRecord(f"length at {at}")
        size = struct.unpack(HEAD, head)[0]
        body = stream.read(size + 4)
        if len(body) < size + 4 or masked_crc(body[:size]) != struct.unpack("<I", body[size:])[0]:
            raise CorruptRecord(f"payload at {at}")
        yield at, body[:size]
        at += HEAD_SIZE + size + 4


def serialize(doc_id: int | None, tokens: bytes) -> bytes:
    """The payload of a document; tokens: unsigned 32-bit ids."""
    ids = np.frombuffer(tokens, dtype="<u4")
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return struct.pack(PAYLOAD, (doc_id is None) | 2 * wide, doc_id or 0) + (tokens if wide else ids.astype("<u2").tobytes())


def parse(payload: bytes) -> tuple[int | None, bytes]:
    """Id and tokens, as unsigned 32-bit ids."""
    flag, doc_id = struct.unpack_from(PAYLOAD, payload)
    body = payload[PAYLOAD_SIZE:]
    return None if flag & 1 else doc_id, body if flag & 2 else np.frombuffer(body, dtype="<u2").astype("<u4").tobytes()


def write_records(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode (doc_id, text) and write the files below path; the manifest (file, n_records, n_ids), staged."""
    spark = docs.sparkSession
    text_batches(spark)
    vocabulary = vocabulary or vocabulary_path()
    end = np.array([end_id], dtype="<u4").tobytes()
    fs, root = _file_system(path)
    fs.create_dir(root, recursive=True)

    def write(batches):
        task = TaskContext.get()
        fs, root = _file_system(path)
        name = f"part-{task.partitionId():06d}"
        own = f"{root}/_{name}-{task.taskAttemptId()}"
        encode, index, at, n_ids = encoder(vocabulary), [], 0, 0
        with fs.open_output_stream(f"{own}.rec", buffer_size=BUFFER) as out:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for doc_id, tokens in zip(ids, encode.encode_all(batch.column(1).to_pylist()), strict=True):
                    tokens += end
                    record = frame(serialize(doc_id, tokens))
                    out.write(record)
                    index.append((at, len(record), len(tokens) // 4, doc_id or 0))
                    at += len(record)
                    n_ids += len(tokens) // 4
        with fs.open_output_stream(f"{own}.idx") as out:
            out.write(np.array(index, dtype=INDEX).tobytes())
        for kind in ("idx", "rec"):
            fs.move(f"{own}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pylist([{"file": name, "n_records": len(index), "n_ids": n_ids}])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    return stage(ordered.mapInArrow(write, "file string, n_records long, n_ids long"), "records-manifest")


def read_records(manifest: DataFrame, path: str, shuffle_seed: int | None = None) -> DataFrame:
    """(file, doc_id, start, n_tokens, ids) of every record, checksums verified.

    start is the number of ids in all records before it. With a seed, the records of each file come in a
    random order, found through its index.
    """
    bases = manifest.where("n_records > 0").select("file", (F.sum("n_ids").over(W.orderBy("file")) - F.col("n_ids")).alias("base"))
    n_files = max(1, bases.count())

    def read(batches):
        fs, root = _file_system(path)
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size = [], 0
                for doc_id, start, tokens in (_in_order if shuffle_seed is None else _shuffled)(fs, root, name, base):
                    rows.append((name, doc_id, start, len(tokens) // 4, tokens))
                    size += len(tokens)
                    if size > BUFFER:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _in_order(fs, root, name, base):
        with fs.open_input_stream(f"{root}/{name}.rec", buffer_size=BUFFER) as stream:
            for _, payload in read_frames(stream):
                doc_id, tokens = parse(payload)
                yield doc_id, base, tokens
                base += len(tokens) // 4

    def _shuffled(fs, root, name, base):
        with fs.open_input_stream(f"{root}/{name}.idx") as stream:
            index = np.frombuffer(stream.read(), dtype=INDEX)
        starts = base + np.cumsum(index["n_tokens"]) - index["n_tokens"]
        with fs.open_input_file(f"{root}/{name}.rec") as f:
            for i in np.random.default_rng([shuffle_seed, zlib.crc32(name.encode())]).permutation(len(index)):
                f.seek(int(index["offset"][i]))
                _, payload = next(read_frames(pa.BufferReader(f.read(int(index["size"][i])))))
                doc_id, tokens = parse(payload)
                yield doc_id, int(starts[i]), tokens

    return bases.repartition(n_files, "file").mapInArrow(read, "file string, doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "doc_id", "start", "n_tokens", "ids"])


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "records")
    manifest = write_records(table(spark, sf_dir, "documents"), path)
    return read_records(manifest, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op4_records": op4_records}
SQL: dict[str, str] = {}
