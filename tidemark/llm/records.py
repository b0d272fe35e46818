"""Operator 8, token-ID output as length-delimited binary records.

A record is: length of the payload (8 bytes, little endian), masked CRC-32C of those 8 bytes, the payload, masked CRC-32C
of the payload. A payload is: document id (8 bytes, signed), number of tokens (4 bytes), then the token ids, 2 bytes each
for vocabularies up to 65,536 and 4 beyond. Each task writes one shard; a separate Parquet index has shard, offset,
length and number of tokens for every record, so that a reader can shuffle records globally and seek to each.

A shard's name has a random part for each attempt of its task, and Spark commits index rows of successful attempts
only; shards that no row names, from lost or repeated attempts, are deleted at the end. Checksums are computed for all
records of a batch at once: CRC-32C is linear, so blocks of 64 bytes are looked up by position, shifted and added.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, small_batches, work_dir
from tidemark.llm.tokens import TOKENIZERS, VOCABULARY, Tokens

BLOCK = 64
NO_ID = -(2**63)


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


_T = _byte_table()


def _zero_byte(crc: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(8)) ^ _T[crc & np.uint32(255)]


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    place = np.empty((BLOCK, 256), np.uint32)  # effect of a byte that so many bytes of the block follow
    place[-1] = _T
    for k in range(BLOCK - 2, -1, -1):
        place[k] = _zero_byte(place[k + 1])
    shift = [np.stack([_zero_byte(np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)])]  # past 2**k bytes
    for _ in range(31):
        shift.append(_apply(shift[-1], shift[-1]))
    return place, shift


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    m = np.uint32(255)
    return table[0][crc & m] ^ table[1][(crc >> np.uint32(8)) & m] ^ table[2][(crc >> np.uint32(16)) & m] ^ table[3][crc >> np.uint32(24)]


_PLACE, _SHIFT = _tables()


def _past(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The remainder after so many more zero bytes."""
    crc = crc.copy()
    for k in range(int(zeros.max(initial=0)).bit_length()):
        some = np.flatnonzero((zeros >> k) & 1)
        crc[some] = _apply(_SHIFT[k], crc[some])
    return crc


def crc32c(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32C of data[start:end] for each pair."""
    size = end - start
    blocks = -(-size // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    padded = np.zeros(int(first[-1]) * BLOCK, np.uint8)  # zeros before a message leave the bare remainder alone
    to = first[1:] * BLOCK - size
    shift = np.repeat(to - start, size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    padded[at + shift] = data[at]
    rows = padded.reshape(-1, BLOCK)
    part = np.zeros(len(rows), np.uint32)
    for k in range(BLOCK):
        part ^= _PLACE[k][rows[:, k]]
    behind = (np.repeat(first[1:], blocks) - 1 - np.arange(len(rows))) * BLOCK
    part = _past(part, behind)
    out = _past(np.full(len(size), 0xFFFFFFFF, np.uint32), size)
    some = np.flatnonzero(blocks)
    if len(some):
        out[some] ^= np.bitwise_xor.reduceat(part, first[:-1][some])
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(ids: list[int], tokens: list[np.ndarray], kind: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bytes of the records, offset of each, length of each payload)."""
    body = [int(i).to_bytes(8, "little", signed=True) + len(t).to_bytes(4, "little") + t.astype(kind).tobytes() for i, t in zip(ids, tokens)]
    size = np.array([len(b) for b in body], np.int64)
    offset = np.cumsum(size + 16) - size - 16
    head = size.astype("<u8").view(np.uint8)
    at = np.arange(len(body)) * 8
    head_crc = masked(crc32c(head, at, at + 8)).astype("<u4")
    data = np.frombuffer(b"".join(body), np.uint8)
    ends = np.cumsum(size)
    body_crc = masked(crc32c(data, ends - size, ends)).astype("<u4")
    out = b"".join(x for k, b in enumerate(body) for x in (head[8 * k : 8 * k + 8].tobytes(), head_crc[k].tobytes(), b, body_crc[k].tobytes()))
    return out, offset, size


def read_record(raw: bytes, kind: str = "<u2") -> tuple[int, np.ndarray]:
    """(document id, token ids) of a record; raises ValueError where a checksum or a length is wrong."""
    data = np.frombuffer(raw, np.uint8)
    size = int.from_bytes(raw[:8], "little")
    if len(raw) != size + 16 or size < 12:
        raise ValueError("wrong length")
    found = masked(crc32c(data, np.array([0, 12]), np.array([8, 12 + size])))
    if int(found[0]) != int.from_bytes(raw[8:12], "little") or int(found[1]) != int.from_bytes(raw[12 + size :], "little"):
        raise ValueError("wrong checksum")
    ids = np.frombuffer(raw[24 : 12 + size], kind)
    if len(ids) != int.from_bytes(raw[20:24], "little"):
        raise ValueError("wrong number of tokens")
    return int.from_bytes(raw[12:20], "little", signed=True), ids


def write_records(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """Writes ``docs`` as records under ``path`` (by default a new folder in the cluster's shared one; it stays there when
    the session ends) and returns the index: (doc_id, shard, offset, length, n_tokens), length with the frame.

    A null text has no record, an empty one a record without tokens; a null id is written as -2**63 and is null in the
    index; repeated rows have a record each; an empty table has no shards. Texts are encoded whole, however long
    they or their runs of white space are. Columns other
    than the two are never read. ``doc_id`` must be an integer.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    path = path or f"{work_dir(spark)}/records-{uuid.uuid4().hex}"
    tokens = Tokens(spark, folder, name)
    kind = "<u2" if tokens.size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder()
        fs, root = pafs.FileSystem.from_uri(path)
        shard, out, at = f"shard-{uuid.uuid4().hex}.bin", None, 0
        try:
            for part in batches:
                ids = [NO_ID if x is None else x for x in part.column("id").to_pylist()]
                encoded = [np.array(encode(x.as_py()), kind) for x in part.column("t")]
                raw, offset, size = frames(ids, encoded, kind)
                if out is None:
                    fs.create_dir(f"{root}/data", recursive=True)
                    out = fs.open_output_stream(f"{root}/data/{shard}")
                out.write(raw)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([shard] * len(ids)), pa.array(offset + at), pa.array(size + 16), pa.array([len(t) for t in encoded], pa.int64())],
                    ["id", "shard", "offset", "length", "n_tokens"],
                )
                at += len(raw)
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).where("t IS NOT NULL")
    index = rows.mapInArrow(lean(run, 500, keep="tokens"), "id long, shard string, offset long, length long, n_tokens long").withColumnRenamed("id", doc_id)
    index.write.parquet(f"{path}/index")
    index = spark.read.schema(index.schema).parquet(f"{path}/index")
    named = {r.shard for r in index.select("shard").distinct().toLocalIterator()}
    fs, root = pafs.FileSystem.from_uri(path)
    for found in fs.get_file_info(pafs.FileSelector(f"{root}/data", allow_not_found=True)):
        if found.base_name not in named:
            fs.delete_file(found.path)
    return index
