"""Shared pieces of the corpus operators: staging, chunk rows, byte hashing, hash exchange.

Three operators (n-gram join, suffix dedup, block dedup) ask the same question of
the corpus: "what does the rest of the corpus know about this fingerprint?".  The
answer is computed by :func:`exchange`: each chunk of documents sends its *distinct*
fingerprints, pre-aggregated and packed as binary blobs, to fingerprint buckets; a
bucket folds the entries of every chunk and answers one byte per entry.  A fingerprint
held by a third of all documents therefore costs one entry per chunk, never one per
row, and no task sees a group larger than a bucket.
"""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside packed arrays; sorts after every real id.
NULL_ID = np.iinfo(np.int64).max
#: Bytes of text that one chunk row holds at least (a longer document makes a longer chunk).
CHUNK_BYTES = 4 << 20
#: Fingerprints that one exchange bucket handles on average.
BUCKET_ENTRIES = 1 << 19

#: Documents that one chunk row holds at most, so that a row number fits beside the chunk's.
CHUNK_DOCS = 1 << 13

#: Bytes of a text's digest.
SIGN_BYTES = 32
CHUNK_SCHEMA = "chunk_id long, n_bytes long, doc_ids binary, ends binary, signs binary, text binary"
#: Text bytes of one bucket of a chunk table, on average, where the corpus is large.
TABLE_BUCKET_BYTES = 1 << 28


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one is set only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="meshwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def staged(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage and survives lost executors; the table is immutable once written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_in = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the folders of staged tables that no later step reads, once what was made from them is staged too."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_in)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop shuffle files of phases whose result is staged."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id long, text string``; a null text is empty. Other columns are not read."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


# ---------------------------------------------------------------- chunk rows


def _pack_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, seq = TaskContext.get().partitionId() << 28, 0
    ids: list[int] = []
    parts: list[bytes] = []
    size = 0

    def row() -> pa.RecordBatch:
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        return pa.RecordBatch.from_pydict(
            {
                "chunk_id": pa.array([base + seq], pa.int64()),
                "n_bytes": pa.array([size], pa.int64()),
                "doc_ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                "ends": pa.array([ends.tobytes()], pa.binary()),
                "signs": pa.array([b"".join(hashlib.sha256(p).digest() for p in parts)], pa.binary()),
                "text": pa.array([b"".join(parts)], pa.binary()),
            }
        )

    for batch in batches:
        columns = [batch.column("doc_id").fill_null(NULL_ID), batch.column("text").cast(pa.binary())]
        for doc_id, raw in zip(*[c.to_pylist() for c in columns], strict=True):
            ids.append(doc_id)
            parts.append(raw)
            size += len(raw)
            if size >= CHUNK_BYTES or len(ids) >= CHUNK_DOCS:
                yield row()
                ids, parts, size, seq = [], [], 0, seq + 1
    if ids:
        yield row()


def chunk_table(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as rows of about four megabytes of text each, without a shuffle.

    The table is bucketed by chunk, so that answers are joined to it without moving texts again; its
    number of buckets grows with the corpus. ``signs`` holds the SHA-256 of every text.
    """
    spark = docs.sparkSession
    rows = text_rows(docs)
    name = f"chunks_{uuid.uuid4().hex}"
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TABLE_BUCKET_BYTES))
    packed = rows.mapInArrow(_pack_chunks, CHUNK_SCHEMA)
    packed.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "chunk_id").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    table.staged_in = f"{shared_dir(spark)}/{name}"
    # The name was needed only to write buckets: what was read keeps its files and their layout.
    spark.sql(f"DROP TABLE {name}")
    return table


def spread_join(rows: DataFrame, facts: DataFrame, key: str, by: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """Join ``rows`` to ``facts``, which has one row a ``key``; rows of a hot key are spread by their ``by``."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    copies = salted.select(key, "_salt").distinct().join(facts, key, how)
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def answered(chunks: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """Chunks with the answers of an exchange beside them; only the answers move."""
    return chunks.join(answers.withColumnRenamed("answers", name).hint("shuffle_hash"), "chunk_id", "left")


class Chunk:
    """One unpacked chunk row: ids, document bounds and text bytes."""

    __slots__ = ("chunk_id", "ids", "ends", "starts", "text")

    def __init__(self, row: dict) -> None:
        self.chunk_id = row["chunk_id"]
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.text = row["text"]

    def out_ids(self) -> list[int | None]:
        return [None if i == NULL_ID else int(i) for i in self.ids]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, so that only one chunk is unpacked at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(j)[k].as_py() for j, n in enumerate(batch.schema.names)}


# ---------------------------------------------------------------- byte hashing

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values (one fewer entry per step at the end)."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power(_MULT, n), out=total[1:])
    return mix((total[width:] - total[:-width]) * _power(_INV, n)[: n - width + 1] + np.uint64(width))


def byte_values(text: bytes, lower: bool = False) -> np.ndarray:
    return (_LOWER if lower else _BYTES)[np.frombuffer(text, np.uint8)]


def words_of(chunk: Chunk, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all documents of a chunk: byte start, byte end, hash, and words per document.

    Words are maximal runs of bytes other than ASCII white space and never cross documents.
    """
    raw = np.frombuffer(chunk.text, np.uint8)
    n = len(raw)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, np.uint64), np.zeros(len(chunk.ids), np.int64)
    solid = ~_SPACE[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = chunk.ends[(chunk.ends > 0) & (chunk.ends < n)]
    first[cuts] |= solid[cuts]
    last[cuts - 1] |= solid[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_values(chunk.text, lower) * _power(_MULT, n), out=total[1:])
    h = mix((total[end] - total[start]) * _power(_INV, n)[start])
    return start, end, h, np.searchsorted(start, chunk.ends) - np.searchsorted(start, chunk.starts)


def inside(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions, and owning documents, of windows of ``width`` that stay in one document."""
    fit = np.maximum(counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), fit)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.arange(fit.sum()) - np.repeat(np.cumsum(fit) - fit, fit) + np.repeat(first, fit)
    return at, owner


class Grouped:
    """Positions grouped by value: sorted distinct values and per-group minima and maxima."""

    def __init__(self, values: np.ndarray) -> None:
        self.order = np.argsort(values, kind="stable")
        ranked = values[self.order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.first = np.flatnonzero(new)
        self.distinct = ranked[self.first]
        self.group = np.empty(len(ranked), np.int64)
        self.group[self.order] = np.cumsum(new) - 1

    def least(self, values: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(values[self.order], self.first) if len(self.first) else values[:0]

    def most(self, values: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values[self.order], self.first) if len(self.first) else values[:0]


# ---------------------------------------------------------------- exchange

ENTRY_SCHEMA = "bucket long, chunk_id long, hashes binary, payload binary"
ANSWER_SCHEMA = "bucket long, chunk_id long, codes binary"


def bucket_count(entries: int) -> int:
    """Buckets for so many fingerprints; grows with the corpus."""
    return max(16, -(-int(entries) // BUCKET_ENTRIES))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a 64-bit fingerprint from its upper half; the order of fingerprints is kept."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _planes(h: np.ndarray, bits: int) -> bytes:
    """Sorted fingerprints as planes of their leading and trailing bits, which compress well."""
    h = h >> np.uint64(64 - bits)
    lead = [(h >> np.uint64(s)).astype(np.uint16).tobytes() for s in range(bits - 16, 31, -16)]
    return b"".join([*lead, h.astype(np.uint32).tobytes()])


def _from_planes(raw: bytes, bits: int) -> np.ndarray:
    n = len(raw) * 8 // bits
    h = np.frombuffer(raw[len(raw) - 4 * n :], np.uint32).astype(np.uint64)
    for k, s in enumerate(range(bits - 16, 31, -16)):
        h |= np.frombuffer(raw[2 * n * k : 2 * n * (k + 1)], np.uint16).astype(np.uint64) << np.uint64(s)
    return h


def entries(chunk_id: int, hashes: np.ndarray, payload: np.ndarray, buckets: int, bits: int = 64) -> Iterator[pa.RecordBatch]:
    """Pack sorted distinct fingerprints and their payloads by bucket.

    With ``bits`` 48 fingerprints are cut: enough where an answer only pre-selects.
    """
    if not len(hashes):
        return
    b = bucket_of(hashes, buckets)
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    ends = np.append(cut[1:], len(b))
    yield pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(b[cut].astype(np.int64)),
            "chunk_id": pa.array(np.full(len(cut), chunk_id, np.int64)),
            "hashes": pa.array([_planes(hashes[i:j], bits) for i, j in zip(cut, ends, strict=True)], pa.binary()),
            "payload": pa.array([payload[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()),
        }
    )


def exchange(
    sent: DataFrame,
    payload: str,
    fold: Callable[[np.ndarray, np.ndarray, int], np.ndarray],
    bits: int = 64,
) -> DataFrame:
    """Answer every entry of every chunk with one byte, folded over the whole corpus.

    ``fold(values, group, n_groups)`` gets the payloads of a bucket (dtype ``payload``) and
    the number of the fingerprint that each belongs to; it returns a ``uint8`` per entry.
    Returned per chunk: ``chunk_id, codes`` with the codes of all its entries in fingerprint
    order. ``bits`` is what the sender gave to :func:`entries`.
    """

    def answer(table: pa.Table) -> pa.Table:
        blobs = [x.as_py() for x in table.column("hashes")]
        keys = np.concatenate([_from_planes(x, bits) for x in blobs])
        values = np.concatenate([np.frombuffer(x.as_py(), payload) for x in table.column("payload")])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        codes = fold(values, group, int(new.sum()))
        sizes = [len(x) * 8 // bits for x in blobs]
        ends = np.cumsum(sizes)
        return pa.table(
            {
                "bucket": table.column("bucket"),
                "chunk_id": table.column("chunk_id"),
                "codes": pa.array([codes[j - n : j].tobytes() for n, j in zip(sizes, ends, strict=True)], pa.binary()),
            }
        )

    answers = sent.groupBy("bucket").applyInArrow(answer, ANSWER_SCHEMA)
    return answers.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "codes"))).alias("answers"))


def codes_of(row: dict) -> np.ndarray:
    """All answers of a chunk row joined with :func:`exchange`, in fingerprint order."""
    if not row.get("answers"):
        return np.zeros(0, np.uint8)
    return np.frombuffer(b"".join(x["codes"] for x in row["answers"]), np.uint8)
