"""Token files: independent zstandard frames, a document index and a trailing seek table.

A shard holds the ids of consecutive documents.  Frames are cut at document ends once
they hold FRAME_IDS ids (a document longer than a frame may hold spans several), so a reader
decompresses only the frames of the documents it wants.  Layout:

* data frames: ids as little-endian unsigned integers of ``width`` bytes
* one index frame: width, number of documents, their ids (null: the largest 64-bit integer)
  and numbers of ids, all little-endian 64-bit
* a skippable frame with one entry per frame (compressed size, content size, lower half of the
  content's xxh64, all 32-bit) and the footer (number of frames, descriptor, magic number)
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NULL_ID, shared_dir, staged, text_rows
from .tokens import END_ID, definition, tokenizer

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

FRAME_IDS = 1 << 16
#: A frame's content stays below this, whatever a document's length.
MOST_FRAME_IDS = 1 << 26
LEVEL = 3
#: Text that one file holds at most, on average, where the corpus is large.
SHARD_BYTES = 1 << 29

SHARDS = "shard long, path string, n_docs long, n_ids long, n_bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Appends documents to a token file."""

    def __init__(self, sink, width: int = 4) -> None:
        import zstandard

        self.sink, self.width = sink, width
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.held: list[np.ndarray] = []
        self.size = 0
        self.doc_ids: list[int] = []
        self.counts: list[int] = []
        self.table: list[tuple[int, int, int]] = []

    def _frame(self, content: bytes) -> None:
        import xxhash

        packed = self.zstd.compress(content)
        self.sink.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.size:
            ids = np.concatenate(self.held).astype(f"<u{self.width}")
            for a in range(0, len(ids), MOST_FRAME_IDS):
                self._frame(ids[a : a + MOST_FRAME_IDS].tobytes())
            self.held, self.size = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NULL_ID if doc_id is None else doc_id)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= FRAME_IDS:
            self._flush()

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes written."""
        self._flush()
        head = struct.pack("<qq", self.width, len(self.doc_ids))
        self._frame(head + np.array(self.doc_ids, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes())
        body = b"".join(struct.pack("<III", *x) for x in self.table)
        body += struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        return len(self.doc_ids), sum(self.counts), sum(x[0] for x in self.table) + len(body) + 8


class ShardReader:
    """Random access to the documents of a token file."""

    def __init__(self, source) -> None:
        import zstandard

        self.source = source
        self.zstd = zstandard.ZstdDecompressor()
        source.seek(source.size() - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & WITH_CHECKSUMS:
            raise ValueError("not a token file")
        source.seek(source.size() - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        index = self.frame(n - 1)
        self.width, docs = struct.unpack("<qq", index[:16])
        self.doc_ids = np.frombuffer(index, "<i8", docs, 16)
        self.counts = np.frombuffer(index, "<i8", docs, 16 + 8 * docs)
        self.doc_at = np.concatenate([[0], np.cumsum(self.counts)])
        self.id_at = np.concatenate([[0], np.cumsum(self.table[:-1, 1] // self.width)])

    def frame(self, k: int) -> bytes:
        import xxhash

        self.source.seek(int(self.at[k]))
        content = self.zstd.decompress(self.source.read(int(self.table[k, 0])))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.table[k, 2] or len(content) != self.table[k, 1]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self, wanted: Iterable[int]) -> Iterator[np.ndarray]:
        """Ids of the documents at these places of the index, each frame read once if in order."""
        last, ids = -1, np.zeros(0, np.uint32)
        for d in wanted:
            a, b = int(self.doc_at[d]), int(self.doc_at[d + 1])
            parts = []
            while a < b:
                k = int(np.searchsorted(self.id_at, a, "right")) - 1
                if k != last:
                    last, ids = k, np.frombuffer(self.frame(k), f"<u{self.width}").astype(np.uint32)
                low = int(self.id_at[k])
                part = ids[a - low : b - low]
                parts.append(part)
                a += len(part)
            yield parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the manifest, one row per shard.

    A null text is empty and has the end id alone; a null doc_id comes first; rows that share an id
    are written each. A task writes one file under a name of its own and only what the manifest
    names counts, so lost or repeated attempts do no harm.
    """
    spark = docs.sparkSession
    size = text_rows(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    spec = definition(tokenizer_path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, writer, sink = tokenizer(spec), None, None
        shard, path = TaskContext.get().partitionId(), ""
        width = 2 if code.library.get_vocab_size() < 1 << 16 else 4
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files, top = _file_system(folder)
                files.create_dir(top, recursive=True)
                path = f"{top}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
                sink = files.open_output_stream(path)
                writer = ShardWriter(sink, width)
            end = np.array([END_ID], np.uint32)
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), code.encode(batch.column("text").to_pylist()), strict=True):
                writer.add(doc_id, np.concatenate([np.frombuffer(raw, np.uint32), end]))
        if writer is not None:
            n_docs, n_ids, n_bytes = writer.close()
            sink.close()
            name = f"{folder}/{path.rpartition('/')[2]}"
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [n_bytes]})

    ordered = (
        text_rows(docs)
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shards, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )
    return staged(ordered.mapInArrow(write, SHARDS), "token-shards")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of the files in the manifest.

    ``start`` counts the ids of all documents before it, over all shards.
    """
    # One row per shard.
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.withColumn("base", F.coalesce(before, F.lit(0)).cast("long")).select("path", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                files, place = _file_system(path)
                with files.open_input_file(place) as source:
                    shard = ShardReader(source)
                    step = 512
                    for a in range(0, len(shard.counts), step):
                        docs = range(a, min(a + step, len(shard.counts)))
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array([None if shard.doc_ids[d] == NULL_ID else int(shard.doc_ids[d]) for d in docs], pa.int64()),
                                "start": pa.array([base + int(shard.doc_at[d]) for d in docs], pa.int64()),
                                "n_tokens": pa.array([int(shard.counts[d]) for d in docs], pa.int64()),
                                "ids": pa.array([x.tobytes() for x in shard.documents(docs)], pa.binary()),
                            }
                        )

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(max(tasks, manifest.count())).mapInArrow(read, DOCUMENTS)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
