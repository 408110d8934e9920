"""Substring dedup on words with fixed-block anchors.

Each document's words are cut into non-overlapping reference blocks of half a window.  A
repeated window holds at least one whole reference block of the other document, so every
rolling window of block length probes the index of blocks (an exchange of fingerprints).  Of the hits
in a window the one with the smallest fingerprint is its anchor (see ``anchors``), the same in all copies.

Hits are then extended: each sends the words around it once, equal ones of a chunk as one.  Where
hits of one block meet, they are extended word by word, to the right and to the left, all at once: a step splits those
whose next words differ.  Hits that are together after ``l`` words to the left and the rest of a window to the
right hold the same window, and those are judged by the smallest document.  The union of such windows is that of
the maximal repeats of at least a window, and no pair of hits is ever made.

Fingerprints only choose hits; whether windows are equal is decided by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import NEVER, Anchors, level_bits, smaller_elsewhere, spans_of
from .common import (
    ENTRY_SCHEMA,
    Chunk,
    Grouped,
    answered,
    bucket_count,
    bucket_of,
    chunk_table,
    codes_of,
    entries,
    exchange,
    inside,
    release_shuffles,
    rows_of,
    staged,
    window_hashes,
    words_of,
)

WINDOW = 50
#: An English-like word and its blank, for the number of buckets only.
WORD_BYTES = 6
#: Hits that one bucket extends, if all could repeat.
BUCKET_HITS = 1 << 16

HIT_SCHEMA = "bucket long, chunk_id long, ids binary, low binary, high binary, words binary"
ANSWER_SCHEMA = "bucket long, chunk_id long, codes binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


class Windows:
    """Words of a chunk and its windows, worked out again in every pass instead of being stored."""

    def __init__(self, row: dict, window: int) -> None:
        self.chunk = chunk = Chunk(row)
        self.window, self.span = window, spans_of(window)
        self.block = window - self.span
        self.start, self.end, words, self.counts = words_of(chunk)
        self.n_words = len(words)
        long_enough = np.where(self.counts >= window, self.counts, 0)
        first = np.cumsum(self.counts) - self.counts
        _, self.probe_owner = inside(long_enough, self.block)
        fit = np.maximum(long_enough - self.block + 1, 0)
        inner = np.arange(fit.sum()) - np.repeat(np.cumsum(fit) - fit, fit)
        self.probe_at = inner + np.repeat(first, fit)
        self.aligned = inner % self.block == 0
        self.hashes = window_hashes(words, self.block)
        self.probes = Grouped(self.hashes[self.probe_at])

    def index_entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct block-length windows: documents that hold them here (1, or 2 for more), plus 4 if a reference block."""
        g = self.probes
        several = g.least(self.probe_owner) != g.most(self.probe_owner)
        return g.distinct, (1 + several + 4 * g.most(self.aligned)).astype(np.uint8)

    def hits(self, hit: np.ndarray, buckets: int) -> None:
        """The anchors among the hits, and the distinct words around them, in order of buckets."""
        values = np.full(len(self.hashes), NEVER)
        if len(hit):
            at = self.probe_at[hit[self.probes.group] > 0]
            values[at] = np.minimum((self.hashes[at] >> np.uint64(32)).astype(np.uint32), NEVER - np.uint32(1))
        valid = np.zeros(self.n_words, bool)
        valid[inside(self.counts, self.window)[0]] = True
        self.anchors = Anchors(values, valid, self.span)
        place, low, high = self.anchors.place, self.anchors.low, self.anchors.high
        self.ids = self.chunk.ids[np.searchsorted(np.cumsum(self.counts), place, "right")]
        text = self.chunk.text
        begin, end = self.start[place - high].tolist(), self.end[place + self.window - low - 1].tolist()
        number: dict[tuple, int] = {}
        self.group = np.array(
            [
                number.setdefault((b" ".join(text[a:b].split()), i, j), len(number))
                for a, b, i, j in zip(begin, end, low.tolist(), high.tolist(), strict=True)
            ],
            np.int64,
        )
        self.contexts = list(number)
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, self.group, self.ids)
        bucket = np.zeros(len(number), np.int64)
        bucket[self.group] = bucket_of(self.hashes[place], buckets).astype(np.int64)
        self.sent = np.argsort(bucket, kind="stable")
        self.bucket, self.least = bucket[self.sent], least

    def messages(self) -> Iterator[pa.RecordBatch]:
        """One row a bucket."""
        cut = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]])) if len(self.bucket) else []
        for a, b in zip(cut, [*cut[1:], len(self.bucket)], strict=True):
            mine = [self.contexts[k] for k in self.sent[a:b].tolist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(self.bucket[a : a + 1]),
                    "chunk_id": pa.array([self.chunk.chunk_id], pa.int64()),
                    "ids": pa.array([self.least[self.sent[a:b]].tobytes()], pa.binary()),
                    "low": pa.array([bytes(i for _, i, _ in mine)], pa.binary()),
                    "high": pa.array([bytes(j for *_, j in mine)], pa.binary()),
                    "words": pa.array([b"\n".join(x for x, *_ in mine)], pa.binary()),
                }
            )

    def removed(self, codes: np.ndarray) -> np.ndarray:
        """Words covered by a window that a smaller document also holds."""
        bits = np.zeros(len(self.sent), np.uint32)
        bits[self.sent] = codes
        all_levels = level_bits(self.anchors.low, self.anchors.high)
        bits = np.where(self.ids > self.least[self.group], all_levels, bits[self.group])
        return self.anchors.covered(bits, self.n_words, self.window)


def _anchored(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """1 where a window is a reference block somewhere and occurs in two documents or more."""
    holders = np.bincount(group, values & 3, n)
    index = np.zeros(n, bool)
    index[group[values >= 4]] = True
    return ((holders >= 2) & index)[group].astype(np.uint8)


def _extended(together: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hits that stay together when each is extended by one more word."""
    return np.unique(together.astype(np.int64) << 32 | (word + 1), return_inverse=True)[1]


def _extender(window: int):
    span = spans_of(window)

    def extend(table: pa.Table) -> pa.Table:
        ids, low, high = ([np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("ids", np.int64), ("low", np.uint8), ("high", np.uint8)))
        sizes = [len(x) for x in ids]
        values, low, high = np.concatenate(ids), np.concatenate(low).astype(np.int64), np.concatenate(high).astype(np.int64)
        right = np.full((len(values), window), -1, np.int32)
        left = np.full((len(values), span), -1, np.int32)
        number: dict[bytes, int] = {}
        k = 0
        for blob in table.column("words"):
            for context in blob.as_py().split(b"\n"):
                words = [number.setdefault(w, len(number)) for w in context.split(b" ")]
                at = int(high[k])
                right[k, : len(words) - at] = words[at:]
                left[k, :at] = words[:at][::-1]
                k += 1
        together = [np.zeros(len(values), np.int64)]
        for word in right.T:
            together.append(_extended(together[-1], word))
        before = [together[0]]
        for word in left.T:
            before.append(_extended(before[-1], word))
        bits = smaller_elsewhere(low, high, values, lambda level: (before[level], together[window - level]), span)
        ends = np.cumsum(sizes)
        codes = [bits[b - n : b].tobytes() for n, b in zip(sizes, ends, strict=True)]
        return pa.table({"bucket": table.column("bucket"), "chunk_id": table.column("chunk_id"), "codes": pa.array(codes, pa.binary())})

    return extend


def dedup_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for every row; kept words joined by one space.

    A word goes if a window of ``window`` words that covers it also starts in a document with a
    smaller doc_id; windows are judged on the input. A null or empty text has no words. Rows that
    share an id don't shorten each other; a null id is larger than all others. Empty tables give
    empty results; other columns are not read. A document stays whole in one task, which takes some 30 bytes of memory
    a byte of it, and the windows of its words once more for every 13 words that repeat.
    """
    spark = docs.sparkSession
    chunks = chunk_table(docs)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = bucket_count(total // WORD_BYTES)
    hit_buckets = max(16, total // (WORD_BYTES * 13 * BUCKET_HITS))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield from entries(row["chunk_id"], *Windows(row, window).index_entries(), buckets, bits=48)

    anchors = staged(exchange(chunks.mapInArrow(index, ENTRY_SCHEMA), "u1", _anchored, bits=48), "anchors")
    release_shuffles(spark)
    anchored = answered(chunks, anchors)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            w = Windows(row, window)
            w.hits(codes_of(row), hit_buckets)
            yield from w.messages()

    extended = anchored.mapInArrow(hits, HIT_SCHEMA).groupBy("bucket").applyInArrow(_extender(window), ANSWER_SCHEMA)
    extended = staged(extended.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "codes"))).alias("verdicts")), "verdicts")
    release_shuffles(spark)
    judged = answered(anchored, extended, "verdicts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            w = Windows(row, window)
            w.hits(codes_of(row), hit_buckets)
            chunk = w.chunk
            gone = w.removed(codes_of({"answers": row["verdicts"]}).view(np.uint32))
            per_doc = np.split(gone, np.cumsum(w.counts)[:-1])
            kept = []
            for a, b, g in zip(chunk.starts, chunk.ends, per_doc, strict=True):
                words = chunk.text[a:b].split()
                if g.any():
                    words = [x for x, out in zip(words, g, strict=True) if not out]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(chunk.out_ids(), pa.int64()),
                    "n_words": pa.array(w.counts),
                    "n_removed": pa.array([int(g.sum()) for g in per_doc], pa.int64()),
                    "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                }
            )

    return judged.mapInArrow(cut, RESULT)


def op6_block_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(doc_id, 9223372036854775807) AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
windows AS (
  SELECT rid, r, i, array_to_string(w[i : i + 49], ' ') AS g
  FROM (SELECT rid, r, w, unnest(range(1, len(w) - 48)) AS i FROM d)
),
bad AS (SELECT rid, i FROM (SELECT rid, r, i, min(r) OVER (PARTITION BY g) AS first FROM windows) WHERE r > first),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS i FROM bad),
words AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (
  SELECT rid, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN x END, ' ' ORDER BY words.i) AS t
  FROM words LEFT JOIN gone g USING (rid, i) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
