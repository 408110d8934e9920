"""Byte-level substring dedup by a distributed merge sort of suffixes.

Which bytes go is decided for every 50-byte string of every document:

1. Whole texts that repeat are set aside: all but the smallest document are covered.
2. A string's anchor is a place inside it that its content alone decides (see ``anchors``).  One
   exchange tells which anchors another document may also hold; strings of other anchors are unique.
3. The suffixes that start at the remaining anchors are sorted in each chunk, by the bytes of the strings
   from the anchor on and then by those before it; equal ones become one.  Sorted runs are cut by
   leading bytes at sampled splitters and exchanged front-coded: only the bytes beyond the prefix
   shared with the suffix before.  No byte is replaced by a hash.
4. Each bucket merges its runs with a loser tree that keeps, for every run, the length of the
   prefix shared with the last winner, and so never compares a known prefix again.  The merged order
   and its shared prefixes tell which strings are equal: those that share the bytes from the anchor on,
   and, from a second sort, those before it.

Fingerprints (48 bits of a fixed hash) only choose in step 2; a collision there sends more, and never decides.
Equal whole texts are told by their SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Anchors, level_bits, smaller_elsewhere, spans_of
from .common import (
    ENTRY_SCHEMA,
    SIGN_BYTES,
    Chunk,
    Grouped,
    answered,
    bucket_count,
    byte_values,
    chunk_table,
    codes_of,
    entries,
    exchange,
    release_shuffles,
    rows_of,
    spread_join,
    staged,
    window_hashes,
)

LENGTH = 50
#: Bytes from one anchor to the next, on average.
ANCHOR_STEP = 13
#: Suffixes of one bucket, if all could repeat.
BUCKET_SUFFIXES = 1 << 18
#: Leading bytes sampled from each chunk for the splitters.
SAMPLES = 128

RUN_SCHEMA = "bucket long, chunk_id long, shared binary, tails binary, payload binary"
ANSWER_SCHEMA = "bucket long, chunk_id long, codes binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


class Strings:
    """Anchors of all strings of a chunk; worked out anew in every pass instead of being stored."""

    def __init__(self, row: dict, length: int) -> None:
        self.chunk, self.length, self.span = Chunk(row), length, spans_of(length)
        self.gram = length - self.span
        chunk = self.chunk
        self.alive = np.ones(len(chunk.ids), bool)
        self.alive[row["copies"] or []] = False
        size = len(chunk.text)
        valid = np.zeros(size, bool)
        for a, b, alive in zip(chunk.starts.tolist(), chunk.ends.tolist(), self.alive.tolist(), strict=True):
            if alive and b - a >= length:
                valid[a : b - length + 1] = True
        self.hashes = window_hashes(byte_values(chunk.text), self.gram)
        self.anchors = Anchors((self.hashes >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE), valid, self.span)
        self.grams = Grouped(self.hashes[self.anchors.place])

    def owner(self) -> np.ndarray:
        return np.searchsorted(self.chunk.ends, self.anchors.place, "right")

    def anchor_entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and how many documents hold them here (1, or 2 for more)."""
        owner = self.owner()
        return self.grams.distinct, (1 + (self.grams.least(owner) != self.grams.most(owner))).astype(np.uint8)

    def suffixes(self, hit: np.ndarray, splitters: np.ndarray) -> None:
        """The distinct sorted suffixes of anchors that are hit, with the bucket of each and its smallest document."""
        self.anchors.pick(hit[self.grams.group] > 0 if len(hit) else np.zeros(len(self.anchors.place), bool))
        place, low, high = self.anchors.place, self.anchors.low, self.anchors.high
        text = np.zeros(len(self.chunk.text) + self.span + self.length, np.uint8)
        text[self.span : self.span + len(self.chunk.text)] = np.frombuffer(self.chunk.text, np.uint8)
        key = np.empty((len(place), self.length + self.span + 2), np.uint8)
        if len(place):
            key[:, : self.length] = np.lib.stride_tricks.sliding_window_view(text, self.length)[place + self.span]
            key[:, self.length : -2] = np.lib.stride_tricks.sliding_window_view(text, max(1, self.span))[place][:, : self.span][:, ::-1]
            # Bytes outside all strings of the anchor are left out.
            key[:, : self.length][np.arange(self.length) >= (self.length - low)[:, None]] = 0
            key[:, self.length : -2][np.arange(self.span) >= high[:, None]] = 0
        key[:, -2], key[:, -1] = low + 1, high + 1
        self.ids = self.chunk.ids[self.owner()]
        self.same = Grouped(key.view(f"S{key.shape[1]}").ravel())
        one = self.same.order[self.same.first]
        key = key[one]
        lead = leads(key)
        first, last = np.searchsorted(splitters, lead, "left"), np.searchsorted(splitters, lead, "right")
        # A lead that fills several ranges is dealt among them by its whole gram.
        bucket = first + self.hashes[place[one]].astype(np.uint64) % (last - first + 1).astype(np.uint64)
        self.sent = np.argsort(bucket, kind="stable")
        self.key, self.bucket, self.least = key[self.sent], bucket[self.sent].astype(np.int64), self.same.least(self.ids)[self.sent]

    def runs(self) -> Iterator[pa.RecordBatch]:
        """Sorted runs, one a bucket, front-coded."""
        key, bucket = self.key, self.bucket
        if not len(key):
            return
        width = key.shape[1]
        shared = np.zeros(len(key), np.uint8)
        same = key[1:] == key[:-1]
        shared[1:] = np.where(same.all(1), width, same.argmin(1))
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        shared[cut] = 0
        tails = key[np.arange(width) >= shared[:, None]]
        tail_at = np.concatenate([[0], np.cumsum(width - shared.astype(np.int64))])
        spans = list(zip(cut.tolist(), np.append(cut[1:], len(key)).tolist(), strict=True))
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(bucket[cut]),
                "chunk_id": pa.array(np.full(len(cut), self.chunk.chunk_id, np.int64)),
                "shared": pa.array([shared[a:b].tobytes() for a, b in spans], pa.binary()),
                "tails": pa.array([tails[tail_at[a] : tail_at[b]].tobytes() for a, b in spans], pa.binary()),
                "payload": pa.array([self.least[a:b].tobytes() for a, b in spans], pa.binary()),
            }
        )

    def covered(self, codes: np.ndarray) -> np.ndarray:
        """Bytes of the chunk under a string that a smaller document also holds."""
        bits = np.zeros(len(self.sent), np.uint32)
        least = np.empty(len(self.sent), np.int64)
        bits[self.sent], least[self.sent] = codes, self.least
        group, anchors = self.same.group, self.anchors
        all_levels = level_bits(anchors.low, anchors.high)
        gone = anchors.covered(np.where(self.ids > least[group], all_levels, bits[group]), len(self.chunk.text), self.length)
        for d in np.flatnonzero(~self.alive):
            if self.chunk.ends[d] - self.chunk.starts[d] >= self.length:
                gone[self.chunk.starts[d] : self.chunk.ends[d]] = True
        return gone


def leads(key: np.ndarray) -> np.ndarray:
    """First eight bytes of each suffix as a number."""
    first = np.zeros((len(key), 8), np.uint8)
    first[:, : min(8, key.shape[1])] = key[:, :8]
    return first.view(">u8").ravel().astype(np.uint64)


# ---------------------------------------------------------------- merging


def merge_runs(runs: list[tuple[bytes, bytes]], width: int) -> tuple[list[int], list[int], list[bytes]]:
    """Merge sorted front-coded runs: run of every suffix in merged order, prefix shared with the one before, and bytes.

    A loser tree over the runs. ``known[r]`` is the length of the prefix that the current
    suffix of run r shares with the last winner: the longer one is the smaller suffix without
    a look at its bytes, and only equal lengths are compared, from there on.
    """
    k = len(runs)
    size = 1 << (k - 1).bit_length()
    end = b"\xff" * (width + 1)  # after every suffix
    shared = [r[0] for r in runs] + [b""] * (size - k)
    tails = [r[1] for r in runs] + [b""] * (size - k)
    lengths = [len(s) for s in shared]
    keys = [t[:width] if n else end for t, n in zip(tails, lengths, strict=True)]
    tail = [len(x) if x is not end else 0 for x in keys]
    at, known = [0] * size, [0] * size

    # First tournament: all prefixes are unknown.
    losers, winners = [0] * size, [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        if keys[b] < keys[a]:
            a, b = b, a
        winners[node], losers[node] = a, b
        n, x, y = 0, keys[a], keys[b]
        while n < width and x[n] == y[n]:
            n += 1
        known[b] = -1 if y is end else n
    top, mine = winners[1], 0
    from_run: list[int] = []
    lcp: list[int] = []
    merged: list[bytes] = []
    while keys[top] is not end:
        key = keys[top]
        from_run.append(top)
        lcp.append(mine)
        merged.append(key)
        i = at[top] + 1
        at[top] = i
        if i < lengths[top]:
            mine = shared[top][i]
            t = tail[top]
            tail[top] = t + width - mine
            keys[top] = key[:mine] + tails[top][t : t + width - mine]
        else:
            keys[top], mine = end, -1
        # Replay from this run's leaf.
        node = (size + top) >> 1
        while node:
            other = losers[node]
            theirs = known[other]
            if theirs > mine:
                losers[node], known[top] = top, mine
                top, mine = other, theirs
            elif theirs == mine and mine >= 0:
                a, b, n = keys[top], keys[other], mine
                while n < width and a[n] == b[n]:
                    n += 1
                if n == width or a[n] < b[n]:
                    known[other] = n
                else:
                    losers[node], known[top] = top, n
                    top = other
            node >>= 1
    return from_run, lcp, merged


def _shared(ranked: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before."""
    shared = np.zeros(len(ranked), np.int64)
    same = ranked[1:] == ranked[:-1]
    shared[1:] = np.where(same.all(1), ranked.shape[1], same.argmin(1)) if ranked.shape[1] else 0
    return shared


def _merger(length: int):
    span = spans_of(length)
    width = length + span + 2

    def merge(table: pa.Table) -> pa.Table:
        runs = list(zip(*[table.column(c).to_pylist() for c in ("shared", "tails")], strict=True))
        ids = [np.frombuffer(x, np.int64) for x in table.column("payload").to_pylist()]
        from_run, lcp, merged = merge_runs(runs, width)
        key = np.frombuffer(b"".join(merged), np.uint8).reshape(-1, width)
        del merged
        run, right = np.array(from_run, np.int64), np.array(lcp, np.int64)
        # Places in run order: the runs one after the other.
        place = np.argsort(run, kind="stable")
        values = np.empty(len(run), np.int64)
        values[place] = np.concatenate(ids)
        before = np.ascontiguousarray(key[:, length : length + span])
        order = np.argsort(before.view(f"S{span}").ravel(), kind="stable") if span else np.arange(len(key))
        left = _shared(before[order])

        def classes(level: int) -> tuple[np.ndarray, np.ndarray]:
            mine = np.empty(len(key), np.int64)
            mine[order] = np.cumsum(left < level)
            return mine, np.cumsum(right < length - level)

        bits = smaller_elsewhere(key[:, -2].astype(np.int64) - 1, key[:, -1].astype(np.int64) - 1, values, classes, span)[place]
        ends = np.cumsum([len(x) for x in ids])
        codes = [bits[b - len(x) : b].tobytes() for x, b in zip(ids, ends, strict=True)]
        return pa.table({"bucket": table.column("bucket"), "chunk_id": table.column("chunk_id"), "codes": pa.array(codes, pa.binary())})

    return merge


def _held(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """1 where two documents or more hold the anchor."""
    return (np.bincount(group, values, n) >= 2)[group].astype(np.uint8)


def whole_copies(chunks: DataFrame) -> DataFrame:
    """``chunk_id, copies``: places of the documents whose whole text a smaller document also has."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            n = len(row["signs"]) // SIGN_BYTES
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk_id": pa.array(np.full(n, row["chunk_id"], np.int64)),
                    "place": pa.array(np.arange(n, dtype=np.int32)),
                    "doc_id": pa.array(np.frombuffer(row["doc_ids"], np.int64)),
                    "sign": pa.array([row["signs"][SIGN_BYTES * k : SIGN_BYTES * (k + 1)] for k in range(n)], pa.binary()),
                }
            )

    signed = staged(chunks.select("chunk_id", "doc_ids", "signs").mapInArrow(signs, "chunk_id long, place int, doc_id long, sign binary"), "signs")
    firsts = signed.groupBy("sign").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    copies = spread_join(signed, firsts, "sign", "chunk_id").filter(F.col("doc_id") > F.col("first"))
    # At most as many as a chunk has documents.
    return staged(copies.groupBy("chunk_id").agg(F.collect_list("place").alias("copies")), "copies")


def splitters_of(chunks: DataFrame, buckets: int) -> np.ndarray:
    """Leading bytes that cut suffixes into even ranges, from ``SAMPLES`` places of every chunk."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            text = np.frombuffer(row["text"], np.uint8)
            found = np.zeros(0, np.int64)
            if len(text) >= 8:
                at = np.linspace(0, len(text) - 8, SAMPLES).astype(np.int64)
                found = (leads(np.lib.stride_tricks.sliding_window_view(text, 8)[at]) ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_pydict({"lead": pa.array(found)})

    cuts = chunks.select("text").mapInArrow(sample, "lead long").agg(F.percentile_approx("lead", [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0]
    # Eight bytes for every bucket come to the driver and go to the tasks.
    return np.sort(np.array(cuts or [], np.int64).view(np.uint64) ^ np.uint64(1 << 63))


def dedup_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes left) for every row.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a
    smaller doc_id; strings never cross documents and are judged on the input. A null text has no bytes.
    Rows that share an id don't shorten each other; a null id is larger than all others. Empty
    tables give empty results; other columns are not read. What is left may cut a character in two.
    A document stays whole in one task, which takes some 40 bytes of memory a byte of it, and up to 15 more where all of it repeats.
    """
    spark = docs.sparkSession
    chunks = chunk_table(docs)
    copies = whole_copies(chunks)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    anchor_buckets = bucket_count(total // ANCHOR_STEP)
    splitters = splitters_of(chunks, max(16, total // (ANCHOR_STEP * BUCKET_SUFFIXES)))
    marked = chunks.join(copies.hint("shuffle_hash"), "chunk_id", "left")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield from entries(row["chunk_id"], *Strings(row, length).anchor_entries(), anchor_buckets, bits=48)

    anchors = staged(exchange(marked.mapInArrow(index, ENTRY_SCHEMA), "u1", _held, bits=48), "anchors")
    release_shuffles(spark)
    anchored = answered(marked, anchors)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            s = Strings(row, length)
            s.suffixes(codes_of(row), splitters)
            yield from s.runs()

    merged = anchored.mapInArrow(suffixes, RUN_SCHEMA).groupBy("bucket").applyInArrow(_merger(length), ANSWER_SCHEMA)
    merged = staged(merged.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "codes"))).alias("merged")), "merged")
    release_shuffles(spark)
    judged = answered(anchored, merged, "merged")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            s = Strings(row, length)
            s.suffixes(codes_of(row), splitters)
            chunk = s.chunk
            gone = s.covered(codes_of({"answers": row["merged"]}).view(np.uint32))
            removed, spans, kept = [], [], []
            raw = np.frombuffer(chunk.text, np.uint8)
            for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
                g = gone[a:b]
                n = int(np.count_nonzero(g))
                removed.append(n)
                spans.append(int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if n else 0)
                kept.append(raw[a:b][~g].tobytes() if n else chunk.text[a:b])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(chunk.out_ids(), pa.int64()),
                    "n_bytes": pa.array(chunk.ends - chunk.starts),
                    "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(spans, pa.int64()),
                    "kept": pa.array(kept, pa.binary()),
                }
            )

    return judged.mapInArrow(cut, RESULT)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
