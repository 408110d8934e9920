"""Alignment of two tokenizers over one corpus.

Both encode the same bytes; the tokens of B form a static interval index (their starts and ends, sorted), and each token
of A is a stabbing query answered by bisection: the run of B tokens that its bytes overlap.  Places where both
sides end are spanned by no token: they cut the tokens into groups.

Texts are split at *safe boundaries*, single spaces at which both tokenizers begin anew, and each distinct stretch of a
block of documents is encoded and aligned once.  A block sends one row for each distinct pair of ids with
its number of links; the corpus-wide counts come back to the block the same way, so a pair that stands in every document
costs a row a block.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, TABLE_BUCKET_BYTES, shared_dir, staged, text_rows

#: Characters of text in a block, and documents, at most; a longer text is cut into several blocks.
BLOCK_CHARS = 1 << 22
BLOCK_DOCS = 1 << 13
#: Stretches that go to a library in one call.
CALL = 4096

_BOUNDARY = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_PROBES = ["word", "Words.", "a", "don't", "x7", "12", "(b)", "ñandú", "中文", "--", "\"q\"", "é"]
#: Byte-level vocabularies write a byte as itself if it is printable, else as the next character from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
_made: dict[bytes, "Pair"] = {}

BLOCKS = (
    "block_id long, uids binary, doc_ids binary, counts binary, shas binary, doc_units binary, units binary, unit_links binary, link_keys binary,"
    " keys array<long>, links array<long>"
)
PARTS = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pair:
    """Both tokenizers: A of the library tokenizers (byte-level), B of sentencepiece (which adds a space)."""

    def __init__(self, a: str, b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.no_truncation()
        self.a.no_padding()
        # Spellings of special tokens are plain text.
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        size = max(self.a.get_vocab(True).values(), default=-1) + 1
        entries = [self.a.id_to_token(k) or "" for k in range(size)]
        self.bytes_a = [bytes(_BYTE_OF[x] for x in e) if all(x in _BYTE_OF for x in e) else e.encode() for e in entries]
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        ends = [(len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")]
        self.written = [f"{k}{mark}".encode() for n, marks in ends for mark in marks for k in range(n)]
        self.cuts = all(self._ids(f"{x} {y}") == [p + q for p, q in zip(self._ids(x), self._ids(y), strict=True)] for x in _PROBES for y in _PROBES)

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        one = _BYTE_PIECE.fullmatch(piece) if self.b.is_byte(k) else None
        return bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode()

    def _ids(self, text: str) -> list[list[int]]:
        return [self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)]

    def stretches(self, text: str) -> list[str]:
        """``text`` without the spaces between its stretches; each is encoded after a space."""
        return _BOUNDARY.split(text) if self.cuts else [text]

    def segments(self, text: str, size: int) -> Iterator[str]:
        """``text`` in segments of about ``size`` characters, without the spaces between them."""
        at = 0
        while self.cuts and len(text) - at > size:
            found = _BOUNDARY.search(text, at + size)
            if not found:
                break
            yield text[at : found.start()]
            at = found.end()
        yield text[at:]

    def encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and ids per stretch, of A and of B."""
        ids, counts = (array("i"), array("i")), (array("q"), array("q"))
        for k in range(0, len(units), CALL):
            part = units[k : k + CALL]
            for side, found in enumerate(([x.ids for x in self.a.encode_batch_fast([f" {u}" for u in part], add_special_tokens=False)], self.b.encode(part, num_threads=1))):
                for x in found:
                    ids[side].extend(x)
                    counts[side].append(len(x))
        return (*(np.frombuffer(x, np.int32) for x in ids), *(np.frombuffer(x, np.int64) for x in counts))


class Units:
    """Distinct stretches, aligned: counts per stretch, written groups, and links as id pairs."""

    def __init__(self, pair: Pair, units: list[str]) -> None:
        n = len(units)
        a, b, count_a, count_b = pair.encoded(units)
        wanted = [f" {u}".encode() for u in units]
        size = np.array([len(x) for x in wanted], np.int64)
        of_a, of_b = np.repeat(np.arange(n), count_a), np.repeat(np.arange(n), count_b)
        sums = [np.bincount(of, table[ids], n).astype(np.int64) for of, table, ids in ((of_a, pair.len_a, a), (of_b, pair.len_b, b))]
        self.ok = (sums[0] == size) & (sums[1] == size)
        for ids, of, table in ((a, of_a, pair.bytes_a), (b, of_b, pair.bytes_b)):
            if b"".join([table[k] for k in ids[self.ok[of]].tolist()]) != b"".join([w for w, ok in zip(wanted, self.ok.tolist(), strict=True) if ok]):
                ends = np.searchsorted(of, np.arange(n + 1))
                for u in np.flatnonzero(self.ok).tolist():
                    self.ok[u] = b"".join(table[k] for k in ids[ends[u] : ends[u + 1]].tolist()) == wanted[u]
        fine_a, fine_b = self.ok[of_a], self.ok[of_b]
        a, b, of_a, of_b = a[fine_a].astype(np.int64), b[fine_b].astype(np.int64), of_a[fine_a], of_b[fine_b]
        self.n_a, self.n_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)

        # All stretches stand one after the other, so that one index serves them all.
        end_a, end_b = np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b])
        start_a, start_b = end_a - pair.len_a[a], end_b - pair.len_b[b]
        first, last = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        held = last - first
        link_a = np.repeat(np.arange(len(a)), held)
        link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(first, held)
        self.keys = a[link_a] << 32 | b[link_b]
        self.of_link = of_a[link_a]
        self.n_links = np.bincount(self.of_link, minlength=n)

        # A place where both end is spanned by no token.
        gaps = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(gaps, end_a), np.searchsorted(gaps, end_b)
        closes_a, closes_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
        self.n_groups = np.bincount(of_b[closes_b], minlength=n)
        names = np.concatenate([a + closes_a * len(pair.len_a), 2 * len(pair.len_a) + b + closes_b * len(pair.len_b)])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        text = [pair.written[k] for k in names[order].tolist()]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        self.groups = [b"".join(text[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


def pair_of(a: str, b: bytes) -> Pair:
    key = hashlib.sha256(a.encode() + b).digest()
    if key not in _made:
        _made.clear()
        _made[key] = Pair(a, b)
    return _made[key]


class Block:
    """Documents, or one segment of a long one, whose distinct stretches are aligned together."""

    def __init__(self, pair: Pair) -> None:
        self.pair = pair
        self.number: dict[str, int] = {}
        self.units = array("i")
        self.docs: list[tuple[int, int]] = []
        self.sizes: list[int] = []

    def add(self, uid: int, doc_id: int | None, text: str) -> None:
        number, before = self.number, len(self.units)
        if text:
            self.units.extend([number.setdefault(u, len(number)) for u in self.pair.stretches(text)])
        self.docs.append((uid, NULL_ID if doc_id is None else doc_id))
        self.sizes.append(len(self.units) - before)

    def row(self, block_id: int, hasher=None, last: bool = True) -> pa.RecordBatch:
        """The block's row. ``hasher`` goes on from segment to segment of one text and is read at the last."""
        found = Units(self.pair, list(self.number))
        units, sizes = np.frombuffer(self.units, np.int32), np.array(self.sizes, np.int64)
        of = np.repeat(np.arange(len(sizes)), sizes)
        ok = np.bincount(of, ~found.ok[units], len(sizes)) == 0
        sizes = np.where(ok, sizes, 0)
        units, of = units[ok[of]], of[ok[of]]
        counts = np.stack([np.bincount(of, x[units], len(sizes)).astype(np.int64) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)])
        shas, at, names, listed = [], 0, found.groups, units.tolist()
        for n in sizes.tolist():
            text = b"".join([names[k] for k in listed[at : at + n]])
            at += n
            if hasher is not None:
                hasher.update(text if not last else text[:-1])
                shas.append(hasher.digest() if last else bytes(32))
            else:
                shas.append(hashlib.sha256(text[:-1]).digest() if n else bytes(32))
        # Links of stretches that stand in documents with tokens.
        weight = np.bincount(units, minlength=len(found.ok))
        used = weight[found.of_link] > 0
        keys, inverse = np.unique(found.keys[used], return_inverse=True)
        links = np.bincount(inverse, weight[found.of_link[used]], len(keys)).astype(np.int64)
        n_links = np.where(weight > 0, found.n_links, 0)
        blobs = {
            "uids": np.array([d[0] for d in self.docs], np.int64),
            "doc_ids": np.array([d[1] for d in self.docs], np.int64),
            "counts": counts,
            "shas": b"".join(shas),
            "doc_units": sizes,
            "units": units.astype(np.int32),
            "unit_links": n_links.astype(np.int32),
            "link_keys": inverse.astype(np.int32),
        }
        columns = {k: pa.array([v if isinstance(v, bytes) else v.tobytes()], pa.binary()) for k, v in blobs.items()}
        lists = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.int64())) for k, v in (("keys", keys), ("links", links))}
        return pa.RecordBatch.from_pydict({"block_id": pa.array([block_id], pa.int64())} | columns | lists)


def _aligner(a: str, b: bytes, block_chars: int):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, base, seq, uid, size = pair_of(a, b), TaskContext.get().partitionId(), 0, 0, 0
        block = Block(pair)

        def number() -> int:
            nonlocal seq
            seq += 1
            return (base << 28) + seq

        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, text = batch.column("doc_id")[k].as_py(), batch.column("text")[k].as_py()
                uid += 1
                row = (base << 36) + uid
                if len(text) <= block_chars:
                    block.add(row, doc_id, text)
                    size += len(text)
                    if size >= block_chars or len(block.docs) >= BLOCK_DOCS:
                        yield block.row(number())
                        block, size = Block(pair), 0
                    continue
                # A long text has tokens only if all of its segments have.
                fine = all(Units(pair, list(dict.fromkeys(pair.stretches(s)))).ok.all() for s in pair.segments(text, block_chars))
                if not fine:
                    block.add(row, doc_id, "")
                    continue
                hasher, before = hashlib.sha256(), None
                for segment in pair.segments(text, block_chars):
                    if before is not None:
                        yield before.row(number(), hasher, False)
                    before = Block(pair)
                    before.add(row, doc_id, segment)
                yield before.row(number(), hasher, True)
        if block.docs:
            yield block.row(number())

    return align


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block's documents, or of their segments, from the corpus-wide counts of its pairs."""
    for batch in batches:
        for k in range(batch.num_rows):
            blob = lambda name, kind: np.frombuffer(batch.column(name)[k].as_py(), kind)  # noqa: B023, E731
            known = batch.column("answers")[k].values
            keys, value = (known.field(j).to_numpy() for j in range(2)) if known is not None and len(known) else (np.zeros(0, np.int64),) * 2
            order = np.argsort(keys)
            value = value[order]
            total, best = np.abs(value), value < 0
            links, n_links, sizes, units = blob("link_keys", np.int32), blob("unit_links", np.int32), blob("doc_units", np.int64), blob("units", np.int32)
            of_unit = np.repeat(np.arange(len(n_links)), n_links)
            of_doc = np.repeat(np.arange(len(sizes)), sizes)
            sums = []
            for x in (best, total):
                each = np.zeros(len(n_links), np.int64)
                np.add.at(each, of_unit, x[links].astype(np.int64))
                doc = np.zeros(len(sizes), np.int64)
                np.add.at(doc, of_doc, each[units])
                sums.append(doc)
            uids, ids, shas = blob("uids", np.int64), blob("doc_ids", np.int64), batch.column("shas")[k].as_py()
            n_a, n_b, n_groups, n_links = blob("counts", np.int64).reshape(4, -1)
            named = [shas[32 * j : 32 * j + 32] for j in range(len(ids))]
            yield pa.RecordBatch.from_pydict(
                {
                    "uid": pa.array(uids),
                    "doc_id": pa.array(ids, mask=ids == NULL_ID),
                    "n_a": pa.array(n_a),
                    "n_b": pa.array(n_b),
                    "n_groups": pa.array(n_groups),
                    "n_links": pa.array(n_links),
                    "n_best": pa.array(sums[0]),
                    "count_sum": pa.array(sums[1]),
                    "groups_sha256": pa.array([x.hex() if any(x) else "" for x in named]),
                }
            )


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The corpus as blocks of aligned documents (``BLOCKS``), written once in buckets of ``block_id``."""
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        a, b = f.read(), g.read()
    rows = text_rows(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TABLE_BUCKET_BYTES))
    name = f"blocks_{uuid.uuid4().hex}"
    made = rows.mapInArrow(_aligner(a, b, block_chars), BLOCKS)
    made.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "block_id").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``block_id, key, total``: every block's pairs (A id in the upper, B id in the lower half) with their links corpus-wide."""
    sent = blocks.select("block_id", F.explode(F.arrays_zip("keys", "links")).alias("x")).select("block_id", "x.keys", "x.links")
    # A pair has one row a block at most.
    total = F.sum("links").over(Window.partitionBy("keys"))
    return staged(sent.select("block_id", F.col("keys").alias("key"), total.alias("total")), "pair-counts")


def align(docs: DataFrame, a_path: str, b_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``) the figures of its alignment: ``PARTS`` without ``uid``.

    ``n_a, n_b`` tokens, ``n_groups``, ``n_links`` (pairs of overlapping tokens), ``n_best`` (links whose count is the highest of their B
    id), ``count_sum`` and ``groups_sha256`` over the ids of the groups. A null or empty text, or one that a tokenizer doesn't give back byte by
    byte, has no tokens: zeros and no hash, and it counts for no pair. A null doc_id stays null; repeated rows have a row each and count
    each; an empty table gives an empty result; other columns aren't read. Whole texts count: those over ``block_chars``
    in segments cut at safe boundaries, with one hash over them all; a text without a boundary is one segment.
    """
    blocks = aligned_blocks(docs, a_path, b_path, block_chars)
    counts = pair_counts(blocks).withColumn("b", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)))
    # One row an id of B's vocabulary, a bound that no corpus moves.
    best = F.broadcast(counts.groupBy("b").agg(F.max("total").alias("most")))
    value = F.when(F.col("total") == F.col("most"), -F.col("total")).otherwise(F.col("total"))
    answers = counts.join(best, "b").groupBy("block_id").agg(F.collect_list(F.struct("key", value.alias("value"))).alias("answers"))
    whole = blocks.drop("keys", "links").join(answers.hint("shuffle_hash"), "block_id", "left")
    parts = whole.mapInArrow(_answer, PARTS)
    sums = [F.sum(k).alias(k) for k in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    # Segments of one text meet; all others pass.
    return parts.groupBy("uid").agg(F.min("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256")).drop("uid")


def pair_table(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``a, b, links, best``: all linked id pairs with their number of links corpus-wide, and whether no pair of this B id has more."""
    counts = pair_counts(aligned_blocks(docs, a_path, b_path)).groupBy("key").agg(F.max("total").alias("links"))
    counts = counts.select(F.shiftright("key", 32).alias("a"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "links")
    best = F.broadcast(counts.groupBy("b").agg(F.max("links").alias("most")))
    return counts.join(best, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
