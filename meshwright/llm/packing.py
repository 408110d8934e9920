"""Packing documents into token sequences by first-fit decreasing.

Documents are dealt to random groups of about a thousand; each group is tokenised, cut
and packed by itself, so packing needs one shuffle and no task sees more than a group.
Inside a group a tournament tree over the bins' free room finds the first bin that fits
in logarithmic time.

Where rows have a position (the mix), groups are consecutive ranges of positions instead:
packing is random inside a range only, and sequences are numbered by range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows
from .tokens import END_ID, definition, tokenizer

CAPACITY = 4096
#: Documents, and bytes of text, of a packing group at most, on average.
GROUP_DOCS = 1024
GROUP_BYTES = 1 << 24

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class BinTree:
    """Tournament tree of free room: each inner node holds the larger of its children."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room for it; returns bin and offset from its end of room."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        left = room[node]
        room[node] = left - size
        bin_no = node - self.leaves
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return bin_no, left


def first_fit_decreasing(sizes: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Bin and offset of every item; items of equal size keep their order. Sizes are 1 to ``capacity``."""
    tree = BinTree(max(1, len(sizes)), capacity)
    placed = [(0, 0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        bin_no, left = tree.place(sizes[k])
        placed[k] = (bin_no, capacity - left)
    return placed


def _packer(text_definition: str, capacity: int, shuffled: bool = False):
    def pack(key, table):
        group = key[0].as_py()
        by = [table.column("tie").to_numpy(), table.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()]
        order = np.lexsort([*by, table.column("dealt").to_numpy()] if shuffled else by)
        doc_ids = table.column("doc_id").to_pylist()
        texts = table.column("text").to_pylist()
        end = np.array([END_ID], np.uint32).tobytes()
        rows: list[tuple] = []
        sizes: list[int] = []
        for k, raw in zip(order, tokenizer(text_definition).encode(texts[k] for k in order), strict=True):
            raw += end
            n = len(raw) // 4
            for start in range(0, n, capacity):
                length = min(capacity, n - start)
                rows.append((doc_ids[k], start, length, raw[4 * start : 4 * (start + length)], n))
                sizes.append(length)
        placed = first_fit_decreasing(sizes, capacity)
        if shuffled:  # else a range would begin with its longest documents
            number = np.random.default_rng(group).permutation(1 + max(b for b, _ in placed)).tolist()
            placed = [(number[b], o) for b, o in placed]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table(
            {
                "doc_id": pa.array(columns[0], pa.int64()),
                "start": pa.array(columns[1], pa.int64()),
                "length": pa.array(columns[2], pa.int64()),
                "ids": pa.array(columns[3], pa.binary()),
                "doc_tokens": pa.array(columns[4], pa.int64()),
                "sequence_id": pa.array([(group << 32) + b for b, _ in placed], pa.int64()),
                "offset": pa.array([o for _, o in placed], pa.int64()),
            }
        )

    return pack


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, position: str | None = None) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit) and places.

    A document's ids end with id 2; a null or empty text is that id alone. Documents longer than
    a sequence are cut at its multiples. Repeated rows are packed each; a null doc_id stays null; an
    empty table gives an empty result; other columns are not read.

    ``position`` names a column with the places of rows in an order, from 0. Then every ``group_docs`` places
    make a group, and a sequence of an earlier group has the smaller number.
    """
    if position:
        keyed = text_rows(docs, F.col(position).cast("long").alias("position")).withColumn("tie", F.xxhash64("text"))
        keyed = keyed.select(
            "doc_id", "text", "tie", F.xxhash64(F.lit("pack"), "doc_id", "tie").alias("dealt"), F.floor(F.col("position") / group_docs).alias("group")
        )
        return keyed.groupBy("group").applyInArrow(_packer(definition(tokenizer_path), capacity, True), PIECES)
    n, size = text_rows(docs).agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-n // group_docs), -(-(size or 0) // GROUP_BYTES))
    keyed = text_rows(docs).withColumn("tie", F.xxhash64("text"))
    keyed = keyed.withColumn("group", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(groups)))
    return keyed.groupBy("group").applyInArrow(_packer(definition(tokenizer_path), capacity), PIECES)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
