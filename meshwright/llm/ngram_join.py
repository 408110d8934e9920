"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are documents, columns are distinct word n-grams.  Two
documents link when their overlap - their entry in the product of the matrix with its
transpose - reaches the share of their union that the threshold asks for.

1. Column counts (one exchange): documents that share too few n-grams with anything else
   can't link and leave; so do columns of one row.
2. Rows that are equal become one, with the others as its members.
3. Columns of a row are put in order of rarity; two linked rows share a column among the
   first few of each (the bound follows from the row's size), so only these are matched.
4. First every row meets a few others that it shares such a column with, in rounds with others each, which joins near copies into
   components without all their pairs; only labels of components outlive a round.
5. Rows of *different* components that share a column are then multiplied, in blocks of rows where many hold it: overlaps are
   accumulated over blocks of columns, and pairs below the bound that their sizes ask for are discarded. No link is lost.

N-grams are told apart by 64-bit fingerprints: two that differ are taken for one with odds of 2^-64 a pair, and only where both
are compared, within two documents; then an overlap is one too large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    ENTRY_SCHEMA,
    NULL_ID,
    SIGN_BYTES,
    Chunk,
    Grouped,
    answered,
    bucket_count,
    chunk_table,
    codes_of,
    discard,
    entries,
    exchange,
    release_shuffles,
    rows_of,
    spread_join,
    staged,
    window_hashes,
    words_of,
)
from .components import components

WORDS = 5
#: Links need 100 * overlap >= PERCENT * union.
PERCENT = 80

#: A column of more rows isn't paired row by row but multiplied in blocks of so many rows, or so many entries.
PAIRED_ROWS = 64
BLOCK_ROWS = 512
BLOCK_GRAMS = 1 << 17

ROWS = "row long, doc_id long, n long, grams binary, rarity binary"
EDGES = "a long, b long, overlap long, label_a long, label_b long"


class Incidence:
    """Distinct n-grams of each document of a chunk, in document order and then by fingerprint."""

    def __init__(self, chunk: Chunk, width: int) -> None:
        _, _, words, counts = words_of(chunk, lower=True)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        grams, owners = [], []
        for k in range(1, width + 1):
            # Documents of fewer words than an n-gram are one n-gram of all their words.
            here = counts >= width if k == width else counts == k
            fit = np.where(here, counts - k + 1, 0)
            at = np.arange(fit.sum()) - np.repeat(np.cumsum(fit) - fit, fit) + np.repeat(first, fit)
            if len(at):
                grams.append(window_hashes(words, k)[at])
                owners.append(np.repeat(np.arange(len(counts)), fit))
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        d = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        order = order[np.argsort(d[order].astype(np.int32), kind="stable")]
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        self.grams, self.owners = h[new], d[new]
        self.sizes = np.bincount(self.owners, minlength=len(counts))
        self.columns = Grouped(self.grams)

    def column_entries(self) -> tuple[np.ndarray, np.ndarray]:
        g = self.columns
        return g.distinct, np.diff(np.append(g.first, len(g.group))).astype(np.uint16)


def _rarity(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """0 for a column of one row, else a step that grows with the logarithm of its rows."""
    rows = np.bincount(group, values, n)
    step = np.minimum(255, np.floor(8 * np.log2(np.maximum(rows, 1))))
    return step.astype(np.uint8)[group]


def links(overlap, a, b, percent: int = PERCENT):
    """Whether 100 * overlap >= percent * union, for sizes a and b."""
    return 100 * overlap >= percent * (a + b - overlap)


def block_product(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Overlaps of the wanted (left, right) pairs of two blocks of rows; -1 where a bound rules the pair out.

    Rows are sorted fingerprints. A right row is matched with all its left rows at once; the first half
    of its columns decides which pairs can still reach their bound, and only those see the rest.
    """
    found = np.full(len(pairs), -1, np.int64)
    order = np.argsort(pairs[:, 1], kind="stable")
    cuts = np.flatnonzero(np.diff(pairs[order, 1])) + 1
    for mine in np.split(order, cuts):
        if not len(mine):
            continue
        b = right[pairs[mine[0], 1]]
        rows = [left[k] for k in pairs[mine, 0]]
        sizes = np.array([len(r) for r in rows])
        need = -(-percent * (sizes + len(b)) // (100 + percent))
        half = b[len(b) // 2] if len(b) > 1 else np.uint64(0)
        count = np.zeros(len(mine), np.int64)
        live = np.minimum(sizes, len(b)) >= need
        for low_part in (True, False):
            columns = b[b < half] if low_part else b[b >= half]
            parts, owner = [], []
            for j in np.flatnonzero(live):
                cut = int(np.searchsorted(rows[j], half))
                part = rows[j][:cut] if low_part else rows[j][cut:]
                parts.append(part)
                owner.append(np.full(len(part), j))
            if parts and len(columns):
                values, owners = np.concatenate(parts), np.concatenate(owner)
                at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
                count += np.bincount(owners[columns[at] == values], minlength=len(mine))
            if low_part:
                rest = np.array([len(r) - int(np.searchsorted(r, half)) for r in rows])
                live &= count + np.minimum(rest, int((b >= half).sum())) >= need
        found[mine] = np.where(live, count, -1)
    return found


def _overlaps(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        left = [np.frombuffer(x, np.uint64) for x in batch.column("grams_a").to_pylist()]
        right: dict[int, int] = {}
        blobs, place = [], []
        for k, (key, x) in enumerate(zip(b.tolist(), batch.column("grams_b"), strict=True)):
            if key not in right:
                right[key] = len(blobs)
                blobs.append(np.frombuffer(x.as_py(), np.uint64))
            place.append(right[key])
        pairs = np.stack([np.arange(len(a)), np.array(place, np.int64)], 1) if len(a) else np.zeros((0, 2), np.int64)
        got = block_product(left, blobs, pairs, percent)
        sizes_a, sizes_b = np.array([len(x) for x in left]), np.array([len(blobs[p]) for p in place])
        good = (got >= 0) & links(got, sizes_a, sizes_b, percent) if len(a) else np.zeros(0, bool)
        told = {c: batch.column(c).filter(pa.array(good)) for c in ("label_a", "label_b")}
        yield pa.RecordBatch.from_pydict({"a": pa.array(a[good]), "b": pa.array(b[good]), "overlap": pa.array(got[good])} | told)


def _relabelled(labels: DataFrame, edges: DataFrame, *rows: DataFrame) -> tuple[DataFrame, ...]:
    """``labels``, and every table of ``rows``, with the labels that edges join replaced by the smallest of their component."""
    joined = staged(edges.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "joined")
    ends = joined.select("a").union(joined.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("label"))
    moved = components(ends, joined).select(F.col("label").alias("_new"), F.col("node").alias("label"))
    out = []
    for table in (labels, *rows):
        columns = [F.coalesce("_new", "label").alias(c) if c == "label" else F.col(c) for c in table.columns]
        out.append(staged(spread_join(table, moved, "label", "row", "left").select(*columns), "labels"))
    discard(joined, edges)
    return tuple(out) if rows else (out[0], None)


def product_links(left: list[np.ndarray], right: list[np.ndarray], percent: int = PERCENT, columns: int = 2048) -> np.ndarray:
    """Overlap of every row of one block with every row of another where they link, else 0: a product of two incidence matrices.

    Overlaps are accumulated over blocks of columns; pairs that can no longer reach their bound are dropped, and it ends when none is left.
    """
    sizes_a, sizes_b = (np.array([len(r) for r in rows]) for rows in (left, right))
    need = -(-percent * (sizes_a[:, None] + sizes_b) // (100 + percent))
    live = np.minimum(sizes_a[:, None], sizes_b) >= need
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    cells = []
    for rows, sizes in ((left, sizes_a), (right, sizes_b)):
        values = np.concatenate(rows)
        at = np.searchsorted(shared, values)
        owner = np.repeat(np.arange(len(rows)), sizes)
        known = at < len(shared)
        known[known] = shared[at[known]] == values[known]
        at, owner = at[known], owner[known]
        order = np.argsort(at, kind="stable")
        cells.append((at[order], owner[order], np.bincount(owner, minlength=len(rows))))
    count = np.zeros(live.shape, np.float32)
    for start in range(0, len(shared), columns):
        if not live.any():
            break
        parts = []
        for at, owner, rest in cells:
            a, b = np.searchsorted(at, (start, start + columns))
            part = np.zeros((len(rest), columns), np.float32)
            part[owner[a:b], at[a:b] - start] = 1
            rest -= np.bincount(owner[a:b], minlength=len(rest))
            parts.append(part)
        count += parts[0] @ parts[1].T
        live &= count + np.minimum(cells[0][2][:, None], cells[1][2]) >= need
    return np.where(live & (count >= need), count, 0).astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links that join labels not joined by those before."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            above[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, np.int64)


def _block_links(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between rows of different components that share a column of many rows, as products of blocks of rows.

    A row goes to the block of its most common column, its size class and a part of these by hash. Blocks that share a column, in equal
    or neighbouring classes (others can't link) and not all of one component, are multiplied. No pair of rows is ever
    a row of a table: a product gives only links that join components, fewer than its rows.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("long")
    placed = hot.groupBy("row").agg(F.max_by("gram", F.struct("held", "gram")).alias("cell"), F.first("n").alias("n"), F.first("label").alias("label"))
    placed = placed.withColumn("class", size_class).withColumn("cell", F.xxhash64("cell", "class"))
    rows = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_GRAMS) / F.max("n"))))
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).alias("parts"))
    placed = spread_join(placed, parts, "cell", "row").select("row", "label", "class", F.xxhash64("cell", F.pmod(F.xxhash64("row"), F.col("parts"))).alias("block"))
    placed = staged(placed, "blocks")
    held = hot.select("gram", "row").join(placed, "row").groupBy("gram", "block")
    held = staged(held.agg(F.first("class").alias("class"), F.min("label").alias("low"), F.max("label").alias("high")), "held")
    one, other = (held.withColumnsRenamed({c: c + k for c in ("block", "class", "low", "high")}) for k in ("_a", "_b"))
    meet = one.join(other, "gram").filter((F.col("block_a") <= F.col("block_b")) & (F.abs(F.col("class_a") - F.col("class_b")) <= 1))
    meet = meet.filter(F.least("low_a", "low_b") < F.greatest("high_a", "high_b")).select("block_a", "block_b").distinct()
    # At most BLOCK_ROWS rows and some BLOCK_GRAMS columns of them, or one row.
    packed = placed.join(sets, "row").groupBy("block").agg(F.collect_list(F.struct("row", "label", "grams")).alias("rows"))
    packed = staged(packed, "packed")
    sides = [packed.select(F.col("block").alias("block" + k), F.col("rows").alias("rows" + k)) for k in ("_a", "_b")]
    joined = meet.join(sides[0], "block_a").join(sides[1], "block_b").select("rows_a", "rows_b")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, labels, grams = [], [], []
            for side in (row["rows_a"], row["rows_b"]):
                ids.append(np.array([x["row"] for x in side], np.int64))
                labels.append(np.array([x["label"] for x in side], np.int64))
                grams.append([np.frombuffer(x["grams"], np.uint64) for x in side])
            count = product_links(*grams, percent)
            i, j = np.nonzero((count > 0) & (labels[0][:, None] != labels[1]))
            kept = _forest(labels[0][i], labels[1][j])
            i, j = i[kept], j[kept]
            out = {"a": ids[0][i], "b": ids[1][j], "overlap": count[i, j], "label_a": labels[0][i], "label_b": labels[1][j]}
            yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in out.items()})

    return joined.mapInArrow(multiply, EDGES)


def similar_documents(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, digests: bool = False) -> DataFrame:
    """``row, doc_id, n_shingles, component_id, twin`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, the row's own included; ``twin`` is the
    row whose n-gram set this one equals. Words are runs of characters other than ASCII white space,
    A-Z in lower case. Null or empty texts have no n-grams and link with nothing. Rows that share a
    doc_id are separate documents; a null id stays null unless a link gives a smaller one. Other
    columns are not read. With ``digests`` there are also ``digest``, the SHA-256 of the text, and ``head``,
    one row number for each component (null where there are no n-grams).
    """
    spark = docs.sparkSession
    chunks = chunk_table(docs)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = bucket_count(total // 6)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield from entries(row["chunk_id"], *Incidence(Chunk(row), width).column_entries(), buckets, bits=48)

    rarity = staged(exchange(chunks.mapInArrow(columns, ENTRY_SCHEMA), "u2", _rarity, bits=48), "rarity")
    release_shuffles(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk(row)
            m = Incidence(chunk, width)
            codes = codes_of(row)[m.columns.group]
            shared = np.bincount(m.owners, codes > 0, minlength=len(chunk.ids)).astype(np.int64)
            stay = (m.sizes > 0) & (100 * shared >= percent * m.sizes)
            ends = np.cumsum(m.sizes)
            more = {"digest": pa.array([row["signs"][SIGN_BYTES * k : SIGN_BYTES * (k + 1)].hex() for k in range(len(chunk.ids))])} if digests else {}
            yield pa.RecordBatch.from_pydict(
                {
                    "row": pa.array((row["chunk_id"] << 13) + np.arange(len(chunk.ids))),
                    "doc_id": pa.array(chunk.ids),
                    "n": pa.array(m.sizes.astype(np.int64)),
                    "grams": pa.array([m.grams[e - n : e].tobytes() if s else None for s, e, n in zip(stay, ends, m.sizes, strict=True)], pa.binary()),
                    "rarity": pa.array([codes[e - n : e].tobytes() if s else None for s, e, n in zip(stay, ends, m.sizes, strict=True)], pa.binary()),
                }
                | more
            )

    told = ["digest"] if digests else []
    every = staged(answered(chunks, rarity).mapInArrow(rows, ROWS + ", digest string" * digests), "rows")
    discard(chunks, rarity)
    release_shuffles(spark)

    # Equal rows become one.
    open_rows = every.filter(F.col("grams").isNotNull())
    signed = staged(open_rows.select("row", "doc_id", "n", F.sha2("grams", 256).alias("sign")), "signed")
    twins = signed.groupBy("sign").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    twins = staged(twins.select("sign", F.col("first.row").alias("twin"), F.col("first.doc_id").alias("label")), "twins")
    matrix = staged(open_rows.join(twins.select(F.col("twin").alias("row")), "row", "left_semi"), "matrix")
    sizes = staged(every.select("row", "doc_id", "n", *told), "sizes")
    discard(every)
    release_shuffles(spark)

    # The first columns of each row, rarest first: a linked row holds one of them among its own first columns.
    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_row, out_n, out_own, out_gram, out_place = [], [], [], [], []
            for row, n, grams, rare in zip(*[batch.column(c).to_pylist() for c in ("row", "n", "grams", "rarity")], strict=True):
                h, r = np.frombuffer(grams, np.uint64), np.frombuffer(rare, np.uint8)
                few = n - -(-percent * n // 100) + 1
                first = np.lexsort((h, r))[:few]
                place = np.flatnonzero(r[first] > 0)
                first = first[place]
                out_place.append(place)
                out_row.append(np.full(len(first), row))
                out_n.append(np.full(len(first), n))
                out_own.append(np.full(len(first), int((r == 0).sum())))
                out_gram.append(h[first].view(np.int64))
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"row": cat(out_row), "n": cat(out_n), "own": cat(out_own), "gram": cat(out_gram), "place": cat(out_place)})

    firsts = staged(matrix.select("row", "n", "grams", "rarity").mapInArrow(prefix, "row long, n long, own long, gram long, place long"), "prefixes")
    may_link = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)

    sets = matrix.select("row", "grams")

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.withColumnsRenamed({"row": "a", "grams": "grams_a"})
        right = sets.withColumnsRenamed({"row": "b", "grams": "grams_b"})
        blocks = spread_join(pairs.join(left, "a"), right, "b", "a").sortWithinPartitions("b")
        return staged(blocks.mapInArrow(lambda it: _overlaps(it, percent), EDGES), "edges")

    # Each round every row meets two partners: near copies grow together without all their pairs. A row with few columns of
    # its own is nearest to the middle of its copies, so every other round prefers such partners, and the rounds between any.
    # Only labels of components outlive a round, so components are joined on a graph that shrinks.
    named = firsts.select("gram", "row", "n", "own", "place")
    held = named.groupBy("gram").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").drop("held")
    named = staged(spread_join(named, held, "gram", "row").withColumn("label", F.col("row")), "named")
    discard(firsts)
    labels, turn, before = staged(twins.select(F.col("twin").alias("row"), F.col("twin").alias("label")), "labels"), 0, None
    while True:
        order = F.struct(F.floor(64 * F.col("own") / F.col("n")) if turn % 2 == 0 else F.lit(0), F.xxhash64("row", F.lit(turn)))
        heads = named.groupBy("gram").agg(
            F.min(F.struct(order.alias("order"), F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"))).alias("head"),
            F.min("label").alias("least"),
            F.max("label").alias("most"),
        )
        torn = staged(spread_join(named, heads.filter("least < most").select("gram", "head"), "gram", "row"), "torn")
        discard(named)
        left = torn.agg(F.approx_count_distinct("label")).first()[0]
        if left:
            met = torn.filter((F.col("label") != F.col("head.label_b")) & may_link(F.col("n"), F.col("head.n_b")))
            partner = F.struct("head.b", F.col("label").alias("label_a"), "head.label_b")
            met = met.groupBy(F.col("row").alias("a")).agg(F.min_by(partner, "head.order").alias("one"), F.min_by(partner, F.xxhash64("row", "head.b")).alias("other"))
            new = verified(met.select("a", F.explode(F.array_distinct(F.array("one", "other"))).alias("met")).select("a", "met.*"))
            labels, named = _relabelled(labels, new, torn.drop("head"))
        else:
            named = staged(torn.drop("head"), "named")
        discard(torn)
        release_shuffles(spark)
        # A round that joins under a tenth of what is apart is the last one.
        if not left or (before is not None and 10 * left > 9 * before):
            break
        before, turn = left, turn + 1

    # What is left: rows of different components that share a first column. Columns of few rows make pairs of rows, at the first
    # column both have, and only if the columns from there on can hold the overlap that the sizes ask for. Columns that both have
    # lie among the first ones of both, or beyond the first ones of the row whose first ones end earlier, so their number is bounded.
    held = named.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    sides = staged(spread_join(named, held, "gram", "row"), "sides")
    discard(named)
    few = sides.filter(F.col("held") <= PAIRED_ROWS).select("gram", "row", "n", "place", "label")
    lists = sides.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda x: x["gram"]).alias("hot"))
    few = staged(few.join(lists, "row"), "few")
    one, other = (few.select(*[F.col(c).alias(c + k) if c != "gram" else F.col(c) for c in few.columns]) for k in ("_a", "_b"))
    need = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    pairs = (
        one.join(other, "gram")
        .filter((F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("row_a") > F.col("row_b"))))
        .filter((F.col("label_a") != F.col("label_b")) & may_link(F.col("n_a"), F.col("n_b")))
        .filter(F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= need)
        .filter(F.get(F.array_intersect("hot_a", "hot_b"), F.lit(0)) == F.col("gram"))
        .filter(F.size(F.array_intersect("hot_a", "hot_b")) + F.ceil(percent * F.greatest("n_a", "n_b") / 100) - 1 >= need)
        .select(F.col("row_a").alias("a"), F.col("row_b").alias("b"), "label_a", "label_b")
    )
    more = staged(verified(pairs).unionByName(_block_links(sides.filter(F.col("held") > PAIRED_ROWS), sets, percent)), "edges")
    discard(sides, few)
    labels, _ = _relabelled(labels, more)
    release_shuffles(spark)

    # A component's name is its smallest document, and of those with that id the first row.
    named_by = twins.join(labels.withColumnsRenamed({"row": "twin", "label": "group"}), "twin")
    names = named_by.groupBy("group").agg(F.min(F.struct("label", "twin")).alias("component"))
    found = staged(spread_join(named_by.select("twin", "group"), names, "group", "twin").select("twin", "component"), "components")
    members = spread_join(signed.select("row", "sign"), twins.join(found, "twin").select("sign", "twin", "component"), "sign", "row")
    members = members.select("row", "twin", F.col("component.label").alias("component"), F.col("component.twin").alias("head"))
    null = lambda c: F.when(c != NULL_ID, c)
    return sizes.join(members, "row", "left").select(
        "row",
        null(F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        null(F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce("twin", "row").alias("twin"),
        *([*told, "head"] if digests else []),
    )


def keep_one_of_each(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are alone or the first, by doc_id and row, of their component.

    Decided row by row: rows that share a doc_id, or have none, are documents of their own, and of repeated
    rows one stays. Documents without words are never copies of each other and stay. All columns are kept, whatever their names.
    """
    found = staged(similar_documents(docs, width, percent, digests=True).filter(F.col("head").isNotNull()), "found")
    rank = F.struct(F.coalesce("doc_id", F.lit(int(NULL_ID))).alias("doc_id"), "row")
    firsts = found.groupBy("head").agg(F.min(rank)["row"].alias("row")).select("row", F.lit(True).alias("first"))
    # Rows equal in id and text are in one component, so at most one of them is its first.
    decided = found.join(firsts, "row", "left").groupBy("doc_id", "digest")
    decided = staged(decided.agg(F.count("first").alias("stay"), F.count(F.lit(1)).alias("held")).filter("stay < held"), "decided")
    # Whole rows travel in a struct, where no name can clash.
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.col("text").cast("string"), 256).alias("digest"))
    same = (rows["digest"] == decided["digest"]) & rows["doc_id"].eqNullSafe(decided["doc_id"])
    rest = rows.join(decided, same, "left_anti").select("whole")
    again = staged(decided.filter("stay = 1"), "again")
    discard(found)
    if again.isEmpty():  # no row stands there twice with the same id and text
        return rest.select("whole.*")
    same = (rows["digest"] == again["digest"]) & rows["doc_id"].eqNullSafe(again["doc_id"])
    one = rows.join(again, same, "left_semi").groupBy("doc_id", "digest").agg(F.min_by("whole", F.xxhash64("whole")).alias("whole"))
    return rest.unionByName(one.select("whole")).select("whole.*")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
