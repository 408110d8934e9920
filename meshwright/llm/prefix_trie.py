"""Prefix trie of conversations by partition refinement.

All conversations start in one class.  Each round splits the classes that are still active by their next turn; a class
with one sequence left retires, its tail is a unary chain that no later round touches.  Afterwards
counts of leaves and savings are folded back from the last round to the first.

* Turns are told apart by SHA-256 of role and text, so texts never move.
* Equal conversations are one sequence from the start, with a weight; rounds end at the longest stretch
  that two *different* conversations share.
* A conversation may hold any number of turns: turns are numbered along a range-partitioned order with
  offsets for what spans several partitions, and sequences are compared by hashes of blocks of turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: A conversation's first turns come from the first conversation of its block of ids.
ID_BLOCK = 100
#: Fewer turns than this are taken over.
HEAD = 6
#: Turn digests that are hashed to one.
FAN = 256
#: Bytes of ids that one row holds for hashing.
IDS_BYTES = 1 << 16

NO_IDS = hashlib.sha256(b"").hexdigest()
TRIE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"

c = F.col


def head_of(conv_id: Column) -> Column:
    """How many turns a conversation takes over."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEAD).cast("int")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and characters so far of each turn inside its conversation's rows of this sorted partition."""
    part, last, place, upto = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, chars = batch.column("conv_id").to_numpy(), batch.column("n_chars").to_numpy()
        new = np.append(True, conv[1:] != conv[:-1])
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        places = np.arange(len(conv)) - first[run] + 1
        total = np.cumsum(chars)
        so_far = total - (total - chars)[first][run]
        if conv[0] == last:
            places[run == 0] += place
            so_far[run == 0] += upto
        last, place, upto = conv[-1], int(places[-1]), int(so_far[-1])
        yield pa.RecordBatch.from_pydict(
            {
                "conv_id": batch.column("conv_id"),
                "part": pa.array(np.full(len(conv), part, np.int32)),
                "place": pa.array(places),
                "upto": pa.array(so_far),
                "digest": batch.column("digest"),
                "n_chars": batch.column("n_chars"),
            }
        )


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted members as text, in rows of bounded size."""
    held: list[int] = []
    key: tuple | None = None

    def row() -> pa.RecordBatch:
        seq, n_turns, chars = key
        return pa.RecordBatch.from_pydict(
            {
                "seq": pa.array([seq], pa.string()),
                "first": pa.array(held[:1], pa.int64()),
                "n": pa.array([len(held)], pa.int64()),
                "n_turns": pa.array([n_turns], pa.int64()),
                "chars": pa.array([chars], pa.int64()),
                "ids": pa.array([",".join(map(str, held)).encode()], pa.binary()),
            }
        )

    for batch in batches:
        for seq, conv_id, n_turns, chars in zip(*(batch.column(k).to_pylist() for k in ("seq", "conv_id", "n_turns", "chars")), strict=True):
            if key and (key[0] != seq or len(held) >= IDS_BYTES // 20):
                yield row()
                held = []
            key = (seq, n_turns, chars)
            held.append(conv_id)
    if held:
        yield row()


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a sequence; its ids stream through the hash."""
    now: list | None = None

    def row() -> pa.RecordBatch:
        rep, weight, n_turns, chars, ends = now[1:]
        return pa.RecordBatch.from_pydict(
            {"rep": [rep], "weight": [weight], "n_turns": [n_turns], "chars": [chars], "ends": [ends.hexdigest()]},
        )

    for batch in batches:
        for k in range(batch.num_rows):
            seq, first, n, n_turns, chars, ids = (batch.column(name)[k].as_py() for name in ("seq", "first", "n", "n_turns", "chars", "ids"))
            if now and now[0] == seq:
                now[2] += n
                now[5].update(b"," + ids)
                continue
            if now:
                yield row()
            now = [seq, first, n, n_turns, chars, hashlib.sha256(ids)]
    if now:
        yield row()


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, upto, digest, n_chars`` of all turns: number, and characters up to there. Also the staged table behind it."""
    role, text = (F.coalesce(c(k).cast("string"), F.lit("")) for k in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id is not null").select(
        c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("n_chars")
    )
    # The last key only deals rows that are equal in all others to several tasks.
    keys = ("conv_id", "turn", "digest", "tie")
    ordered = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    runs = staged(ordered.mapInArrow(_number, "conv_id long, part int, place long, upto long, digest binary, n_chars long"), "turns")
    parts = runs.groupBy("conv_id", "part").agg(F.max("place").alias("n"), F.max("upto").alias("chars"))
    split = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "chars"))).alias("of")).filter(F.size("of") > 1)
    at = split.select("conv_id", "of", F.posexplode("of").alias("k", "here"))
    before = lambda field: F.aggregate(F.slice("of", 1, c("k")), F.lit(0).cast("long"), lambda a, x: a + x[field])
    # A conversation is split only where a partition ends: at most two rows a partition.
    offsets = at.select("conv_id", c("here.part").alias("part"), before("n").alias("n_before"), before("chars").alias("chars_before"))
    placed = runs.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    none = F.lit(0).cast("long")
    pos, upto = c("place") + F.coalesce("n_before", none), c("upto") + F.coalesce("chars_before", none)
    return placed.select("conv_id", pos.alias("pos"), upto.alias("upto"), "digest", "n_chars"), runs


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with their heads taken over: ``conv_id, n_turns, chars`` and their turns ``conv_id, pos, upto, digest, n_chars``."""
    turns, runs = numbered_turns(conversations)
    none = F.lit(0).cast("long")
    own = turns.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.max("upto").alias("own_chars"), F.coalesce(F.max(F.when(c("pos") <= head_of(c("conv_id")), c("upto"))), none).alias("cut")
    )
    heads = turns.filter((c("conv_id") % ID_BLOCK == 0) & (c("pos") < HEAD)).groupBy(c("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "upto", "digest", "n_chars"))).alias("head"))
    h = head_of(c("conv_id"))
    info = own.withColumn("base", c("conv_id") - c("conv_id") % ID_BLOCK).join(heads, "base", "left")
    info = info.withColumn("h", h).withColumn("head", F.when(c("head").isNotNull(), F.slice("head", 1, c("h"))))
    taken = F.coalesce(F.size("head"), F.lit(0))
    head_chars = F.when(taken > 0, F.element_at("head", -1)["upto"]).otherwise(none)
    info = info.withColumns({"taken": F.greatest(taken, F.lit(0)), "head_chars": head_chars})
    info = staged(
        info.select(
            "conv_id", "h", "head", "taken", "head_chars", "cut",
            (c("taken") + F.greatest(c("n") - c("h"), none)).alias("n_turns"), (c("head_chars") + c("own_chars") - c("cut")).alias("chars"),
        ),
        "heads",
    )
    of_heads = info.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.upto", "t.digest", "t.n_chars")
    rest = turns.filter(c("pos") > h).join(info.select("conv_id", "h", "taken", "head_chars", "cut"), "conv_id")
    rest = rest.select("conv_id", (c("pos") - c("h") + c("taken")).alias("pos"), (c("upto") - c("cut") + c("head_chars")).alias("upto"), "digest", "n_chars")
    all_turns = staged(of_heads.unionByName(rest), "rebuilt")
    discard(runs)
    return info.select("conv_id", "n_turns", "chars"), all_turns


def sequences(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a distinct sequence of turns: ``rep`` (its smallest conversation), ``weight, n_turns, chars, ends`` (hash of its ids)."""
    longest = convs.agg(F.max("n_turns")).first()[0] or 0
    level = turns.select("conv_id", (c("pos") - 1).alias("at"), "digest")
    while longest > 0:
        hashed = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: F.hex(x["digest"])), ""), 256)
        level = level.groupBy("conv_id", F.expr(f"at div {FAN}").alias("block")).agg(hashed.alias("digest"))
        level = level.select("conv_id", c("block").alias("at"), F.unhex("digest").alias("digest"))
        longest = -(-longest // FAN) if longest > FAN else 0
    seq = F.concat_ws(":", c("n_turns").cast("string"), F.hex("digest"))
    members = convs.join(level.select("conv_id", "digest"), "conv_id", "left").select(seq.alias("seq"), "conv_id", "n_turns", "chars")
    ordered = members.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    blobs = ordered.mapInArrow(_blobs, "seq string, first long, n long, n_turns long, chars long, ids binary")
    ranked = blobs.repartition("seq").sortWithinPartitions("seq", "first")
    return staged(ranked.mapInArrow(_hash_ids, "rep long, weight long, n_turns long, chars long, ends string"), "sequences")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie, one row each (``TRIE``).

    ``conversations`` has ``conv_id, turn, role, text``. Rows without conv_id belong to no conversation; a null turn comes first; turns
    of one number are ordered by the hash of role and text; a null role or text is empty; repeated rows are turns each; other columns aren't
    read. Texts of any length count whole. Without conversations there is no node.
    """
    convs, turns = rebuilt(conversations)
    seqs = sequences(convs, turns)
    root, n_convs, n_seqs = seqs.agg(F.min("rep"), F.sum("weight"), F.count(F.lit(1))).first()
    if not n_seqs:
        return conversations.sparkSession.createDataFrame([], TRIE)
    ended = seqs.filter("n_turns = 0").select("ends").first()
    of = turns.join(seqs.withColumnRenamed("rep", "conv_id").withColumnRenamed("chars", "all_chars"), "conv_id").select(
        c("conv_id").alias("rep"), "pos", "digest", "n_chars", (c("all_chars") - c("upto")).alias("rest"), "weight",
        (c("pos") < c("n_turns")).cast("int").alias("more"), F.when(c("pos") == c("n_turns"), c("ends")).alias("ends"),
    )
    paths = staged(of.sortWithinPartitions("pos", "rep"), "paths")
    discard(turns)

    active, levels = seqs.select("rep", F.lit(root).alias("node")), []
    while True:
        moves = paths.filter(c("pos") == len(levels) + 1).join(active, "rep")
        found = staged(
            moves.groupBy("node", "digest").agg(
                F.min("rep").alias("id"), F.count(F.lit(1)).alias("seqs"), F.sum("weight").alias("n_convs"),
                F.max("n_chars").alias("n_chars"), F.max("rest").alias("rest"), F.max("ends").alias("ends"),
            ),
            "classes",
        )
        levels.append(found)
        split = found.filter("seqs > 1")
        if split.isEmpty():
            break
        following = staged(moves.join(split.select("node", "digest", "id"), ["node", "digest"]).select("rep", c("id").alias("node")), "active")
        if len(levels) > 1:
            discard(active)
        active = following

    # From the last round back to the first; a retired class has one leaf and saves its whole tail.
    own = (c("n_convs") - 1) * c("n_chars")
    below, nodes, depth = None, [], len(levels)
    for found in reversed(levels):
        summed = found.filter("seqs = 1").select("node", F.lit(1).cast("long").alias("leaves"), ((c("n_convs") - 1) * (c("n_chars") + c("rest"))).alias("saved"))
        if below is not None:
            split = found.filter("seqs > 1").join(below.withColumnRenamed("node", "id"), "id")
            split = staged(split.select("id", "node", "n_convs", "n_children", "leaves", (c("saved") + own).alias("saved"), "ends"), "folded")
            nodes.append(split.withColumn("depth", F.lit(depth).cast("long")))
            summed = summed.unionByName(split.select("node", "leaves", "saved"))
        below = summed.groupBy("node").agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        depth -= 1

    session, null = conversations.sparkSession, F.lit(None).cast("long")
    top = session.createDataFrame([(root, n_convs, ended.ends if ended else None)], "id long, n_convs long, ends string")
    none = F.lit(0).cast("long")
    counts = [F.coalesce(k, none).alias(k) for k in ("n_children", "saved")]
    top = top.join(below.withColumnRenamed("node", "id"), "id", "left").select("id", null.alias("node"), "n_convs", *counts, F.coalesce("leaves", F.lit(1).cast("long")).alias("leaves"), "ends")
    trie = None
    for split in [top.withColumn("depth", none), *nodes]:
        rows = split.select(
            c("id").alias("conv_id"), "depth", c("node").alias("parent_conv_id"), "n_convs", "n_children",
            c("leaves").alias("n_leaves"), c("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"),
        )
        trie = rows if trie is None else trie.unionByName(rows)

    retired = None
    for k, found in enumerate(levels):
        one = found.filter("seqs = 1").select(c("id").alias("rep"), F.lit(k + 1).cast("long").alias("from"), "node")
        retired = one if retired is None else retired.unionByName(one)
    tails = paths.join(retired, "rep").filter(c("pos") >= c("from")).select(
        c("rep").alias("conv_id"), c("pos").alias("depth"), F.when(c("pos") == c("from"), c("node")).otherwise(c("rep")).alias("parent_conv_id"),
        c("weight").alias("n_convs"), c("more").cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((c("weight") - 1) * (c("n_chars") + c("rest"))).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"),
    )
    return trie.unionByName(tails)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 is written out: a byte is one step without shift, each of its bits one with.
OP12_SQL = f"""
WITH told AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM told
), ids AS (
  SELECT conv_id, xor(list_reduce(
    flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END,
    4294967295::BIGINT), 4294967295::BIGINT) % {HEAD} AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), heads AS (
  SELECT i.conv_id, b.pos, b.digest, b.text FROM ids i JOIN turns b ON b.conv_id = i.conv_id - i.conv_id % {ID_BLOCK} AND b.pos <= i.h
), whole AS (
  SELECT * FROM heads UNION ALL
  SELECT t.conv_id, t.pos - i.h + coalesce(k.n, 0), t.digest, t.text
  FROM turns t JOIN ids i USING (conv_id) LEFT JOIN (SELECT conv_id, count(*) AS n FROM heads GROUP BY 1) k USING (conv_id) WHERE t.pos > i.h
), prefixes AS (
  SELECT conv_id, pos AS depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY pos) AS key, length(text) AS chars,
    count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM whole
  UNION ALL SELECT conv_id, 0, '', 0, (SELECT count(*) FROM whole w WHERE w.conv_id = ids.conv_id) FROM ids
), nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n_turns = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY 1, 2
), children AS (
  SELECT left(key, 64 * (depth - 1)::INTEGER) AS key, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2
), below AS (
  SELECT left(n.key, 64 * a.depth::INTEGER) AS key, a.depth, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(n.own) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM nodes) n JOIN (SELECT DISTINCT depth FROM nodes) a ON a.depth = n.up
  LEFT JOIN children k ON k.key = n.key AND k.depth = n.depth GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (key, depth) LEFT JOIN children k USING (key, depth)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = left(n.key, 64 * (n.depth - 1)::INTEGER)
"""
