"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Every source is cut into blocks of documents in a random but repeatable order.  Slots hold one block each.
By a fluid schedule every source gets its weight's share of each slot (of the weights of all sources
that haven't run out); block ``i`` is released in the slot in which its source's share reaches ``i`` and due
by the end of the slot in which it reaches ``i + 1``.  Earliest deadline first gives each slot the released
block that is due first.  A block in its window keeps its source less than one block from its share.

The schedule isn't run slot by slot over the corpus.  Blocks are first ordered by a moment inside their own
windows, the same share of it (the phase) for all blocks of a source, with a range-partitioned sort and prefix sums.
Where as many moments lie before a slot as there are slots before it, every source is inside its windows, so
the schedule can be cut there: in every ``STRETCH`` places the first such slot begins a stretch, and earliest deadline
first runs in each stretch by itself.  There is no period, and no table of all sources is gathered.

Where ``STRETCH`` places hold no such slot, or a cut leaves more blocks due than slots before the deadline, some block misses its window.
Such stretches are found, joined with their neighbours in pairs, fours, eights and so on, and scheduled again until all blocks
are in their windows; run over everything at once, earliest deadline first always ends so.
Nothing is dropped: when a source runs out the others go on at their relative weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Documents in a block.
BLOCK = 64
#: Weights are the documents of a source to this power: small sources come up more often.
TEMPER = 0.5
#: Buckets by which the order inside one source is dealt out.
RANK_BUCKETS = 4096
#: Places in the order of moments of which one begins a stretch of the schedule; a stretch has under twice as many slots.
STRETCH = 256
#: Shares this near to a whole number count as whole, as sums of weights are rounded.
NEAR = 1e-6
#: Steps by the golden section spread phases evenly.
GOLDEN = 0.6180339887498949


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ordered(rows: DataFrame, by: tuple[str, ...], *sizes: str) -> DataFrame:
    """``rows`` with ``no``, their place by the columns ``by``, and for each of ``sizes`` its sum before them (``before_...``); staged."""
    laid = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    laid = staged(laid.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda names, window: [F.coalesce(F.sum(n).over(window), F.lit(0)).alias(n) for n in names]
    totals = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_count"), *[F.sum(c).alias(f"_all_{c}") for c in sizes])
    totals = totals.select(F.col("_part").alias("_held"), *sums(["_count", *[f"_all_{c}" for c in sizes]], before))
    # One row for each partition of the sort.
    found = laid.select("*", *[x.alias(f"_in_{c}") for c, x in zip(sizes, sums(sizes, inside), strict=True)]).join(F.broadcast(totals), F.col("_part") == F.col("_held"))
    return found.select(
        *rows.columns, (F.col("_count") + F.col("_at")).alias("no"), *[(F.col(f"_all_{c}") + F.col(f"_in_{c}")).alias(f"before_{c}") for c in sizes]
    )


def target_weights(counts: DataFrame, temper: float = TEMPER, weights: dict | None = None) -> DataFrame:
    """``source, n_docs, weight, phase``: shares of one, from given target weights or tempered counts.

    Sources missing from ``weights`` (and the null source) have weight 0: they follow when all others have run out.
    """
    if weights:
        pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        raw = F.coalesce(F.try_element_at(pairs, F.col("source")), F.lit(0.0))
    else:
        raw = F.pow(F.col("n_docs").cast("double"), F.lit(temper))
    total = counts.agg(F.sum(raw).alias("total"))
    # One row: the sum of the weights.
    shares = counts.join(F.broadcast(total)).select("source", "n_docs", F.coalesce(F.try_divide(raw, F.col("total")), F.lit(0.0)).alias("weight"))
    return _ordered(shares, ("weight", "source")).select("source", "n_docs", "weight", F.pmod((F.col("no") + 1) * GOLDEN, F.lit(1.0)).alias("phase"))


def _ranked(docs: DataFrame, sources: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rank documents inside their source, and add what ``sources`` says, without gathering a source in one task.

    Rows are dealt by (source, hash bucket); a bucket's first rank is the sum of the buckets
    before it, so a source with a third of all rows is spread over all its buckets.
    """
    keyed = docs.withColumn("_h", F.xxhash64(F.lit("mix"), *key)).withColumn("_b", F.pmod("_h", F.lit(RANK_BUCKETS)))
    sizes = keyed.groupBy("source", "_b").count()
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        F.col("source").alias("_s"), F.col("_b").alias("_sb"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")
    )
    bases = bases.join(sources, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    order = Window.partitionBy("source", "_b").orderBy("_h", *key)
    return (
        keyed.withColumn("_r", F.row_number().over(order) - 1)
        .join(bases, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb")))
        .withColumn("rank", (F.col("_base") + F.col("_r")).cast("long"))
        .drop("_h", "_b", "_s", "_sb", "_base", "_r")
    )


def _windows(blocks: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """``no, release, due, share`` of ``blocks``: first slot, last slot and one, and the slots before their moment, by the fluid schedule.

    Slots before a time are what all sources have been given by then: its length times the weights that still
    run, and all blocks of the sources that have run out, summed over their ends before it in one sorted pass.
    """
    at = lambda kind, turn: F.struct(F.lit(kind).alias("kind"), (turn / F.col("weight")).alias("at"))
    times = blocks.filter("weight > 0").select(F.col("no").alias("_of"), F.inline(F.array(at("release", F.col("_b")), at("share", F.col("turn")), at("due", F.col("_b") + 1))))
    n_blocks = F.ceil(F.col("n_docs") / block)
    ends = sources.filter("weight > 0").select(
        F.lit(None).cast("long").alias("_of"), F.lit("end").alias("kind"), (n_blocks / F.col("weight")).alias("at"), F.col("weight").alias("out"), n_blocks.cast("double").alias("given")
    )
    passed = _ordered(times.withColumns({"out": F.lit(0.0), "given": F.lit(0.0)}).unionByName(ends), ("at", "_of", "kind"), "out", "given")
    slots = F.col("at") * (1 - F.col("before_out")) + F.col("before_given")
    found = passed.filter("kind != 'end'").groupBy("_of").agg(*[F.max(F.when(F.col("kind") == k, slots)).alias(k) for k in ("release", "share", "due")])
    return found.select(F.col("_of").alias("no"), F.floor(F.col("release") + NEAR).alias("release"), F.ceil(F.col("due") - NEAR).alias("due"), "share")


def _earliest_deadline_first(jobs: Column) -> Column:
    """Numbers ``no`` of ``jobs`` in the order of their slots, which are the places that the jobs hold now.

    Each slot takes the released job that is due first (the smaller ``no`` of two), or else the next to be released.
    """

    def take(state: Column, slot: Column) -> Column:
        wait = lambda j: F.greatest(j["release"] - slot, F.lit(0).cast("long"))
        first = F.array_min(F.transform(state["left"], lambda j: F.struct(wait(j).alias("wait"), j["due"].alias("due"), j["no"].alias("no"))))
        return _let(
            first["no"],
            lambda no: F.struct(F.filter(state["left"], lambda j: j["no"] != no).alias("left"), F.concat(state["done"], F.array(no)).alias("done")),
        )

    start = F.array_min(F.transform(jobs, lambda j: j["no"]))
    empty = F.struct(jobs.alias("left"), F.array().cast("array<bigint>").alias("done"))
    return F.aggregate(F.sequence(start, start + F.size(jobs) - 1), empty, take, lambda state: state["done"])


def _scheduled(blocks: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """``_s, _b, slot, ahead`` of all blocks: their slot, and the rows in slots before it.

    Sources of weight 0 have no windows; their blocks take the slots after all others, in the order they have.
    """
    laid = staged(_ordered(blocks, ("moment", "turn", "_s", "_b"), "rows"), "moments")
    jobs = laid.join(_windows(laid, sources, block), "no", "left").withColumns(
        {
            "release": F.coalesce("release", "no"), "due": F.coalesce("due", F.col("no") + 1), "share": F.coalesce("share", F.col("no").cast("double")),
            "stretch": F.floor(F.col("no") / STRETCH),
        }
    )
    bucket = Window.partitionBy("stretch")
    level = (F.col("share") >= F.col("no")) & (F.lag("share").over(bucket.orderBy("no")) < F.col("no"))
    cut = F.coalesce(F.min(F.when(F.col("level"), F.col("no"))).over(bucket), F.col("stretch") * STRETCH)
    jobs = jobs.withColumn("level", level).withColumn("cut", cut)
    jobs = staged(jobs.withColumn("stretch", F.greatest(F.lit(0), F.col("stretch") - (F.col("no") < F.col("cut")).cast("long"))), "stretches")
    done, todo, width = None, jobs, 1
    while True:
        slots = staged(_run(todo, width), "slots")
        bad = staged(slots.filter(~F.col("kept")).select(F.expr(f"stretch div {2 * width}").alias("pair")).distinct(), "missed")
        pair = F.expr(f"stretch div {2 * width}")
        merging = not bad.isEmpty()
        if merging:
            # A pair is scheduled anew as a whole, whatever came of its other half.
            again = lambda df, how, pair=pair, bad=bad: df.withColumn("pair", pair).join(bad, "pair", how).drop("pair")
            slots, todo = again(slots, "left_anti"), again(jobs, "left_semi")
            done = again(done, "left_anti") if done is not None else None
        done = slots if done is None else done.unionByName(slots)
        if not merging:
            break
        width *= 2
    before = Window.partitionBy("width", "group").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return done.select("_s", "_b", "slot", (F.col("base") + F.coalesce(F.sum("rows").over(before), F.lit(0))).alias("ahead"))


def _run(jobs: DataFrame, width: int) -> DataFrame:
    """Earliest deadline first in groups of ``width`` stretches: the jobs with their ``slot``, and whether they ``kept`` their window."""
    grouped = jobs.withColumns({"width": F.lit(width), "group": F.expr(f"stretch div {width}")})
    # At most twice STRETCH rows a stretch.
    dealt = grouped.groupBy("group").agg(F.min("no").alias("start"), F.min("before_rows").alias("base"), F.collect_list(F.struct("release", "due", "no")).alias("jobs"))
    slots = dealt.select("base", "start", F.posexplode(_earliest_deadline_first(F.col("jobs"))).alias("pos", "no")).select("base", "no", (F.col("start") + F.col("pos")).alias("slot"))
    placed = grouped.select("_s", "_b", "rows", "no", "stretch", "width", "group", "release", "due").join(slots, "no")
    return placed.withColumn("kept", (F.col("slot") >= F.col("release")) & (F.col("slot") < F.col("due"))).drop("release", "due")


def mix(docs: DataFrame, block: int = BLOCK, weights: dict | None = None, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``doc_id, source, weight, block_no, slot, position`` for every row of ``docs``.

    ``slot`` is the place of the row's block and ``position`` that of the row itself (both from 0, without
    gaps) in the mixed order; by slots every source stays less than one block from its share. A null source is a source of its own; repeated rows are placed each; an empty
    table gives an empty result. ``key`` names doc_id and further columns that tell rows with one doc_id apart.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *key[1:])
    counts = staged(ids.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs")), "sources")
    sources = staged(target_weights(counts, weights=weights), "weights")
    ranked = _ranked(ids, sources, key).withColumn("block_no", F.floor(F.col("rank") / block))
    turn = F.col("block_no") + F.col("phase")
    moment = F.when(F.col("weight") > 0, F.try_divide(turn, F.col("weight"))).otherwise(F.lit(float("inf")))
    blocks = ranked.filter(F.col("rank") % block == 0).select(
        "weight", moment.alias("moment"), turn.alias("turn"), F.col("source").alias("_s"), F.col("block_no").alias("_b"), F.least(F.lit(block), F.col("n_docs") - F.col("rank")).alias("rows")
    )
    starts = _scheduled(blocks, sources, block)
    return ranked.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block_no") == F.col("_b"))).select(
        *key, "source", "weight", F.col("block_no").cast("long").alias("block_no"), F.col("slot").cast("long").alias("slot"),
        (F.col("ahead") + F.col("rank") % block).cast("long").alias("position"),
    )


def mixed(docs: DataFrame, position: str | None = None, **options) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, laid out in mixed order.

    Parquet written from it holds the mix in file order; with ``position`` the place is a column of that name instead, and rows
    aren't moved once more to lie in order. Rows equal in doc_id, source and text share the first of their places, so that positions have gaps there.
    """
    # Two 64-bit numbers stand for the text; the row travels in a struct, where no name can clash.
    digest = F.array(F.xxhash64("text"), F.xxhash64(F.lit("mix"), "text"))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), digest.alias("text_key")
    )
    order = mix(rows.select("doc_id", "source", "text_key"), key=("doc_id", "text_key"), **options).groupBy("doc_id", "source", "text_key").agg(F.min("position").alias("place"))
    same = rows["doc_id"].eqNullSafe(order["doc_id"]) & rows["source"].eqNullSafe(order["source"]) & (rows["text_key"] == order["text_key"])
    laid = rows.join(order, same)
    if position:
        return laid.select("row.*", F.col("place").alias(position))
    return laid.repartitionByRange("place").sortWithinPartitions("place").select("row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
