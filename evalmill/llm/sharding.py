"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has virtual nodes at hashed places of a ring of ``2 ** bits`` places;
a key goes to the first node at or after its own place. Keys are taken arc by
arc clockwise, within an arc in the order of their places. No shard takes more
than its bound: a key whose shard is full continues clockwise to the next node
whose shard has room. Without slack
the bounds add up to the number of rows, so that counts are at most one apart;
with slack ``e`` a bound is ``(1 + e)`` times the mean, rounded up, and fewer
rows move when a shard is added.

Which keys overflow, and where to, follows from the number of keys on each arc
between two nodes. So only counts are walked: one fold over the arcs (shards x
virtual nodes of them, whatever the input) grants each arc a run of keys in each
shard it reaches. Keys get their number along the ring from one sort, whose
range partitioning deals out even a doc_id that a third of the rows repeat, and
then look up the run that their number falls into. Texts are read once and not
shuffled.

Defined results: a null text has no bytes, a null doc_id has the place of the
empty string. Rows that repeat a doc_id share a place and are rows of their own,
in the order of size, checksum, then any. Equal texts aren't kept together.
Other columns, whatever their names, are passed over. An empty table gives an
empty result; shards may stay empty if there are fewer rows than shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalmill.session import stage

VIRTUAL_NODES = 64
#: Bits of a key's place along the ring, of which the first ``RING_BITS`` tell its arc.
PLACE_BITS = 60
RING_BITS = 16


def place_of(key: Column) -> Column:
    """The place of a key: the first 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def ring_nodes(spark: SparkSession, shards: int, virtual_nodes: int) -> DataFrame:
    """(arc, shard, cell) of each virtual node, numbered clockwise from 0; nodes of one place by shard and replica."""
    if shards < 1 or virtual_nodes < 1:
        raise ValueError("a ring needs a shard and a virtual node")
    if shards * virtual_nodes > 1 << (RING_BITS - 2):
        raise ValueError("too many virtual nodes for the places of the ring")
    node = F.col("id")
    named = spark.range(shards * virtual_nodes).select(
        F.floor(node / virtual_nodes).cast("int").alias("shard"), (node % virtual_nodes).alias("replica")
    )
    cell = F.shiftright(place_of(F.concat(F.lit("shard "), "shard", F.lit(" node "), "replica")), PLACE_BITS - RING_BITS)
    clockwise = Window.orderBy("cell", "shard", "replica")
    return named.withColumn("cell", cell).select(
        (F.row_number().over(clockwise) - 1).alias("arc"), "shard", "cell"
    )


def arcs_by_cell(nodes: DataFrame) -> DataFrame:
    """(cell, arc) for every place of the ring: the first node at or after it, past the end the first of all."""
    firsts = nodes.groupBy("cell").agg(F.min("arc").alias("arc"))
    places = nodes.sparkSession.range(1 << RING_BITS).select(F.col("id").alias("cell"))
    backwards = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return places.join(firsts, "cell", "left").select(
        "cell", F.coalesce(F.last("arc", ignorenulls=True).over(backwards), F.lit(0)).alias("arc")
    )


def _bounds(shards: int, slack: float) -> str:
    """SQL for the most rows of each shard, given ``total``: floor or ceiling of the mean without slack."""
    if slack < 0:
        raise ValueError("slack can't be negative")
    if slack:
        return f"transform(sequence(1, {shards}), s -> cast(ceil(total * {1 + slack!r} / {shards}) as bigint))"
    return f"transform(sequence(1, {shards}), s -> total div {shards} + if(s <= total % {shards}, 1, 0))"


def grants(nodes: DataFrame, counts: DataFrame, shards: int, slack: float) -> DataFrame:
    """(arc, shard, since, until, slot): the runs of ring numbers that go from an arc to a shard, and their first slot.

    ``counts`` has (arc, n). One row holds all arcs, in order; the fold carries
    the room left in each shard. An arc's keys fill the shards in the order in
    which they are met clockwise from it.
    """
    arcs = nodes.join(counts, "arc", "left").select("arc", "shard", F.coalesce("n", F.lit(0)).alias("n"))
    whole = arcs.agg(
        F.array_sort(F.collect_list(F.struct("arc", "shard", "n"))).alias("arcs"), F.sum("n").alias("total")
    ).selectExpr("arcs", f"{_bounds(shards, slack)} as room")
    owners = stage(whole.selectExpr("arcs", "transform(arcs, a -> a.shard) as owners", "room"), "ring-owners")
    met = "array_distinct(concat(slice(owners, a.arc + 1, size(owners)), slice(owners, 1, a.arc)))"
    # Written, so that the fold reads its arrays and doesn't make them anew at each step.
    walks = stage(owners.selectExpr(f"transform(arcs, a -> struct(a.arc as arc, a.n as n, {met} as met)) as arcs", "room"), "ring-walks")
    none = "cast(array() as array<bigint>)"
    took = (
        "aggregate(a.met, struct(a.n as left, {none} as took), (t, s) -> struct(t.left - least(t.left, acc.room[s]) as left, "
        "array_append(t.took, least(t.left, acc.room[s])) as took), t -> t.took)"
    ).format(none=none)
    # A transform of one element binds what an arc takes of each shard it meets to the name ``took``.
    step = (
        f"transform(array({took}), took -> struct("
        "transform(acc.room, (x, s) -> x - took[array_position(a.met, cast(s as int)) - 1]) as room, "
        "concat(acc.runs, filter(transform(a.met, (s, i) -> struct(a.arc as arc, s as shard, took[i] as n)), r -> r.n > 0))"
        " as runs))[0]"
    )
    empty = "cast(array() as array<struct<arc: int, shard: int, n: bigint>>)"
    runs = walks.selectExpr(
        f"posexplode(aggregate(arcs, struct(room, {empty} as runs), (acc, a) -> {step}, acc -> acc.runs)) as (place, run)"
    ).select("place", "run.*")
    until = F.sum("n").over(Window.orderBy("place"))
    slot = F.sum("n").over(Window.partitionBy("shard").orderBy("place")) - F.col("n")
    return runs.select("arc", "shard", (until - F.col("n")).alias("since"), until.alias("until"), slot.alias("slot"))


def ring_numbers(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``number``, their place from 0 in the order of these columns.

    Sorted by range and written, so that a row's number is its place in its
    partition after the rows of the partitions before: a table of one row a
    partition.
    """
    tick = F.monotonically_increasing_id()
    placed = stage(rows.sort(*order).withColumn("tick", tick), "ring-order")
    part = F.shiftright("tick", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = stage(sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start")), "ring-starts")
    number = F.col("start") + F.col("tick").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(starts), part == starts["part"]).select(*rows.columns, number.alias("number"))


def shard_rows(
    docs: DataFrame, shards: int = 40, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row; ``size`` is the text's bytes plus 16."""
    nodes = stage(ring_nodes(docs.sparkSession, shards, virtual_nodes), "ring-nodes")
    text = F.coalesce(docs["text"], F.lit(""))
    place = place_of(docs["doc_id"])
    keyed = docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place.alias("place"),
        F.shiftright(place, PLACE_BITS - RING_BITS).alias("cell"),
    )
    # One row for each place of the ring, whatever the input.
    rows = keyed.join(F.broadcast(arcs_by_cell(nodes)), "cell").drop("cell")
    rows = stage(rows.withColumn("tie", F.monotonically_increasing_id()), "ring-rows")
    counts = rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n"))
    runs = stage(grants(nodes, counts, shards, slack), "ring-grants")
    numbered = ring_numbers(rows, "arc", "place", "doc_id", "size", "text_crc32", "tie")
    # At most shards x arcs runs; nearly every arc has one.
    runs = F.broadcast(runs.withColumnRenamed("arc", "of"))
    here = (numbered["arc"] == runs["of"]) & (numbered["number"] >= runs["since"]) & (numbered["number"] < runs["until"])
    slot = F.col("slot") + F.col("number") - F.col("since")
    return numbered.join(runs, here).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))
