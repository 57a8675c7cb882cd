"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2^16 places. Every shard owns the places from each of its virtual nodes to
the next node clockwise, and a row's place is the hash of its doc_id. A shard has room for
a bounded number of rows; where more arrive, the later ones by (place, doc_id, size,
checksum) walk on clockwise to the next nodes until a shard has room. With no slack the
capacities add up to the row count exactly, so every shard is full and the row counts are
at most one apart; a new shard then takes its arcs, and otherwise only overflow moves.

Only the number of rows at each place is needed to settle where overflow goes: that is a
table of at most 2^16 counts, walked once. Rows find their shard by their rank at their
place, so there is one shuffle of narrow rows and no window larger than a place.
"""

import bisect
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: places of the ring as a power of two, and virtual nodes of a shard
PLACE_BITS, NODES = 16, 256

#: a row's size beyond its text's bytes
OVERHEAD = 16


def place(doc_id: Column) -> Column:
    """Where a key stands on the ring: the first hex digits of its MD5. NULL is a key too."""
    key = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(key, 1, PLACE_BITS // 4), 16, 10).cast("int")


def nodes(shards: int, per_shard: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise. Adding a shard adds nodes only."""
    def where(shard: int, node: int) -> int:
        digest = hashlib.md5(f"shard {shard} node {node}".encode()).hexdigest()
        return int(digest[:PLACE_BITS // 4], 16)
    return sorted((where(s, n), s) for s in range(shards) for n in range(per_shard))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard may hold; with no slack they add up to ``rows``."""
    if slack > 0:
        return [-(-int(rows * (1 + slack)) // shards) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, slack: float = 0.0, per_shard: int = NODES) -> list[tuple]:
    """(place, first rank, rows, shard, first slot) of every run of rows that stay together.

    Each place's rows go to the shard of the node at or before it; what finds no room goes
    on from node to node clockwise. Own rows come first: a shard's room is shared out to all
    places it owns before overflow from elsewhere, both in clockwise order.
    """
    ring = nodes(shards, per_shard)
    starts = [p for p, _ in ring]
    room = capacities(sum(counts.values()), shards, slack)
    slots = [0] * shards
    runs, overflow = [], []

    def put(at: int, rank: int, rows: int, shard: int) -> int:
        taken = min(rows, room[shard])
        if taken:
            runs.append((at, rank, taken, shard, slots[shard]))
            room[shard] -= taken
            slots[shard] += taken
        return taken

    for at in sorted(counts):
        node = bisect.bisect_right(starts, at) - 1
        taken = put(at, 0, counts[at], ring[node][1])
        if taken < counts[at]:
            overflow.append((node, at, taken, counts[at] - taken))
    # nodes of full shards are left out of the rest of the walk
    following: dict[int, int] = {}

    def next_open(node: int) -> int:
        passed = []
        node %= len(ring)
        while room[ring[node][1]] == 0:
            passed.append(node)
            node = following.get(node, (node + 1) % len(ring))
        for p in passed:
            following[p] = node
        return node

    for node, at, rank, rows in overflow:
        while rows:
            node = next_open(node + 1)
            taken = put(at, rank, rows, ring[node][1])
            rank, rows = rank + taken, rows - taken
    return runs


def assigned(docs: DataFrame, shards: int, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs``.

    size is the text's UTF-8 bytes plus 16, text_crc32 the checksum of these bytes; a NULL
    text counts as empty. shard is 0 to shards - 1 and slot numbers a shard's rows from 0
    without gaps. Rows equal in doc_id, size and checksum stand side by side and are counted
    before the shuffle, so a repeated row is one row there; NULL doc_ids are one key.
    """
    content = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = (docs.select(F.col("doc_id").cast("long"), (F.length(content) + OVERHEAD).cast("long").alias("size"),
                        F.crc32(content).alias("text_crc32"))
            .withColumn("place", place(F.col("doc_id")))
            .groupBy("place", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")))
    counts = {r.place: r.n for r in rows.groupBy("place").agg(F.sum("copies").alias("n")).collect()}  # 2^16 at most
    runs = docs.sparkSession.createDataFrame(
        walk(counts, shards, slack), "place int, first long, rows long, shard int, slot long")
    spread = F.collect_list(F.struct("first", "rows", "shard", "slot"))
    runs = runs.groupBy("place").agg(spread.alias("runs"))
    upto = W.Window.partitionBy("place").orderBy("doc_id", "size", "text_crc32").rowsBetween(
        W.Window.unboundedPreceding, W.Window.currentRow)
    ranked = rows.withColumn("rank", F.sum("copies").over(upto) - F.col("copies"))
    # the runs are one row for each place, 2^16 at most
    placed = (ranked.join(F.broadcast(runs), "place").select("*", F.explode("runs").alias("run"))
              .withColumn("begin", F.greatest("rank", "run.first"))
              .withColumn("end", F.least(F.col("rank") + F.col("copies"), F.col("run.first") + F.col("run.rows")))
              .where("begin < end"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.col("run.shard").alias("shard"),
        F.explode(F.expr("sequence(run.slot + begin - run.first, run.slot + end - run.first - 1)")).alias("slot"))


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """As :func:`assigned` with equal row counts, and the columns law ('rows') and
    grown_shard, which this law leaves NULL."""
    return assigned(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
