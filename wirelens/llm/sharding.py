"""Shards on a consistent-hash ring with virtual nodes and bounded loads.

The ring is divided into a fixed number of equal slots.  Every shard owns the slots of its virtual
nodes, and a key belongs to the first node clockwise from its slot.  A shard takes rows up to its
bound; rows beyond it go on clockwise to the next shard that has room.  With the tight bound (floor or
ceil of rows / shards) all counts are at most one apart; a looser ``load`` moves fewer rows.

Who goes on is decided on counts per slot (a table whose size is the ``slots`` parameter, whatever the
input); rows only need their rank inside the slot.  A slot that a shared key fills is ranked in parts by a
hash of the row, each offset by the counts of the parts before it.  Equal rows are counted as one and multiplied again
after ranking, so copies of one row cannot fill a task.
"""

import hashlib
import json
import math

from pyspark.sql import DataFrame, Window, functions as F

SLOTS, NODES = 4096, 64
SALTS = 16  # parts of a slot that are ranked apart


def ring(shards: int, slots: int = SLOTS, nodes: int = NODES) -> list[list[int]]:
    """For each slot the shards in the order their nodes are met clockwise.

    Nodes of different shards in one slot are met in the order of their full hash.
    """
    points = []
    for shard in range(shards):
        for node in range(nodes):
            place = int.from_bytes(hashlib.blake2b(f"{shard}:{node}".encode(), digest_size=8).digest(), "big")
            points.append((place * slots >> 64, place, shard))
    points.sort()
    first, orders = 0, []
    for slot in range(slots):
        while first < len(points) and points[first][0] < slot:
            first += 1
        met = dict.fromkeys(points[(first + i) % len(points)][2] for i in range(len(points)))
        orders.append(list(met))
    return orders


def bounds(rows: int, shards: int, load: float | None) -> list[int]:
    """Rows each shard may take: exact shares, or ``load`` times the mean."""
    if load is None:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil(rows / shards * load)] * shards


def fill(counts: dict[int, int], orders: list[list[int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(slot, shard, from, until, first place): ranks of a slot that a shard takes.

    In round r every slot offers what is left to the r-th shard it meets, in ring order; only keys that
    their nearer shards have refused move on.
    """
    room, used = list(room), [0] * len(room)
    taken, pieces = {s: 0 for s in counts}, []
    for r in range(len(room)):
        for slot in sorted(counts):
            shard = orders[slot][r]
            n = min(counts[slot] - taken[slot], room[shard] - used[shard])
            if n > 0:
                pieces.append((slot, shard, taken[slot], taken[slot] + n, used[shard]))
                taken[slot] += n
                used[shard] += n
    return pieces


def assign_shards(rows: DataFrame, key: list[str], shards: int = 16, load: float | None = None,
                  slots: int = SLOTS, nodes: int = NODES) -> DataFrame:
    """(row, shard, slot): every row of ``rows`` with its shard and its gapless place there.

    ``key`` names the columns that fix a row's place on the ring.  Null is a key like any other; rows
    with equal keys are told apart by their other columns, and rows equal in all columns share out
    consecutive places.  An empty table gives an empty result.  Map columns cannot be compared and are
    not accepted.
    """
    place = F.xxhash64(*key, *[F.isnull(c) for c in key])
    placed = (rows.select(F.struct("*").alias("row"), place.alias("place"))
              .groupBy("row", "place").agg(F.count("*").alias("copies"))
              .withColumn("ring_slot", F.pmod("place", F.lit(slots)).cast("int")))
    counts = {r[0]: r[1] for r in placed.groupBy("ring_slot").agg(F.sum("copies")).collect()}  # at most ``slots`` rows
    pieces = fill(counts, ring(shards, slots, nodes), bounds(sum(counts.values()), shards, load))
    # rows of a slot are ranked in salted parts, at every size alike: a hot key fills no task of its own
    placed = placed.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "row"), F.lit(SALTS)))
    earlier = Window.partitionBy("ring_slot").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("ring_slot", "salt").agg(F.sum("copies").alias("n")).select(
        "ring_slot", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = placed.join(parts, ["ring_slot", "salt"])
    order = Window.partitionBy("ring_slot", "salt").orderBy("place", "row")
    ranked = (placed.withColumn("upto", F.col("before") + F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .select("row", "ring_slot", F.explode(F.sequence(F.col("upto") - F.col("copies"), F.col("upto") - 1)).alias("rank")))
    table = json.dumps([dict(zip(("ring_slot", "shard", "lo", "hi", "base"), p)) for p in pieces])
    plan = rows.sparkSession.range(1).select(F.inline(F.from_json(
        F.lit(table), "array<struct<ring_slot:int,shard:int,lo:bigint,hi:bigint,base:bigint>>")))
    inside = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(plan, "ring_slot").where(inside).select(
        "row", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))


def write_shards(docs: DataFrame, path: str, key: list[str], shards: int = 16, files_per_shard: int = 1) -> None:
    """Write ``docs`` as Parquet in one folder per shard (shard=N, with _ added while a column has that name), every
    shard cut into files by place."""
    placed = assign_shards(docs, key, shards)
    folder = "shard"
    while folder in docs.columns:  # a column of that name stays a column
        folder += "_"
    (placed.repartition(shards * files_per_shard, "shard", F.pmod("slot", F.lit(files_per_shard)))
     .select("row.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path))
