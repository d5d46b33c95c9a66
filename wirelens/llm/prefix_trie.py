"""The trie of conversation prefixes, from fingerprints that are put together instead of texts.

A sequence of turns has a fingerprint: n turns with values t1 .. tn give (n, t1 + t2*B + .. + tn*B^(n-1)) modulo a
prime, in three lanes.  Such pairs form a monoid, (n, x) * (m, y) = (n + m, x + B^n * y), and a known head can be
divided off again.  So the fingerprint of every prefix of a rebuilt conversation is a head product of its base times
a suffix product of its own turns; no rebuilt text is ever made.  Turns are written once, each under a reference;
prefixes carry the reference of their last turn.

Prefixes with one fingerprint form a node.  A node is right if its members share the parent's fingerprint and
their last turns are equal, by induction over depth.  Last turns that are the same reference need no look;
of the others the stored role and text are compared.  If any node fails, all is done again with other hash
values.

A node belongs to its smallest member.  The nodes of one conversation are then the tail of its path, and
what hangs below a node is: the rest of its owner's tail, and the whole tails of its other members.  So sums over
subtrees are two plain aggregations, however deep the trie is.

Long conversations are cut into pieces of turns; a piece has a product of its own and pieces are combined from
one row each.
"""

import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wirelens.llm.common import landed
from wirelens.session import ship_package

PRIME = (1 << 31) - 1  # products of two values below it fit into a long
LANES = (1, 2, 3)
DIGITS, PLACES = 64, 6  # exponents below 64 ** 6
PIECE = 256  # turn numbers that share a sort
DEPTHS, IDS = 1024, 4096  # depths, and conversation ids, that are put together in one step
WORD = r"[^\x20\x09-\x0D]+"


def _longs(values: list[int]) -> Column:
    return F.lit(np.array(values, np.int64))  # one literal; a list would be a tree of many


class Lane:
    """One hash of turns and its base, as column expressions."""

    def __init__(self, number: int, attempt: int, prime: int):
        digest = hashlib.sha256(struct.pack("<qq", number, attempt)).digest()
        self.prime, self.seed = prime, int.from_bytes(digest[:4], "little")
        self.base = 2 + int.from_bytes(digest[4:12], "little") % max(prime - 2, 1) if prime > 3 else 2
        self.tables = [[pow(self.base, d * DIGITS ** k, prime) for d in range(DIGITS)] for k in range(PLACES)]

    def turn(self, *content: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), *content), F.lit(self.prime))

    def mod(self, value: Column) -> Column:
        return F.pmod(value, F.lit(self.prime))

    def power(self, exponent: Column) -> Column:
        """base ** exponent, from tables of the powers of every digit."""
        out = None
        for k, table in enumerate(self.tables):
            digit = F.shiftright(exponent, 6 * k).bitwiseAND(DIGITS - 1)
            factor = F.get(_longs(table), digit.cast("int"))
            out = factor if out is None else self.mod(out * factor)
        return out

    def without(self, count: Column) -> Column:
        """base ** -count, for counts up to 3."""
        inverse = pow(self.base, -1, self.prime)
        return F.get(_longs([pow(inverse, k, self.prime) for k in range(4)]), count.cast("int"))


def _store(conversations: DataFrame, lanes: list[Lane]) -> DataFrame:
    """Every turn with its reference, piece, place in the piece, and the product of the piece up to it."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("piece", F.coalesce(F.floor(F.col("turn") / PIECE), F.lit(-(1 << 62))).cast("long"))
    inside = Window.partitionBy("conv_id", "piece").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = turns.withColumn("place", F.row_number().over(inside).cast("long"))
    terms = [lane.mod(lane.turn("role", "text") * lane.power(F.col("place") - 1)).alias(f"t{i}") for i, lane in enumerate(lanes, 1)]
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.select("*", *terms)
    sums = [lane.mod(F.sum(f"t{i}").over(running)).alias(f"x{i}") for i, lane in enumerate(lanes, 1)]
    placed = placed.select("*", *sums)
    return placed.select(F.monotonically_increasing_id().alias("ref"), "conv_id", "piece", "place", "role", "text",
                         F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), *[f"t{i}" for i in LANES], *[f"x{i}" for i in LANES])


def _heads(stored: DataFrame, lanes: list[Lane]) -> tuple[DataFrame, DataFrame]:
    """(a row per piece with what stands before it, a row per conversation with its parts of every rebuilt fingerprint)."""
    pieces = stored.groupBy("conv_id", "piece").agg(F.max("place").alias("n"), F.max_by(F.struct(*[f"x{i}" for i in LANES]), "place").alias("x"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    pieces = pieces.select("*", *[lane.mod(F.col(f"x.x{i}") * lane.power(F.col("before"))).alias(f"y{i}") for i, lane in enumerate(lanes, 1)])
    pieces = pieces.select("conv_id", "piece", "n", "before", *[lane.mod(F.coalesce(F.sum(f"y{i}").over(earlier), F.lit(0))).alias(f"p{i}")
                                                               for i, lane in enumerate(lanes, 1)])
    first = stored.where("place <= 3").join(pieces.where("before < 3"), ["conv_id", "piece"]).where("before + place <= 3")
    first = first.select("conv_id", F.struct((F.col("before") + F.col("place")).alias("r"), "ref", "words", *[
        lane.mod(F.col(f"p{i}") + lane.power(F.col("before")) * F.col(f"x{i}")).alias(f"x{i}") for i, lane in enumerate(lanes, 1)]).alias("turn"))
    first = first.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("head"))
    whole = pieces.groupBy("conv_id").agg(F.sum("n").alias("n")).join(first, "conv_id")
    base = whole.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    whole = (whole.withColumn("h", h).join(base, F.col("conv_id") - F.col("conv_id") % 20 == F.col("base"), "left")
             .withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0)))))
    at = lambda head, k, i: F.coalesce(F.get(F.col(head), (k - 1).cast("int"))[f"x{i}"], F.lit(0).cast("long"))
    convs = whole.select(
        "conv_id", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"), "base_head",
        *[at("base_head", F.col("m"), i).alias(f"a{i}") for i in LANES],
        *[at("head", F.least("h", "n"), i).alias(f"b{i}") for i in LANES])
    return pieces, convs


def _members(stored: DataFrame, lanes: list[Lane]) -> DataFrame:
    """(conv_id, depth, f1..f3, g1..g3, ref, words, ended): every prefix of every rebuilt conversation, g being its parent's."""
    pieces, convs = _heads(stored, lanes)
    pieces, convs = landed(pieces, "trie-pieces"), landed(convs, "trie-heads")
    heads = convs.select("conv_id", "total", "base_head", F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("depth"))
    of = lambda k, name: F.get(F.col("base_head"), (k - 1).cast("int"))[name]
    zero = F.lit(0).cast("long")
    heads = heads.select(
        "conv_id", "depth", *[F.coalesce(of(F.col("depth"), f"x{i}"), zero).alias(f"f{i}") for i in LANES],
        *[F.coalesce(of(F.col("depth") - 1, f"x{i}"), zero).alias(f"g{i}") for i in LANES],
        F.coalesce(of(F.col("depth"), "ref"), F.lit(-1).cast("long")).alias("ref"), F.coalesce(of(F.col("depth"), "words"), zero).alias("words"),
        (F.col("depth") == F.col("total")).alias("ended"))
    ahead = pieces.join(convs.drop("base_head"), "conv_id").where("before + n > h")
    own = (stored.drop("role", "text").join(ahead, ["conv_id", "piece"]).where("before + place > h")
           .withColumn("depth", F.col("m") + F.col("before") + F.col("place") - F.col("h")))

    def rebuilt(lane: Lane, i: int, local: Column) -> Column:
        whole = F.col(f"p{i}") + lane.mod(lane.power(F.col("before")) * local)  # product of all own turns up to here
        return lane.mod(F.col(f"a{i}") + lane.mod(lane.without(F.col("h") - F.col("m")) * lane.mod(whole - F.col(f"b{i}"))))
    own = own.select(
        "conv_id", "depth", *[rebuilt(lane, i, F.col(f"x{i}")).alias(f"f{i}") for i, lane in enumerate(lanes, 1)],
        *[rebuilt(lane, i, lane.mod(F.col(f"x{i}") - F.col(f"t{i}"))).alias(f"g{i}") for i, lane in enumerate(lanes, 1)],
        "ref", "words", (F.col("depth") == F.col("total")).alias("ended"))
    return heads.unionByName(own)


KEY = ["depth", *[f"f{i}" for i in LANES]]


def _nodes(members: DataFrame) -> DataFrame:
    parents = [f(f"g{i}").alias(f"g{i}{end}") for i in LANES for f, end in ((F.min, ""), (F.max, "_max"))]
    return members.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.col("ended").cast("long")).alias("n_ends"),
        F.min("words").alias("words"), F.min("ref").alias("ref"), F.max("ref").alias("ref_max"), *parents)


def _wrong(nodes: DataFrame, members: DataFrame, stored: DataFrame) -> int:
    """Nodes whose members do not all have one parent and equal last turns."""
    torn = nodes.where(F.greatest(*[F.col(f"g{i}") != F.col(f"g{i}_max") for i in LANES])).count()
    doubtful = nodes.where("ref <> ref_max").select(*KEY)
    asked = members.select(*KEY, "ref").distinct().join(doubtful, KEY)
    told = asked.join(stored.select("ref", "role", "text"), "ref")
    differ = told.groupBy(*KEY).agg((F.min("role") != F.max("role")).alias("r"), (F.min("text") != F.max("text")).alias("t"))
    return torn + differ.where("r OR t").count()


def _ends(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node, in rising order; ids travel joined, a range of ids in one row."""
    some = members.where("ended").groupBy(*KEY, F.floor(F.col("conv_id") / IDS).alias("range")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = some.repartition(parts, *KEY).sortWithinPartitions(*KEY, "range")
    fields = ", ".join(f"{c} long" for c in KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(KEY))]
            for own, ids in zip(zip(*columns), batch.column("ids").to_pylist()):
                if own != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if len(done) > 10_000:
                yield rows(done)
                done = []
        if key is not None:
            yield rows([*done, (*key, digest.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        *numbers, texts = zip(*done)
        return pa.RecordBatch.from_arrays([*[pa.array(n, pa.int64()) for n in numbers], pa.array(texts, pa.string())], [*KEY, "ends_sha256"])
    return ordered.mapInArrow(run, f"{fields}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, primes: Sequence[int] = (PRIME,) * 5) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row per node.

    Needs the columns conv_id, turn, role and text; others are not looked at, whatever their names.  Turns are
    ordered by turn, null first; turns with one number by role, then text.  Rows that agree in everything are
    as many turns.  Null role and text are empty; a row without conv_id belongs to no conversation and
    gives no turn.  Every conv_id is rebuilt, also one that is left without turns: it ends at the root.  An
    empty table has no conversation and gives no row, not even a root.  ``primes`` are tried in turn until
    no two different prefixes share a fingerprint.
    """
    spark = ship_package(conversations.sparkSession)
    for attempt, prime in enumerate(primes):
        lanes = [Lane(i, attempt, prime) for i in LANES]
        stored = landed(_store(conversations, lanes), "trie-turns")
        members = landed(_members(stored, lanes), "trie-members")
        nodes = landed(_nodes(members), "trie-nodes")
        if not _wrong(nodes, members, stored):
            break
    else:
        raise RuntimeError(f"fingerprints met in each of {len(primes)} attempts")
    leaf, saved = (F.col("n_ends") == F.col("n_convs")).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    nodes = nodes.select(*KEY, "conv_id", "n_convs", *[f"g{i}" for i in LANES], leaf.alias("leaf"), saved.alias("saved"),
                         F.floor(F.col("depth") / DEPTHS).alias("stretch"))
    # the owner's tail: what follows inside a stretch of depths, and all later stretches
    stretches = nodes.groupBy("conv_id", "stretch").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("kept"))
    later = Window.partitionBy("conv_id").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select("conv_id", "stretch", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in ("leaves", "kept")])
    below = Window.partitionBy("conv_id", "stretch").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = nodes.join(stretches, ["conv_id", "stretch"]).select(
        *KEY, "conv_id", "n_convs", *[f"g{i}" for i in LANES], (F.sum("leaf").over(below) + F.col("later_leaves")).alias("own_leaves"),
        (F.sum("saved").over(below) + F.col("later_kept")).alias("own_saved"))
    # the tails of the other members, each whole
    tails = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("kept"))
    others = (members.select(*KEY, "conv_id").join(tails, "conv_id").where("depth < top")
              .groupBy(*KEY).agg(F.sum("leaves").alias("other_leaves"), F.sum("kept").alias("other_saved")))
    children = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), *[F.col(f"g{i}").alias(f"f{i}") for i in LANES]).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(f"f{i}").alias(f"g{i}") for i in LANES], F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(0).cast("long")
    return (tail.join(children, KEY, "left").join(others, KEY, "left").join(_ends(members), KEY, "left")
            .join(parents, ["depth", *[f"g{i}" for i in LANES]], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"),
                    (F.col("own_leaves") + F.coalesce("other_leaves", none)).alias("n_leaves"),
                    (F.col("own_saved") + F.coalesce("other_saved", none)).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
