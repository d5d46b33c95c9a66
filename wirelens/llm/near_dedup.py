"""Near duplicates by MinHash bands, odd sketches and exact confirmation.

1. Per document: the set of word shingles, its MinHash samples, one hash per band of samples, and an odd
   sketch: every sample flips one bit of a small bitmap, so the bits in which two sketches differ tell
   how many samples differ.  Documents with the same set are one class from here on.
2. Classes of one band hash form a bucket.  In rounds, each member outside the bucket's largest component
   meets one random member of that component and one of the others (map-side minima, so a hot bucket is
   no group in one task): by sketches first, and the closest few that may reach the threshold are confirmed
   on the full sets.  Confirmed links give components; a large group of near copies is one component after
   some rounds, without its pairs.
3. Members of one bucket that are still in different components are compared across components: blocks of
   bounded size hold some members outside the largest component and some of all, and only what the sketches
   of the full sets leave possible comes out, to be confirmed exactly.  No pair that shares a band is
   left out unless its ends are connected already.

Besides the sketch of samples there is one of the full set.  Two of these differ in at most as many bits as
the sets in elements, which gives a sure bound, and in how many is known closely, which gives a sharp one.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.functions import arrow_udf

from wirelens.llm import spans
from wirelens.llm.common import landed, row_key
from wirelens.session import cut_lineage, release, ship_package

BANDS, ROWS, BITS, WHOLE_BITS, TRIES, BLOCK = 56, 6, 1024, 2048, 3, 2048
GROUP = 20_000  # rows of blocks that are compared in one group
_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 32, (BANDS * ROWS, 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of one slice, in that order.

    A text of fewer words than ``size``, but not none, has its whole sequence as one shingle.
    """
    data = spans.LOWER[data]
    starts, ends, doc = spans.words(data, offsets)
    word = spans.SpanHash(data)(starts, ends)
    n = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(first)
    grams = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    of = np.repeat(np.arange(n), grams)
    at = np.repeat(first[:-1], grams) + spans.ragged(grams)
    key = spans.mix(word[at])
    for i in range(1, size):
        inside = at + i < first[of + 1]
        key = np.where(inside, spans.pair(key, word[np.minimum(at + i, max(len(word) - 1, 0))]), key) if len(at) else key
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return of[fresh], key[fresh]


def signatures(of: np.ndarray, key: np.ndarray, n: int):
    """Per document with shingles: node, band hashes, odd sketch of the samples, odd sketch of the set."""
    first = np.searchsorted(of, np.arange(n + 1))
    size = np.diff(first)
    total = np.append(np.uint64(0), np.cumsum(spans.mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
    node = spans.mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64))
    has = np.flatnonzero(size)
    bands = np.zeros((len(has), BANDS), np.uint64)
    sketch = np.zeros((len(has), BITS // 64), np.uint64)
    if len(has):
        small, cut, row = (key >> np.uint64(32)).astype(np.uint32), first[:-1][has], np.arange(len(has))
        for i, (a, b) in enumerate(_SEEDS):
            x = (small ^ b) * a
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            sample = np.minimum.reduceat(x, cut).astype(np.uint64)
            band = bands[:, i // ROWS]
            band[:] = spans.pair(band if i % ROWS else np.full(len(has), i, np.uint64), sample)
            bit = spans.pair(np.full(len(has), i, np.uint64), sample) % np.uint64(BITS)
            sketch[row, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
    whole = np.zeros((len(has), WHOLE_BITS // 64), np.uint64)
    bit = spans.mix(key ^ np.uint64(0x5BD1E9955BD1E995)) % np.uint64(WHOLE_BITS)
    place = np.repeat(np.arange(len(has)), size[has]) * WHOLE_BITS + bit.astype(np.int64)
    odd, times = np.unique(place, return_counts=True)
    odd = odd[times % 2 == 1]
    np.bitwise_or.at(whole.reshape(-1), odd >> 6, np.uint64(1) << (odd & 63).astype(np.uint64))
    return size, has, node, bands, sketch, whole


def signed(docs: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, k, n_shingles, node, bands, sketch, whole) per row; node is null for a text without words."""
    ship_package(docs.sparkSession)
    own = docs.select(F.col(text).alias("text"), F.col(id_col).alias("doc_id"), row_key(id_col, text)["a"].alias("ka"), row_key(id_col, text)["b"].alias("kb"))

    def lists(values: np.ndarray, has: np.ndarray, n: int) -> pa.Array:
        width = np.zeros(n, np.int32)
        width[has] = values.shape[1]
        return pa.ListArray.from_arrays(np.append(np.int32(0), np.cumsum(width, dtype=np.int32)), values.view(np.int64).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in spans.slices(batch.column(0)):
                size, has, node, bands, sketch, whole = signatures(*shingles(data, offsets, shingle), hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in (1, 2, 3)]
                    + [pa.array(size), pa.array(node.view(np.int64), mask=size == 0), lists(bands, has, hi - lo), lists(sketch, has, hi - lo), lists(whole, has, hi - lo)],
                    ["doc_id", "ka", "kb", "n_shingles", "node", "bands", "sketch", "whole"])
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, ka long, kb long, n_shingles long, node long, bands array<long>, sketch array<long>, whole array<long>")


def most_different_bits(similarity: float, deviations: float = 7.0) -> int:
    """Bits in which two sketches may differ if the sets reach ``similarity``, but for so many standard deviations."""
    samples = BANDS * ROWS
    gone = samples * (1 - similarity)
    mean = BITS / 2 * (1 - math.exp(-4 * gone / BITS))
    slope = 2 * math.exp(-4 * gone / BITS)
    spread = BITS / 4 * (1 - math.exp(-8 * gone / BITS))
    return math.ceil(mean + deviations * math.sqrt(samples * similarity * (1 - similarity) * slope ** 2 + spread))


def bits_of_sets(elements, lib, similarity: float, deviations: float = 7.0):
    """Bits in which the sketches of two linked sets may differ, from the sum of their sizes.

    Linked sets differ in at most (1 - s) / (1 + s) of that sum; bits do not exceed elements, and are
    fewer where elements meet in a bit.
    """
    gone = elements * ((1 - similarity) / (1 + similarity))
    stay = lib.exp(gone * (-4 / WHOLE_BITS))
    spread = WHOLE_BITS / 4 * (1 - stay) - gone * stay
    spread = lib.greatest(spread, lib.lit(0.0)) if lib is F else lib.maximum(spread, 0.0)
    mean = WHOLE_BITS / 2 * (1 - lib.exp(gone * (-2 / WHOLE_BITS)))
    sharp = mean + deviations * lib.sqrt(spread) + 1.5
    return (lib.least(gone, sharp) if lib is F else lib.minimum(gone, sharp)) + 1e-6


def bins_for(sizes: DataFrame, least: int) -> int:
    """Groups of some ``GROUP`` rows: every member is sent to all blocks of its row or column of blocks."""
    wide, high = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("m") / BLOCK)
    rows = sizes.agg(F.coalesce(F.sum(F.col("m") * wide + F.col("n") * high), F.lit(0))).first()[0]
    return max(least, -(-int(rows) // GROUP))


def possible_links(mixed: DataFrame, sizes: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of different components that share a band and whose full-set sketches allow a link.

    A bucket is dealt into blocks: (some members outside the largest component) x (some of all).  Groups
    collect blocks up to a bounded number of rows, and compare inside each block.
    """
    spark = mixed.sparkSession
    dealt = mixed.join(sizes, "band").join(held.select("node", "n_shingles", "whole"), "node").select(
        "band", "node", "root", (F.col("root") == F.col("largest")).alias("in_largest"), "n_shingles", "whole",
        F.ceil(F.col("n") / BLOCK).cast("int").alias("wide"), F.ceil(F.col("m") / BLOCK).cast("int").alias("high"))
    at = F.pmod(F.xxhash64(F.lit("block"), "node"), F.lit(1 << 30))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where(~F.col("in_largest")).select("*", (at % F.col("high")).cast("int").alias("i"), every("wide").alias("j"), F.lit(0).alias("side"))
    right = dealt.select("*", (at % F.col("wide")).cast("int").alias("j"), every("high").alias("i"), F.lit(1).alias("side"))
    bins = bins_for(sizes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = left.unionByName(right).select(
        F.pmod(F.xxhash64("band", "i", "j"), F.lit(bins)).alias("bin"), F.xxhash64("band", "i", "j").alias("block"),
        "side", "node", "root", "in_largest", "n_shingles", "whole")

    def compare(table: pa.Table) -> pa.Table:
        side, block, node, root, big, n = (table.column(c).to_numpy() for c in ("side", "block", "node", "root", "in_largest", "n_shingles"))
        whole = table.column("whole").combine_chunks()
        whole = whole.flatten().to_numpy().view(np.uint64).reshape(len(table), -1)
        members = np.flatnonzero(side == 1)
        members = members[np.argsort(block[members], kind="stable")]
        found = [np.zeros((0, 2), np.int64)]
        ours = np.flatnonzero(side == 0)
        lo, hi = (np.searchsorted(block[members], block[ours], s) for s in ("left", "right"))
        done = 0
        while done < len(ours):
            until = max(done + 1, int(np.searchsorted(np.cumsum((hi - lo)[done:]), 200_000)) + done)
            count = (hi - lo)[done:until]
            a = np.repeat(ours[done:until], count)
            b = members[np.repeat(lo[done:until], count) + spans.ragged(count)]
            apart = (root[a] != root[b]) & (big[b] | (node[a] < node[b]))
            a, b = a[apart], b[apart]
            bits = np.bitwise_count(whole[a] ^ whole[b]).sum(axis=1, dtype=np.int64)
            near = bits <= bits_of_sets((n[a] + n[b]).astype(np.float64), np, similarity)
            a, b = node[a[near]], node[b[near]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            done = until
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})
    return blocks.groupBy("bin").applyInArrow(compare, "a long, b long").distinct()


def different_bits(a: str, b: str) -> Column:
    differ = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differ, F.lit(0), lambda s, x: s + x)


def confirmed(shingle: int, percent: int):
    @arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        """Whether 100 * intersection >= percent * union, on the full shingle sets."""
        out = []
        for lo in range(0, len(left), 512):
            both = pa.concat_arrays([left.slice(lo, 512).cast(pa.large_string()), right.slice(lo, 512).cast(pa.large_string())])
            n = len(both) // 2
            of, key = [], []
            for first, _, data, offsets in spans.slices(both):
                o, k = shingles(data, offsets, shingle)
                of.append(o + first)
                key.append(k)
            of, key = np.concatenate(of), np.concatenate(key)
            size = np.bincount(of, minlength=2 * n)
            order = np.lexsort((key, of % n))
            o, k = of[order] % n, key[order]
            common = np.bincount(o[1:][(o[1:] == o[:-1]) & (k[1:] == k[:-1])], minlength=n)
            out.append(100 * common >= percent * (size[:n] + size[n:] - common))
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))
    return linked


def components(edges: DataFrame, one: str = "a", other: str = "b") -> DataFrame:
    """(node, root) for every node of an edge list that is not a root; root is the smallest node that can be reached.

    In each round the smaller end of an edge gives way to that end's smallest smaller neighbour; then all smaller
    neighbours of a node are hung under the smallest of them (large and small stars).  What is left are stars.  A round is
    one plan with one checkpoint, since the driver keeps threads, plans and generated code of each.
    """
    here = cut_lineage(edges.select(F.greatest(one, other).alias("hi"), F.least(one, other).alias("lo")).where("hi > lo").distinct())
    while True:
        above = here.groupBy("hi").agg(F.min("lo").alias("top")).select(F.col("hi").alias("lo"), "top")
        lifted = here.join(above, "lo", "left").select("hi", F.coalesce("top", "lo").alias("lo"), F.isnotnull("top").alias("moved"))
        up = lifted.groupBy("hi").agg(F.min("lo").alias("up"))
        hung = (lifted.join(up, "hi")
                .select("hi", "up", "moved", F.explode(F.when(F.col("lo") == F.col("up"), F.array("hi")).otherwise(F.array("hi", "lo"))).alias("node"))
                .select(F.col("node").alias("hi"), F.col("up").alias("lo"), (F.col("moved") | (F.col("node") != F.col("hi"))).alias("moved")))
        here = cut_lineage(hung.groupBy("hi", "lo").agg(F.max("moved").alias("moved")))
        if here.where("moved").isEmpty():
            return here.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        here = here.select("hi", "lo")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
                    with_keys: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, node) for every row of ``docs``; ``with_keys``, also ``root``, which
    stands for the component where ids are null or repeated, and ``k``, the ``row_key`` of id and text.

    Links are pairs with 100 * intersection >= percent * union of their shingle sets; component_id is
    the smallest id reachable.  A text without words, or null, is linked with nothing.  Rows with equal ids
    and texts are copies of each other; a null id is never the smallest, and a component of null ids only
    has component_id null.  ``kept`` is doc_id = component_id, null with null included.  Empty tables
    give no rows.

    Bands are made for 80 percent: a pair at exactly that similarity shares none with a probability of
    4e-8, and for one more similar it is smaller.  Nodes are 64-bit hashes of sets.
    """
    own = landed(signed(docs, id_col, text, shingle), "signatures")
    similarity = percent / 100
    classes = own.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("smallest"), F.min(F.struct("ka", "kb")).alias("k"),
        F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        F.first("whole").alias("whole"))
    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("lowest"), F.max("node").alias("highest")).where("lowest < highest")
    members = landed(banded.join(buckets.select("band"), "band"), "buckets")

    involved = members.select("node").distinct()
    held = landed(classes.select("node", "k", "n_shingles", "sketch", "whole").join(involved, "node", "left_semi"), "involved")
    sketches = held.select("node", "n_shingles", "sketch", "whole")
    release(docs.sparkSession)
    texts = landed(docs.select(row_key(id_col, text).alias("k"), F.col(text).alias("text"))
                   .join(held.select("node", "k"), "k").groupBy("node").agg(F.max("text").alias("text")), "texts")

    def near(pairs: DataFrame) -> DataFrame:
        left, right = (sketches.select(*[F.col(c).alias(c + "_" + end) for c in sketches.columns]) for end in "ab")
        both = pairs.join(left, pairs["a"] == left["node_a"]).join(right, pairs["b"] == right["node_b"])
        allowed = bits_of_sets(F.col("n_shingles_a") + F.col("n_shingles_b"), F, similarity)
        return (both.where(different_bits("whole_a", "whole_b") <= allowed)
                .select("a", "b", different_bits("sketch_a", "sketch_b").alias("bits"))
                .where(F.col("bits") <= most_different_bits(similarity)))

    def links(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        return landed(pairs.join(left, "a").join(right, "b").select("a", "b", confirmed(shingle, percent)("ta", "tb").alias("linked"))
                      .where("linked").select("a", "b"), "links")

    def mixed_buckets(roots: DataFrame | None) -> DataFrame:
        """(band, node, root, largest): members of buckets that still have several components."""
        if roots is None:
            labelled = members.withColumn("root", F.col("node"))
        else:
            labelled = members.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
        parts = labelled.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(
            F.count("*").alias("parts"), F.max(F.struct("n", "root"))["root"].alias("largest")).where("parts > 1")
        return landed(labelled.join(parts.select("band", "largest"), "band"), "mixed-buckets")

    def joined(roots: DataFrame | None, new: DataFrame) -> DataFrame:
        return components(new if roots is None else roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(new))

    roots, mixed, turn, before = None, mixed_buckets(None), 0, None
    while True:
        sizes = mixed.groupBy("band").agg(F.count("*").alias("n"), F.sum((F.col("root") != F.col("largest")).cast("long")).alias("m"))
        pairs = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
        if not pairs or before is not None and 2 * pairs > before:  # another round would bring little
            break
        before = pairs
        drawn = F.struct(F.xxhash64(F.lit(turn), "node"), "node", "root")
        inside = F.col("root") == F.col("largest")
        drawn_pair = mixed.groupBy("band").agg(F.min(F.when(inside, drawn)).alias("one"), F.min(F.when(~inside, drawn)).alias("other"))
        met = (mixed.where(~inside).join(drawn_pair, "band").select(F.col("node").alias("b"), "root", F.explode(F.array("one", "other")).alias("x"))
               .where(F.col("x.root") != F.col("root")).select(F.col("x.node").alias("a"), "b").distinct())
        closest = (near(met).groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("bits", "a"))), 1, TRIES).alias("best"))  # at most two per band
                   .select("b", F.explode("best.a").alias("a")))
        new = links(closest)
        turn += 1
        if new.isEmpty():
            break
        roots = joined(roots, new)
        mixed = mixed_buckets(roots)
        release(docs.sparkSession)

    second = links(possible_links(mixed, sizes, held, similarity))
    if roots is None or not second.isEmpty():
        roots = joined(roots, second)

    release(docs.sparkSession)
    rooted = classes.select("node", "smallest").join(roots, "node", "left").select("node", "smallest", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("smallest").alias("lowest"))
    keys = ["root", "k"] if with_keys else []
    named = rooted.join(lowest, "root").select("node", *keys[:1], F.col("lowest").alias("component_id"))
    judged = own.select("doc_id", "n_shingles", "node", *[F.struct(F.col("ka").alias("a"), F.col("kb").alias("b")).alias(c) for c in keys[1:]]).join(named, "node", "left").select(
        "doc_id", "n_shingles", *keys, F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node")
    return judged.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "node", *keys)
