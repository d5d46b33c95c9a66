"""Every row of op10 and of the pipeline against plain Python."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from wirelens.llm import sharding
from wirelens.llm.queries import QUERIES
from wirelens.llm.settings import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ring_slot(doc_id):
    """The top-level hash of a key: its value (a null has none), then whether it is null."""
    seed = 42
    if doc_id is not None:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed)
    return xxhash.xxh64_intdigest(struct.pack("<i", doc_id is None), seed) % 4096


def walk(slot, shards):
    """Shards in the order in which a walk clockwise from the beginning of a slot meets their nodes."""
    nodes = sorted((int.from_bytes(hashlib.blake2b(f"{s}:{n}".encode(), digest_size=8).digest(), "big"), s)
                   for s in range(shards) for n in range(64))
    begin = slot << 52  # 2 ** 64 / 4096 to a slot
    return list(dict.fromkeys(s for _, s in [x for x in nodes if x[0] >= begin] + [x for x in nodes if x[0] < begin]))


def test_sharding_query_against_an_own_ring(spark, tmp_path):
    """Shard by shard, every ring slot sends as many rows as a plain walk with full shards passed over."""
    rnd = random.Random(9)
    rows = [(i, rnd.choice([None, "", "a", "é" * 9, f"text {i}"])) for i in range(2500)]
    rows += [(77, "one key")] * 400 + [(77, f"one key {i}") for i in range(300)] + [(None, None)] * 50 + [(-5, "x"), (2 ** 62, "y")]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_sharding"](spark, str(tmp_path)).collect()
    own = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len(own(t)) + 1, zlib.crc32(own(t))) for i, t in rows)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    left = Counter(ring_slot(i) for i, _ in rows)
    routes = {s: walk(s, 16) for s in left}
    room = [len(rows) // 16 + (s < len(rows) % 16) for s in range(16)]
    want = Counter()
    for near in range(16):
        for slot in sorted(left):
            shard = routes[slot][near]
            n = min(left[slot], room[shard])
            left[slot] -= n
            room[shard] -= n
            want[slot, shard] += n
    assert not any(left.values())
    assert Counter((ring_slot(r["doc_id"]), r["shard"]) for r in got) == +want
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) == 16


def test_loose_bounds_leave_keys_with_their_nearest_shard(spark):
    keys = [*range(3000), None]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    got = {r["row"]["doc_id"]: r["shard"] for r in sharding.assign_shards(df, ["doc_id"], 5, load=4.0).collect()}
    assert got == {k: walk(ring_slot(k), 5)[0] for k in keys}


def quality(rows):
    def kept(t):
        w = WORD.findall(t or "")

        def repeated(n):
            seen = Counter(tuple(w[p:p + n]) for p in range(len(w) - n + 1))
            return {q for p in range(len(w) - n + 1) if seen[tuple(w[p:p + n])] > 1 for q in range(p, p + n)}
        return (len(w) >= 20 and 100 * len(repeated(8)) <= 30 * len(w) and not repeated(201)
                and 100 * sum(len(w[q]) for q in repeated(10)) <= 25 * sum(map(len, w)))
    return [r for r in rows if kept(r["text"])]


def lines(rows):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    found = Counter(k for r in rows for k in {key(x) for x in (r["text"] or "").split("\n")} if k)
    out = []
    for r in rows:
        own = (r["text"] or "").split("\n")
        kept = [x for x in own if found[key(x)] < 10]
        new = "\n".join(kept)
        out.append(r if len(kept) == len(own) else {**r, "text": new, "n_chars": len(new)})
    return out


def near(rows):
    def shingles(t):
        w = WORD.findall((t or "").translate(LOWER))
        return {tuple(w[p:p + 5]) for p in range(max(len(w) - 5, 0) + 1)} if w else set()
    sets, root = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and root[i] != root[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    out, groups = [r for r, s in zip(rows, sets) if not s], defaultdict(list)
    for r, s, x in zip(rows, sets, root):
        if s:
            groups[x].append(r)
    return out + [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]


def clean(rows, items):
    def windows(t, n=10):
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        return {tuple(w[p:p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w and n == 10 else set()
    wanted = set().union(*(windows(t) for t in items))
    sizes = {len(w) for w in wanted}
    return [r for r in rows if not any(windows(r["text"], n) & wanted for n in sizes)]


def packed(rows):
    from tokenizers import Tokenizer
    encode, out = Tokenizer.from_file(tokenizer()), []
    for r in rows:
        ids, start = [*encode.encode(r["text"] or "", add_special_tokens=False).ids, 2], 0
        for size in [4096] * (len(ids) // 4096) + [1 << b for b in range(11, -1, -1) if len(ids) % 4096 >> b & 1]:
            crc = zlib.crc32(np.array(ids[start:start + size], "<u4").tobytes())
            out.append((r["doc_id"], start, size, crc, len(ids), 0))
            start += size
    return Counter(out)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with null and repeated ids, equal rows, columns of awkward names, and something for every stage."""
    rnd = random.Random(21)
    vocabulary = ["".join(rnd.choice("abcdeéGH") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, line = say(25), "All Rights Reserved,  Ünïted"
    made = [None, "", " \n\t ", "one", "same words here " * 60, say(19), say(20), say(21), say(9000)]
    block = say(45)
    made += [block + " " + say(n) + " " + block for n in (100, 200, 260, 280, 400)]  # around the share that may be repeated
    made += [say(214)]
    long_run = say(201)
    made += [long_run + " " + say(2500) + " " + long_run, long_run[:200] + " " + say(2500) + " " + long_run[:200]]
    for _ in range(3):
        base = say(150)
        for _ in range(8):
            w = base.split(" ")
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(150)] = rnd.choice(vocabulary)
            made.append(" ".join(w))
    made += [say(30) + "\n" + (f"  {line.replace('Rights', 'RIGHTS')}\t" if i % 2 else line) + "\n" + say(20) for i in range(12)]
    made += [say(30) + "\nseen in nine\n" + say(10) for _ in range(9)]
    made += [say(40) + " " + (passage.translate({b: a for a, b in LOWER.items()}) if i % 2 else passage) + "! " + say(30) for i in range(4)] + [say(30) + " rare-item " + say(9)]
    made += [say(rnd.randint(20, 200)) for _ in range(30)]
    ids = list(range(len(made)))
    rnd.shuffle(ids)
    rows = list(zip(ids, made))
    twin, other = say(60), say(60)
    rows += [(None, say(50)), (None, say(70)), (None, twin), (None, twin), (500, other), (500, other), (500, say(44)), (500, None), (None, None)]
    rnd.shuffle(rows)
    full = [{"doc_id": i, "text": t, "lang": "en", "source": "hot" if len(t or "") % 3 else None, "n_chars": len(t) if t is not None else None,
             "kept_key": 1, "hit_key": "h", "row": "r", "k": None, "n": 4, "node": 5} for i, t in rows]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, kept_key int, hit_key string, row string, k string, "
              "n int, node int")
    items = [(1, say(3) + " " + passage), (2, "rare ITEM"), (3, None), (4, "?!"), (None, "never " + say(12)), (1, "")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([tuple(r.values()) for r in full], schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, full, [t for _, t in items], schema


def test_pipeline_against_plain_python(spark, corpus):
    """Each stage on what plain Python has kept before it, and run() as a whole: not a row more, not a row less."""
    folder, rows, items, schema = corpus
    plain = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", lambda r: clean(r, items))]
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == [name for name, _ in plain] + ["packing"]
    for name, by_hand in plain:
        df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
        kept = by_hand(rows)
        got = stages[name](spark, df, folder)
        assert got.columns == df.columns, name
        assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r.values()) for r in kept), name
        assert kept != rows, name  # every stage has something to do
        rows = kept
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["offset"]) for r in out) == packed(rows)
    assert sorted(r["sequence_id"] for r in out) == list(range(len(out)))


def test_stages_of_an_empty_table(spark, corpus):
    folder, _, _, schema = corpus
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_null_texts_and_ties_in_every_stage(spark, corpus):
    """Where each stage is given null and empty texts alone, quality drops them and the others keep every row."""
    folder, _, _, schema = corpus
    df = spark.createDataFrame([(i, t, *[None] * 9) for i, t in [(1, None), (1, None), (None, ""), (2, " \n")]], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, folder).count() == (0 if name == "quality_rules" else 4), name
    assert corpus_pipeline.packing_stage(spark, df.withColumn("text", F.lit(None).cast("string")), folder).count() == 4
