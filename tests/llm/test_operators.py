"""The training-data operators against brute force, on small awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wirelens.llm import (decontaminate, language_model, line_dedup, near_dedup, packing, repetition, sharding, spans, suffix_dedup,
                          token_files, url_rules, word_ids)
from wirelens.llm.queries import QUERIES
from wirelens.llm.settings import LIMITS, tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k string, a int"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 6))).replace(" ", "x") for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, line = say(60), "All Rights Reserved,  Ünïted"
    out = [None, "", " \n\t ", "one", "Ä", "x\n\n x \nx", "a" * 120, "ab" * 300, "same words here " * 40, say(4000)]
    base = say(120)
    for i in range(25):
        w = base.split(" ")
        for _ in range(rnd.randint(0, 14)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        out.append(" ".join(w))
    out += [base] * 30
    out += [say(rnd.randint(3, 200)) + "\n" + ("  " + line.upper() if i % 2 else line) + "\n" + say(20) for i in range(14)]
    out += [say(40) + " " + passage + " " + say(30) for _ in range(6)] + [say(rnd.randint(20, 300)) for _ in range(20)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "r", "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


def test_substrings(docs, texts, empty):
    for gram in (8, 16):
        got = by_id(suffix_dedup.dedup_substrings(docs, gram=gram, with_kept=True), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        first = {}
        raws = [(t or "").encode() for t in texts]
        for i, raw in enumerate(raws):
            for p in range(len(raw) - 49):
                first.setdefault(raw[p:p + 50], i)
        for i, raw in enumerate(raws):
            gone = np.zeros(len(raw) + 1, bool)
            for p in range(len(raw) - 49):
                if first[raw[p:p + 50]] < i:
                    gone[p:p + 50] = True
            kept = bytes(b for b, g in zip(raw, gone) if not g)
            runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
            assert got[i] == (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept)
    assert suffix_dedup.dedup_substrings(empty).count() == 0


def test_substrings_with_null_and_equal_ids(spark):
    t = "".join(random.Random(1).choice("abcdef ") for _ in range(200))
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (7, t), (None, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 99, r["n_removed"]) for r in suffix_dedup.dedup_substrings(df).collect())
    assert got == [(3, 0), (3, 0), (7, 200), (99, 200), (99, 200)]


def test_phrases_around_a_common_string_are_sorted_in_parts(monkeypatch):
    """Each text has its own phrases around the line, with the line's triggers; what they share is sorted once."""
    rnd = random.Random(8)
    say = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    line = say(70)
    texts = [say(200) + line + say(200) for _ in range(400)] + [say(30) + line[:55] + say(40) for _ in range(40)]
    chunk = suffix_dedup.Chunk(pa.table({"doc_id": list(range(len(texts))), "text": texts}), 50, 16)
    raw, first, last = "".join(texts).encode(), chunk.first.tolist(), chunk.last.tolist()
    phrases = [raw[a:b + 50] for a, b in zip(first, last)]
    order = rnd.sample(range(len(phrases)), len(phrases))
    lengths = np.array([len(phrases[i]) for i in order])
    place, ids, sizes = (chunk.trigger - chunk.first)[order], chunk.ids[chunk.row][order], []

    class Counted(spans.SuffixArray):
        def __init__(self, codes, *args, **kw):
            sizes.append(len(codes))
            super().__init__(codes, *args, **kw)
    monkeypatch.setattr(spans, "SuffixArray", Counted)
    entry, runs, windows, values = suffix_dedup.dictionary_minimum(
        np.frombuffer(b"".join(phrases[i] for i in order), np.uint8), lengths, place, ids, 50, 16)
    least = {}
    for i, d in zip(order, ids.tolist()):
        for p in range(len(phrases[i]) - 49):
            w = phrases[i][p:p + 50]
            least[w] = min(d, least.get(w, d))
    begin = np.cumsum(runs) - runs
    for i, e in zip(order, entry.tolist()):
        own = slice(begin[e], begin[e] + runs[e])
        got = np.repeat(values[own], windows[own]).tolist()
        assert got == [least[phrases[i][p:p + 50]] for p in range(len(phrases[i]) - 49)]
    key = Counter(chunk.key.tolist())
    together = sum(len(p) for p, k in {(p, k) for p, k in zip(phrases, chunk.key.tolist()) if key[k] > 1})
    assert together > 40_000 and 0 < sum(sizes) < together / 2


def test_decontamination(spark, docs, texts, empty):
    items = [(1, texts[-25]), (2, "One"), (3, None), (4, "?!"), (None, texts[70]), (1, "zzz never"), (5, texts[-25])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for item, t in items:
        w = rx.findall(lower(t or ""))
        windows |= {("" if item is None else str(item), tuple(w[i:i + 10])) for i in range(max(len(w) - 10, 0) + 1) if w}
    got = by_id(decontaminate.decontaminate(docs, bench), "n_words", "n_hit", "items")
    for i, t in enumerate(texts):
        w = rx.findall(lower(t or ""))
        hit, names = set(), set()
        for name, win in windows:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p:p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    names.add(name)
        assert got[i] == (len(w), len(hit), sorted(names))
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_lines(docs, texts, empty):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    got = by_id(line_dedup.dedup_lines(docs).select("row.doc_id", "n_lines", "n_dropped", "kept_text"), "n_lines", "n_dropped", "kept_text")
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if found[key(x)] < 10]
        assert got[i] == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.dedup_lines(empty).count() == 0


def shingle_set(t, n):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i:i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, texts, empty, size):
    sets = [shingle_set(t, size) for t in texts]
    component = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and 100 * len(a & b) >= 80 * len(a | b) and component[i] != component[j]:
                    low, high = sorted((component[i], component[j]))
                    component = [low if c == high else c for c in component]
                    changed = True
    got = by_id(near_dedup.near_duplicates(docs, shingle=size), "n_shingles", "component_id", "kept")
    assert got == {i: (len(s), component[i], component[i] == i) for i, s in enumerate(sets)}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_one_template(spark):
    """Many texts around the threshold to each other: rounds and blocks together miss no link."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    made = []
    for _ in range(150):
        w = list(base)
        for at in rnd.sample(range(150), rnd.randint(2, 14)):
            w[at] = f"v{rnd.randrange(10 ** 6)}"
        made.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    sets = [shingle_set(t, 2) for t in made]
    parent = list(range(len(made)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    assert by_id(near_dedup.near_duplicates(df, shingle=2), "component_id") == {i: (root(i),) for i in range(len(made))}


def test_groups_of_blocks_are_bounded(spark):
    """A bucket whose members are not linked is copied into many blocks; groups follow the copies."""
    sizes = spark.createDataFrame([(1, 100_000, 99_999), (2, 10, 3)], "band long, n long, m long")
    copies = 99_999 * 49 + 100_000 * 49 + 13
    assert near_dedup.BLOCK == 2048 and near_dedup.bins_for(sizes, 12) * 20_000 >= copies
    assert near_dedup.bins_for(sizes.limit(0), 12) == 12


def test_null_ids_of_near_duplicates(spark):
    t = "some words that are the same in all of these"
    df = spark.createDataFrame([(None, t), (None, t), (None, "x y"), (4, t + " too"), (4, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dedup.near_duplicates(df, shingle=2).collect())
    assert got == [(0, 0, True), (0, 4, False), (0, 4, False), (4, 4, True), (4, 4, True)]


@pytest.mark.parametrize("order, whole", [(2, language_model.WHOLE), (3, language_model.WHOLE), (2, 4), (3, 4), (4, 2)])
def test_language_model(docs, texts, empty, order, whole):
    """With a small ``whole`` contexts of common words are dealt to several buckets."""
    got = by_id(language_model.score_corpus(docs, order=order, whole=whole), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    streams = [[*WORD.findall(lower(t or "")), "</s>"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    train = [s for s, h in zip(streams, held) if not h]
    raw = Counter(w for s in train for w in s)
    total, types = sum(raw.values()), len(raw)
    grams = Counter(tuple((["<s>"] * (order - 1) + s)[i:i + order]) for s in train for i in range(len(s)))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts, context = {}, {}
    for k, counts in levels.items():
        n = [sum(c == i for c in counts.values()) for i in (1, 2, 3, 4)]
        cuts[k] = language_model.discounts(n)
        context[k] = defaultdict(list)
        for g, c in counts.items():
            context[k][g[:-1]].append(c)

    def p(gram):
        k = len(gram)
        lower_p = p(gram[1:]) if k > 1 else 1 / (types + 1)
        seen = context[k].get(gram[:-1])
        if not seen:
            return lower_p
        cut = lambda c: [0, *cuts[k]][min(c, 3)]
        return (max(levels[k][gram] - cut(levels[k][gram]), 0) + sum(cut(c) for c in seen) * lower_p) / sum(seen)
    for i, s in enumerate(streams):
        padded = ["<s>"] * (order - 1) + s
        base = sum(math.log10((raw[w] + .5) / (total + .5 * (types + 1))) for w in s)
        model = sum(math.log10(p(tuple(padded[j:j + order]))) for j in range(len(s)))
        assert got[i][:4] == (held[i], len(s), sum(raw[w] > 0 for w in s), total)
        assert got[i][4] == pytest.approx(base) and got[i][5] == pytest.approx(model)
    assert sum(p((*["<s>"] * (order - 1), w)) for w in [*raw, "unseen"]) == pytest.approx(1)
    assert language_model.score_corpus(empty).count() == 0


def test_language_model_files():
    """Every n-gram of a bucket is found with its context's sums; large counts and contexts are listed apart."""
    rng = np.random.default_rng(4)
    contexts = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    contexts[1] = contexts[0] ^ np.uint64(1)  # agree in all columns but the last
    contexts[2] = contexts[0] ^ np.uint64(1 << 9)
    grams = {(int(c), int(w)): int(n) for c, width in zip(contexts, [300, 1, 2, 16, 17, *rng.integers(1, 40, 695).tolist()])
             for w, n in zip(rng.choice(1 << 20, width, replace=False), rng.choice([1, 1, 1, 2, 3, 254, 255, 256, 70_000], width))}
    rows = [(c, w) for c, w in grams] + [(c, (1 << 20) + 5) for c in contexts.tolist()] + [(int(c) ^ 2, 1) for c in contexts]
    as_columns = lambda r: (np.array([c for c, _ in r], np.uint64), np.array([w for _, w in r], np.int64))
    held = language_model.context_file(*as_columns(list(grams)), np.array(list(grams.values())))
    held = language_model.from_blob(np.frombuffer(language_model.to_blob(held), np.uint8))
    seen = defaultdict(list)
    for (c, _), n in grams.items():
        seen[c].append(n)
    count, group, sums = language_model.search(held, *as_columns(rows))
    got = np.array([count, *sums[:, group]]).T.tolist()
    for (c, w), found in zip(rows, got):
        n = seen.get(c, [])
        assert found == [grams.get((c, w), 0), sum(n), n.count(1), n.count(2), len(n) - n.count(1) - n.count(2)]
    few = language_model.context_file(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    count, _, sums = language_model.search(few, *as_columns(rows))
    assert not count.any() and not sums.any()


def test_registered_language_model_uses_two_words_of_context(spark, tmp_path):
    """After "a b" always c, after "x b" always d: one word of context cannot tell which."""
    train = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = next(i for i in range(60, 99) if zlib.crc32(str(i).encode()) % 5 == 1)
    other = next(i for i in range(held + 1, 199) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(i, "a b c" if i % 2 else "x b d") for i in train] + [(held, "a b c"), (other, "a b d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(QUERIES["op5_lm_scoring"](spark, str(tmp_path)), "held_out", "score")
    assert got[held][0] and got[other][0] and got[held][1] > got[other][1] + 0.5


def encode_all(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def test_packing(docs, texts, empty):
    want = encode_all(texts)
    rows = packing.pack(docs, tokenizer(), with_ids=True).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])] == sorted(r["length"] for r in rows)
    parts = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["length"] == len(ids) and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["doc_tokens"] == len(want[r["doc_id"]])
        parts[r["doc_id"]].append((r["start"], ids.tolist()))
    assert {i: sum((p for _, p in sorted(parts[i])), []) for i in parts} == dict(enumerate(want))
    assert packing.pack(empty, tokenizer()).count() == 0


def test_token_files(spark, docs, texts, empty, tmp_path):
    want, start = encode_all(texts), 0
    files = token_files.write_token_files(docs, f"file://{tmp_path}/t", tokenizer())
    got = {r["doc_id"]: r for r in token_files.read_token_files(files).collect()}
    for i, ids in enumerate(want):
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc)
        start += len(ids)
    done = 0
    for r in sorted(files.collect(), key=lambda r: r["part"]):
        held = token_files.TokenFile.open(r["path"])
        assert [held.tokens(i).tolist() for i in range(held.n)] == want[done:done + held.n]
        done += held.n
    assert token_files.round_trip(empty, tokenizer()).count() == 0
    odd = spark.createDataFrame([(None, "a"), (-5, "b"), (2 ** 62, None), (-5, "b"), (-(2 ** 62), "")], "doc_id long, text string")
    assert [r["doc_id"] for r in sorted(token_files.round_trip(odd, tokenizer()).collect(), key=lambda r: r["start"])] == [None, -(2 ** 62), -5, -5, 2 ** 62]


def test_elias_fano():
    rnd = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 5), (700, 3), (5000, 10 ** 9), (300, 2 ** 62)):
        values = np.sort(rnd.integers(-top, top, n))
        raw, head = token_files.ef_encode(values)
        held = token_files.EliasFano(np.frombuffer(raw, np.uint8), head)
        assert held.all().tolist() == values.tolist() and [held.select(i) for i in range(0, n, 7)] == values[::7].tolist()


def test_word_memory_is_emptied(texts, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(word_ids, "REMEMBERED", 20)
    ids, at = [], [0]
    for _, found, offsets in word_ids.encoded_documents(pa.array(texts + ["İ ǅ ﬁ ́x <|endoftext|> don't", "日本 語"]), tokenizer(), 2):
        ids += found.tolist()
    assert ids == sum(encode_all(texts + ["İ ǅ ﬁ ́x <|endoftext|> don't", "日本 語"]), [])


def test_quality(docs, texts, empty):
    got = {r["row"]["doc_id"]: r["q"] for r in repetition.judge_documents(docs, **LIMITS).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)

        def repeated(n):
            seen = Counter(tuple(w[p:p + n]) for p in range(len(w) - n + 1))
            return {q for p in range(len(w) - n + 1) if seen[tuple(w[p:p + n])] > 1 for q in range(p, p + n)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        longest = max((n for n in range(1, len(w)) if repeated(n)), default=0) if len(w) < 700 else got[i]["longest_repeat"]
        base = len(w) < 20 or 100 * len(repeated(8)) > 30 * len(w)
        covered = sum(len(w[q]) for q in repeated(10))
        chars = sum(map(len, w))
        assert got[i].asDict() == {
            "n_words": len(w), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(repeated(8)), "base_failed": base, "repeated_chars": covered, "longest_repeat": longest,
            "kept": not base and 100 * covered <= 25 * chars and longest <= 200}
    assert repetition.judge_documents(empty).count() == 0


def test_sharding(spark, docs, empty):
    rows = sharding.assign_shards(docs.select("doc_id", "text"), ["doc_id"], 7).collect()
    check_shards(rows, docs.count(), 7)
    copies = spark.range(500).select(F.lit(1).alias("doc_id"), F.when(F.col("id") < 400, "t").alias("text"))
    check_shards(sharding.assign_shards(copies.unionByName(copies.withColumn("doc_id", F.lit(None).cast("int"))), ["doc_id"], 16).collect(), 1000, 16)
    assert sharding.assign_shards(empty, ["doc_id"]).count() == 0


def check_shards(rows, n, shards):
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
    sizes = [len(places[s]) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_sharding_of_a_shared_key_is_ranked_in_parts(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 450).cast("string")).alias("text"))
    placed = sharding.assign_shards(df, ["doc_id"], 7)
    check_shards(placed.collect(), 900, 7)
    assert "salt" in placed._jdf.queryExecution().optimizedPlan().toString()


def test_written_shards_with_clashing_names(spark, tmp_path):
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("x").alias("shard"), F.lit(5).alias("slot"))
    sharding.write_shards(df, str(tmp_path / "out"), ["doc_id"], 4, 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == ["doc_id", "text", "shard", "slot", "shard_"] and back.select("doc_id", "text").distinct().count() == 60
    assert sorted(r["count"] for r in back.groupBy("shard_").count().collect()) == [15] * 4


def thue_morse_pair(n=1024):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_a_polynomial_takes_for_the_same(spark):
    one, two = thue_morse_pair()
    df = spark.createDataFrame([(1, one), (2, two), (3, f"x {one}\nx {two}"), (4, one)], "doc_id long, text string")
    assert by_id(near_dedup.near_duplicates(df, shingle=2), "component_id") == {1: (1,), 2: (2,), 3: (3,), 4: (1,)}
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokenizer())
    ids = {r["doc_id"]: r["ids_crc32"] for r in token_files.round_trip(df, tokenizer()).collect()}
    for i, t in ((1, one), (2, two), (4, one)):
        want = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert ids[i] == zlib.crc32(want.tobytes())
    judged = {r["doc_id"]: r["n_dup_lines"] for r in repetition.judge_documents(df, **LIMITS).select("row.doc_id", "q.n_dup_lines").collect()}
    assert judged == dict.fromkeys((1, 2, 3, 4), 0)
    scored = {r["doc_id"]: r["n_known"] for r in language_model.score_corpus(df, order=2).select("doc_id", "n_known", "held_out").collect()}
    assert len(scored) == 4


@pytest.mark.parametrize("length", [250, 300])
def test_substrings_of_other_lengths(spark, length):
    rnd = random.Random(length)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 400))) + shared[rnd.randint(0, 300):rnd.randint(500, 900)] + "z" * i for i in range(8)]
    first, want = {}, {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p:p + length], i)
    for i, t in enumerate(texts):
        want[i] = len({q for p in range(len(t) - length + 1) if first[t[p:p + length]] < i for q in range(p, p + length)})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {k: v[0] for k, v in by_id(suffix_dedup.dedup_substrings(df, length=length), "n_removed").items()} == want and sum(want.values()) > 1000


def test_ring_moves_little():
    orders = sharding.ring(16)
    counts = dict.fromkeys(range(sharding.SLOTS), 10)
    loose = sharding.fill(counts, orders, sharding.bounds(40960, 16, 2.0))
    assert sum(p[3] - p[2] for p in loose) == 40960
    assert all(orders[p[0]][0] == p[1] for p in loose)  # nobody is displaced under a loose bound
    grown = sharding.ring(17)
    assert sum(a[0] != b[0] for a, b in zip(orders, grown)) < 3 * sharding.SLOTS / 17
    assert all(b[0] == 16 for a, b in zip(orders, grown) if a[0] != b[0])


def test_urls(spark):
    urls = [(i, f"https://{'bad' if i % 4 == 0 else 'shop'}.site.io/{'ads' if i % 3 == 0 else 'x'}/{i}?u={i}") for i in range(200)]
    urls += [(500, None), (501, "nothing"), (502, "HTTP://A.Example.NET/en/q#f"), (503, "x://net"), (504, "x://net/"), (505, "y://o.org/fr/?a"), (1, urls[1][1])]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("k", F.lit(0)).withColumn("row", F.lit(1))
    labels = spark.createDataFrame([(i, None if i == 3 else 1, int(i % 4 == 0)) for i in range(0, 150)], "doc_id long, quality int, toxic int")
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("allow", "org", "/fr/")]
    got = [(r["row"]["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, labels, rules).collect()]
    assert len(got) == len(urls)
    verdict = {g[0]: g[1:] for g in got}
    assert all(verdict[i][3] == ("block" if i % 4 == 0 else "allow") for i in range(200))
    assert verdict[500] == verdict[501] == ("", "", None, "allow")
    assert verdict[502] == ("a.example.net", "/en/q", "example.net/en/", "allow")
    assert verdict[503] == ("net", "", None, "allow") and verdict[504] == ("net", "/", "net/", "block")
    assert verdict[505] == ("o.org", "/fr/", "org/fr/", "allow")
    assert url_rules.judge_urls(pages.limit(0), labels, rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(pages.where("page_id < 9"), labels.limit(0), rules).collect()} == {"allow"}


def test_suffix_array_sorts():
    rnd = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 400):
        codes = rnd.integers(0, 3, n).astype(np.uint64)
        order = spans.SuffixArray(codes, np.full(n, n)).order.tolist()
        assert order == sorted(range(n), key=lambda i: codes[i:].tolist())


def test_near_dedup_stage_takes_five_words(spark, sf):
    """A word in thirty replaced: alike on pairs of words, not on five words."""
    a = [f"w{i}" for i in range(300)]
    b = [f"x{i}" if i % 30 == 15 else w for i, w in enumerate(a)]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join([*a, "end"]))], "doc_id long, text string")
    got = {r[0] for r in corpus_pipeline.near_dedup_stage(spark, df, sf).collect()}
    assert near_dedup.near_duplicates(df, shingle=2).where("kept").count() == 1 and got == {1, 2}


def test_near_dedup_stage_with_null_and_equal_ids(spark, sf):
    say = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(None, say("a")), (None, say("a") + " more"), (None, say("b")), (7, say("b") + " more"), (None, say("c")), (None, say("c")),
            (8, say("d")), (8, say("e")), (8, say("e") + " more"), (9, say("f")), (9, say("f")), (None, None), (5, "")]
    df = spark.createDataFrame([(*r, f"s{i}") for i, r in enumerate(rows)], "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.near_dedup_stage(spark, df, sf).collect()]
    groups = Counter((t or "")[:1] for _, t, _ in got)
    assert groups == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1, "": 2}
    assert {(i, t[:1]) for i, t, _ in got if t} == {(None, "a"), (7, "b"), (None, "c"), (8, "d"), (8, "e"), (9, "f")}


def test_pipeline(spark, sf, tmp_path):
    """The stages keep the columns of documents, and each does to its own input what its operator says."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] == sizes[2] > sizes[-1] > 0
    final = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = dict(zip(final, encode_all(list(final.values()))))
    total = Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        part = want[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        total[r["doc_id"]] += r["length"]
    assert total == Counter({i: len(ids) for i, ids in want.items()})


def test_components_take_one_checkpoint_a_round(spark, monkeypatch):
    """The driver keeps something of each plan that it runs, so rounds are few and of one plan."""
    rnd, calls, cut = random.Random(2), [], near_dedup.cut_lineage
    monkeypatch.setattr(near_dedup, "cut_lineage", lambda df: (calls.append(1), cut(df))[1])
    order = rnd.sample(range(100), 100)
    for edges, most in [([(3, 3)], 2), ([(-7, i) for i in range(50)], 2), (list(zip(order, order[1:])), 9),
                        ([(rnd.randrange(150), rnd.randrange(150)) for _ in range(90)], 9)]:
        up = {x: x for e in edges for x in e}
        for a, b in edges * len(up):  # labels sink along the edges
            up[a] = up[b] = min(up[a], up[b])
        calls.clear()
        got = [tuple(r) for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()]
        assert sorted(got) == sorted((x, r) for x, r in up.items() if x != r)
        assert len(calls) <= most
