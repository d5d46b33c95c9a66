"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and scored from mapped files.

Words are counted first and numbered, frequent ones low.  Then tasks count the n-grams of their documents and send
them, as sorted and compressed arrays, to the bucket of their context; a bucket adds them up and writes one
file: sorted context hashes, and for each context its followers and their counts.  From its distinct n-grams it sends
on what the next lower order needs, how many words precede each (n-1)-gram.  An n-gram is sent once per task, so
frequent words do not make large groups.  A context that may hold more than ``WHOLE`` tokens (its rarest word has
that many) is dealt to several buckets by its followers, and the sums over them meet in files of their own.

Scoring: workers map the files of the buckets they need and look the n-grams of some documents up by binary
search.  On file systems that cannot be mapped a bucket is read instead.
"""

import functools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from wirelens.llm import spans
from wirelens.llm.common import file_system, parts_for, publish, text_bytes
from wirelens.session import scratch_folder, ship_package

BEGIN, END = np.uint64(1), np.uint64(2)  # the marks around a text; words have 64-bit hashes
SCORED = 4 << 20  # bytes of text scored together; more of them share what they look up
HELD, BUCKET = 2_500_000, 32 << 20  # tokens a task counts before it sends; bytes of text per bucket, times the order
WHOLE = 1 << 18  # tokens of one context up to which one bucket takes all of them
KEY = (4, 2, 1)  # bytes of a context's hash inside its bucket, by column
BLOCK, FEW, LARGE = 256, 16, 255  # contexts that share a base; followers added up when asked for; counts kept apart
UNKNOWN = -1
SENT = "kind string, bucket int, blob binary, stats array<long>"


def streams(data: np.ndarray, offsets: np.ndarray, order: int):
    """Symbols of one slice (each text between marks), their document, and which are tokens to predict."""
    data = spans.LOWER[data]
    starts, ends, doc = spans.words(data, offsets)
    n, pads = len(offsets) - 1, order - 1
    count = np.bincount(doc, minlength=n)
    size = count + pads + 1
    stop = np.cumsum(size)
    symbols = np.full(int(stop[-1]) if n else 0, BEGIN, np.uint64)
    symbols[stop - 1] = END
    symbols[np.repeat(stop - size + pads, count) + spans.ragged(count)] = spans.SpanHash(data)(starts, ends)
    of = np.repeat(np.arange(n), size)
    return symbols, of, spans.ragged(size) >= pads


def chain(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of a tuple of word numbers; of one, the mixed number."""
    key = spans.mix(columns[0].astype(np.uint64))
    for c in columns[1:]:
        key = spans.pair(key, c.astype(np.uint64))
    return key


def dealt(own: list[np.ndarray], counts: list[np.ndarray], whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context hash, hash that names the bucket, whether the context is split) of n-grams; ``counts`` of their words."""
    context = chain(own[:-1])
    share = 1 + functools.reduce(np.minimum, counts[:len(own) - 1]) // whole
    split = share > 1
    key = context.copy()
    key[split] = spans.pair(context[split], spans.mix(own[-1][split].astype(np.uint64)) % share[split].astype(np.uint64))
    return context, key, split


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def narrow(values: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds the values."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def to_blob(columns: list[np.ndarray]) -> bytes:
    head = json.dumps([[c.dtype.str, len(c)] for c in columns]).encode()
    return len(head).to_bytes(8, "little") + head + b"".join(c.tobytes() for c in columns)


def from_blob(raw: np.ndarray) -> list[np.ndarray]:
    size = int.from_bytes(raw[:8].tobytes(), "little")
    at, out = 8 + size, []
    for kind, n in json.loads(raw[8:at].tobytes()):
        width = n * np.dtype(kind).itemsize
        out.append(raw[at:at + width].view(kind))
        at += width
    return out


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns on their way to a bucket: rising hashes as differences, bytes of one weight together, compressed."""
    def planes(c):
        c = np.diff(c, prepend=np.uint64(0)) if c.dtype == np.uint64 else c
        return np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).reshape(-1).view(c.dtype)
    raw = to_blob([planes(c) for c in columns])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: pa.Buffer) -> list[np.ndarray]:
    size = int.from_bytes(blob[:8].to_pybytes(), "little")
    out = []
    for c in from_blob(np.frombuffer(pa.decompress(blob[8:], size, codec="zstd"), np.uint8)):
        c = np.ascontiguousarray(c.view(np.uint8).reshape(c.itemsize, len(c)).T).reshape(-1).view(c.dtype)
        out.append(np.cumsum(c, dtype=np.uint64) if c.dtype == np.uint64 else c)
    return out


def added_up(key: np.ndarray, symbols: list[np.ndarray], sums: list[np.ndarray] | None):
    """Rows of one key made one: sorted keys, their symbols, added numbers (None: the number of rows)."""
    by = np.argsort(key)
    key = key[by]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(fresh)
    if sums is None:
        add = [np.diff(np.append(begin, len(key)))]
    else:
        add = [np.add.reduceat(s[by].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64) for s in sums]
    return key[begin], [s[by[begin]] for s in symbols], add


def parcels(kind: str, key: np.ndarray, columns: list[np.ndarray], buckets: int, by: np.ndarray | None = None) -> list[tuple]:
    """Rows to send: ``columns`` cut by the bucket of ``key``, inside a bucket in the order of ``by``."""
    place = bucket_of(key, buckets)
    order = np.argsort(place, kind="stable") if by is None else np.lexsort((by, place))
    edges = np.searchsorted(place[order], np.arange(buckets + 1))
    return [(kind, b, packed([narrow(c[o]) if c.dtype == np.int64 else c[o] for c in columns]), None)
            for b in np.flatnonzero(np.diff(edges)).tolist() for o in [order[edges[b]:edges[b + 1]]]]


def gram_parcels(own: list[np.ndarray], count: np.ndarray, words: "Vocabulary", counts: list[np.ndarray] | None = None) -> list[tuple]:
    """N-grams to send, inside a bucket in rising order of their first words, which neighbours then share."""
    buckets = words.buckets
    if len(own) == 1:
        place = (own[0] - 1) % buckets
    else:
        place = bucket_of(dealt(own, counts or words.counts(own[:-1]), words.whole)[1], buckets)
    order = np.argsort(own[0] if len(own) == 1 else (own[0] << 32) + own[1])
    order = order[np.argsort(narrow(place[order]), kind="stable")]
    edges = np.searchsorted(place[order], np.arange(buckets + 1))
    return [(f"grams{len(own)}", b, packed([own[0][o].astype(np.uint64), *[narrow(c[o]) for c in (*own[1:], count)]]), None)
            for b in np.flatnonzero(np.diff(edges)).tolist() for o in [order[edges[b]:edges[b + 1]]]]


def cut_up(values: np.ndarray, widths: tuple) -> list[np.ndarray]:
    """Columns of a few bytes each, the high one first."""
    left, out = 8 * sum(widths), []
    for w in widths:
        left -= 8 * w
        out.append(((values >> np.uint64(left)) & np.uint64((1 << 8 * w) - 1)).astype(f"u{w}"))
    return out


def context_file(context: np.ndarray, last: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """The arrays of a bucket: contexts by hash, where their followers begin, followers with counts, sums of large ones."""
    key = context & np.uint64((1 << 8 * sum(KEY)) - 1)
    by = np.lexsort((last, key))
    key, last, count = key[by], last[by], count[by]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(fresh)
    edges = np.append(begin, len(key))
    base = edges[::BLOCK]
    busy = np.flatnonzero(np.diff(edges) > FEW)
    sums = [np.add.reduceat(x.astype(np.int64), begin)[busy] for x in (count, count == 1, count == 2)]
    large = np.flatnonzero(count >= LARGE)
    return [*cut_up(key[begin], KEY), narrow(base), narrow(edges - np.repeat(base, BLOCK)[:len(edges)]), narrow(last >> 16),
            (last & 0xFFFF).astype(np.uint16), np.minimum(count, LARGE).astype(np.uint8), narrow(large), narrow(count[large]),
            narrow(busy), *map(narrow, sums)]


def listed(places: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each asked place, all of which are in the rising list."""
    return values[np.searchsorted(places, asked)].astype(np.int64)


def follower_counts(held: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    out = held[7][at].astype(np.int64)
    large = np.flatnonzero(out == LARGE)
    out[large] = listed(held[8], held[9], at[large])
    return out


def search(held: list[np.ndarray], context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of n-grams of one bucket, their contexts' places in the third array, and these contexts' sums.

    The sums are the total and the numbers of followers seen once, twice, more often; all is 0 where unknown.
    """
    fresh = np.ones(len(context), bool)
    fresh[1:] = context[1:] != context[:-1]
    group = np.cumsum(fresh) - 1  # neighbours often ask for one context
    own = cut_up(context[fresh], KEY)
    at = np.searchsorted(held[0], own[0])
    found, open_ = np.zeros(len(at), bool), np.arange(len(at))
    while len(open_):  # contexts whose first columns agree lie side by side
        open_ = open_[at[open_] < len(held[0])]
        open_ = open_[held[0][at[open_]] == own[0][open_]]
        same = (held[1][at[open_]] == own[1][open_]) & (held[2][at[open_]] == own[2][open_])
        found[open_[same]] = True
        open_ = open_[~same]
        at[open_] += 1
    count, sums = np.zeros(len(context), np.int64), np.zeros((4, len(at)), np.int64)
    known = np.flatnonzero(found)
    if not len(known):
        return count, group, sums
    at = at[known]
    begin, end = np.zeros((2, len(found)), np.int64)
    begin[known], end[known] = (held[3][i // BLOCK].astype(np.int64) + held[4][i] for i in (at, at + 1))
    size = (end - begin)[known]
    few, many = np.flatnonzero(size <= FEW), np.flatnonzero(size > FEW)
    of = np.repeat(known[few], size[few])
    c = follower_counts(held, begin[of] + spans.ragged(size[few]))
    for x, values, each in zip(sums, (c, c == 1, c == 2), held[11:]):
        x[:] = np.bincount(of, values, len(x))
        x[known[many]] = listed(held[10], each, at[many])
    sums[3] = end - begin - sums[1] - sums[2]
    open_ = np.flatnonzero(found[group])
    lo, hi, sought = begin[group[open_]], end[group[open_]], last[open_]
    while len(open_):  # binary search; rows that found their word or have no followers left are done
        mid = (lo + hi) >> 1
        there = held[5][mid].astype(np.int64) << 16 | held[6][mid]
        hit = there == sought
        count[open_[hit]] = follower_counts(held, mid[hit])
        less = there < sought
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        go = np.flatnonzero(~hit & (lo < hi))
        open_, lo, hi, sought = open_[go], lo[go], hi[go], sought[go]
    return count, group, sums


def as_table(rows: list[tuple]) -> pa.Table:
    kinds = [("kind", pa.string()), ("bucket", pa.int32()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64()))]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds)})


@functools.lru_cache(maxsize=512)
def table(folder: str, kind: str, bucket: int) -> list[np.ndarray] | None:
    """The arrays of one bucket, mapped where the file system allows it; None if it has no file."""
    fs, base = file_system(folder)
    path = f"{base}/{kind}/{bucket:06d}"
    if fs.get_file_info(path).type.name != "File":
        return None
    if fs.type_name == "local":
        return from_blob(np.memmap(path, np.uint8, "r").view(np.ndarray))
    with fs.open_input_file(path) as f:
        return from_blob(np.frombuffer(f.read_buffer(), np.uint8))


def look_up(folder: str, kind: str, buckets: int, key: np.ndarray, width: int) -> list[np.ndarray]:
    """``width`` numbers for each of the rising keys; 0 where a key is not in the model."""
    out = [np.zeros(len(key), np.int64) for _ in range(width)]
    place = bucket_of(key, buckets)
    edges = np.searchsorted(place, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        lo, hi = edges[b], edges[b + 1]
        held = table(folder, kind, b)
        if held is None:
            continue
        at = np.minimum(np.searchsorted(held[0], key[lo:hi]), len(held[0]) - 1)
        hit = held[0][at] == key[lo:hi]
        for o, values in zip(out, held[1:]):
            o[lo:hi][hit] = values[at[hit]]
    return out


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times (fixed ones if a number is 0)."""
    if min(n[:4]) == 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.0), k + 1.0) for k in range(3)]


@dataclass
class Vocabulary:
    """The numbered words of a folder: of bucket b, rank r has the number 1 + r * buckets + b; 0 is the mark of a beginning."""
    folder: str
    buckets: int
    tokens: int = 0
    types: int = 0
    texts: int = 0
    whole: int = WHOLE

    def counts(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        return [self.of_rank("words", x) for x in ids]

    def numbers(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each symbol; a beginning counts as often as there are texts."""
        each, back = np.unique(spans.mix(symbols), return_inverse=True)
        ids, counts = np.full(len(each), UNKNOWN), np.zeros(len(each), np.int64)
        for b, rows in by_bucket(bucket_of(each, self.buckets), self.buckets):
            held = table(self.folder, "words", b)
            if held is None:
                continue
            at = np.minimum(np.searchsorted(held[0], each[rows]), len(held[0]) - 1)
            hit = held[0][at] == each[rows]
            rank = held[1][at[hit]].astype(np.int64)
            ids[rows][hit] = 1 + rank * self.buckets + b
            counts[rows][hit] = held[2][rank]
        ids, counts = ids[back], counts[back]
        first = symbols == BEGIN
        ids[first], counts[first] = 0, self.texts
        return ids, counts

    def of_rank(self, kind: str, ids: np.ndarray) -> np.ndarray:
        """What the files of ``kind`` hold at the rank of each number; the number of texts for a beginning, 0 if unknown."""
        out = np.where(ids == 0, self.texts, 0)
        known = np.flatnonzero(ids > 0)
        place = narrow((ids[known] - 1) % self.buckets)
        order = np.argsort(place, kind="stable")
        for b, rows in by_bucket(place[order], self.buckets):
            held = table(self.folder, kind, b)
            if held is not None:
                mine = known[order[rows]]
                out[mine] = held[-1][(ids[mine] - 1) // self.buckets]
        return out


def by_bucket(place: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The rows of each bucket, for rising places."""
    edges = np.searchsorted(place, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, slice(edges[b], edges[b + 1])


@dataclass
class Model:
    """What workers need besides the files; its size does not depend on the corpus."""
    words: Vocabulary
    order: int
    cut: dict[int, list[float]]
    unigrams: list[int]  # of continuation counts: seen once, twice, 3 times, 4 times, types, total

    @property
    def train_tokens(self) -> int:
        return self.words.tokens

    @property
    def train_types(self) -> int:
        return self.words.types


def written(folder: str, kind: str, bucket: int, columns: list[np.ndarray]) -> None:
    fs, base = file_system(folder)
    raw = to_blob(columns)
    publish(fs, f"{base}/{kind}/{bucket:06d}", f"{TaskContext.get().taskAttemptId()}", lambda out: out.write(raw))


def received_columns(received: pa.Table) -> list[np.ndarray]:
    parts = [unpacked(b.as_buffer()) for b in received.column("blob")]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))]


def summed(sent: DataFrame) -> dict[str, list[int]]:
    """Statistics of all buckets by kind; one row per kind reaches the driver."""
    done = sent.where(F.col("kind").startswith("done-")).groupBy("kind").agg(F.array(*[
        F.sum(F.coalesce(F.try_element_at("stats", F.lit(i + 1)), F.lit(0))) for i in range(6)]).alias("s"))
    return {r["kind"].removeprefix("done-"): list(r["s"]) for r in done.collect()}


def fit_words(texts: DataFrame, folder: str, buckets: int, whole: int) -> Vocabulary:
    """Count and number the words of all texts."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted():
            word, _, (c,) = added_up(np.concatenate([h[0] for h in held]), [], [np.concatenate([h[1] for h in held])])
            held.clear()
            key = spans.mix(word)
            return as_table(parcels("words", key, [key, c], buckets, key)).to_batches()
        for batch in batches:
            for _, _, data, offsets in spans.slices(batch.column(0)):
                symbols, _, token = streams(data, offsets, 1)
                held.append(np.unique(symbols[token], return_counts=True))
                n += len(held[-1][0])
                if n >= HELD:
                    yield from counted()
                    n = 0
        if held:
            yield from counted()

    def merge(received: pa.Table) -> pa.Table:
        bucket = received.column("bucket")[0].as_py()
        key, count = received_columns(received)
        key, _, (count,) = added_up(key, [], [count])
        order = np.lexsort((key, -count))
        rank = np.empty(len(key), np.int64)
        rank[order] = np.arange(len(key))
        written(folder, "words", bucket, [key, narrow(rank), narrow(count[order])])
        ends = count[key == spans.mix(np.array([END]))]
        return as_table([("done-words", bucket, None, [len(key), int(count.sum()), int(ends.sum())])])

    sent = texts.mapInArrow(send, SENT).groupBy("kind", "bucket").applyInArrow(merge, SENT)
    types, tokens, marks = summed(sent).get("words", [0, 0, 0])[:3]
    return Vocabulary(folder, buckets, tokens, types, marks, whole)


def fit(docs: DataFrame, text: str = "text", order: int = 3, whole: int = WHOLE) -> Model:
    """Count all texts of ``docs``; a null text is empty and still has its end mark.  ``whole`` changes no number."""
    if order < 2:
        raise ValueError("the model needs an order of at least 2")
    spark = docs.sparkSession
    ship_package(spark)
    folder, buckets = scratch_folder(spark, "ngrams"), parts_for(spark, text_bytes(docs, text), BUCKET // order)
    texts = docs.select(F.col(text).alias("text"))
    words = fit_words(texts, folder, buckets, whole)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted():
            columns = [np.concatenate([h[i] for h in held]) for i in range(2 * order - 1)]
            held.clear()
            _, own, (c,) = added_up(chain(columns[:order]), columns, None)
            columns.clear()
            return as_table(gram_parcels(own[:order], c, words, own[order:])).to_batches()
        for batch in batches:
            for _, _, data, offsets in spans.slices(batch.column(0)):
                symbols, _, token = streams(data, offsets, order)
                (ids, counts), at = words.numbers(symbols), np.flatnonzero(token)
                held.append([x[at - order + 1 + i] for x, width in ((ids, order), (counts, order - 1)) for i in range(width)])
                n += len(at)
                if n >= HELD:
                    yield from counted()
                    n = 0
        if held:
            yield from counted()

    def merge(received: pa.Table) -> pa.Table:
        kind, bucket = received.column("kind")[0].as_py(), received.column("bucket")[0].as_py()
        if kind.startswith("done"):
            return received
        columns = received_columns(received)
        if kind.startswith("sums"):
            key, _, sums = added_up(columns[0], [], columns[1:])
            written(folder, kind, bucket, [key, *map(narrow, sums)])
            return as_table([])
        columns, rows = [c.astype(np.int64) for c in columns], []
        own, count = columns[:-1], columns[-1]
        k = len(own)
        _, own, (count,) = added_up(chain(own), own, [count])
        if k == 1:
            dense = np.zeros(int(own[0].max() - 1) // buckets + 1, np.int64)
            dense[(own[0] - 1) // buckets] = count
            written(folder, kind, bucket, [narrow(dense)])
        else:
            context, _, split = dealt(own, words.counts(own[:-1]), words.whole)
            written(folder, kind, bucket, context_file(context, own[-1], count))
            if split.any():
                c = count[split]
                key, _, sums = added_up(context[split], [], [c, c == 1, c == 2, c > 2])
                rows += parcels(f"sums{k}", key, [key, *sums], buckets)
            _, lower, (left,) = added_up(chain(own[1:]), own[1:], None)
            rows += gram_parcels(lower, left, words)
        stats = [int((count == i).sum()) for i in (1, 2, 3, 4)] + [len(count), int(count.sum())]
        return as_table(rows + [(f"done-{kind}", bucket, None, stats)])

    sent = texts.mapInArrow(send, SENT)
    for _ in range(order):
        sent = sent.groupBy("kind", "bucket").applyInArrow(merge, SENT)
    total = summed(sent)
    nothing = [0] * 6
    return Model(words, order, {k: discounts(total.get(f"grams{k}", nothing)) for k in range(1, order + 1)}, total.get("grams1", nothing))


def interpolation(model: Model, own: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The discounted share of each n-gram in its context, and the weight of the lower order there (1: context unknown)."""
    k, words = len(own), model.words
    cut = np.array([0.0, *model.cut[k]])
    context, key, split = dealt(own, counts, words.whole)

    def parts(c, group, sums):
        whole = np.maximum(sums[0], 1)
        weight = np.where(sums[0] > 0, (cut[1] * sums[1] + cut[2] * sums[2] + cut[3] * sums[3]) / whole, 1.0)
        return np.maximum(c - cut[np.minimum(c, 3)], 0.0) / whole[group], weight[group]
    order = np.argsort(key)
    seen, share, weight = np.zeros(len(key), np.int64), np.zeros(len(key)), np.ones(len(key))
    for b, rows in by_bucket(bucket_of(key[order], words.buckets), words.buckets):
        held, mine = table(words.folder, f"grams{k}", b), order[rows]
        if held is not None:
            c, group, sums = search(held, context[mine], own[-1][mine])
            seen[mine] = c
            share[mine], weight[mine] = parts(c, group, sums)
    if split.any():
        each, back = np.unique(context[split], return_inverse=True)
        sums = look_up(words.folder, f"sums{k}", words.buckets, each, 4)
        share[split], weight[split] = parts(seen[split], back, sums)
    return share, weight


def probabilities(model: Model, columns: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """The model's probability of each n-gram's last word after the others; numbers and counts of all its words."""
    once, twice, thrice, _, types, total = model.unigrams
    cut = model.cut[1]
    if total:
        c = model.words.of_rank("grams1", columns[-1])
        saved = (cut[0] * once + cut[1] * twice + cut[2] * (types - once - twice)) / total
        p = np.maximum(c - np.array([0.0, *cut])[np.minimum(c, 3)], 0.0) / total + saved / (model.train_types + 1)
    else:
        p = np.full(len(columns[-1]), 1 / (model.train_types + 1))
    for k in range(2, model.order + 1):
        share, weight = interpolation(model, columns[-k:], counts[-k:])
        p = share + weight * p
    return p


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", keep: list[Column] = ()) -> DataFrame:
    """(doc_id, keep..., n_tokens, n_known, base_score, score) for every row of ``docs``.

    Scores are log10 probabilities of the whole text with its end; ``base_score`` is the unigram model with
    0.5 added to each count.  Perplexity is 10 ** (-score / n_tokens).  A null text is empty.
    """
    ship_package(docs.sparkSession)
    own = docs.select(F.col(text).alias("text"), F.col(id_col).alias("doc_id"), *keep)
    rest = own.columns[1:]
    log_base = np.log10(model.train_tokens + 0.5 * (model.train_types + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in spans.slices(batch.column(0), SCORED):
                symbols, of, token = streams(data, offsets, model.order)
                at, n = np.flatnonzero(token), hi - lo
                doc = of[at]
                ids, counts = model.words.numbers(symbols)
                columns, counts = ([x[at - model.order + 1 + i] for i in range(model.order)] for x in (ids, counts))
                c = counts[-1]
                base = np.log10(c + 0.5) - log_base
                p = np.log10(probabilities(model, columns, counts))
                numbers = [np.bincount(doc, minlength=n), np.bincount(doc, c > 0, n).astype(np.int64),
                           np.bincount(doc, base, n), np.bincount(doc, p, n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, n) for i in range(1, batch.num_columns)] + [pa.array(x) for x in numbers],
                    [*rest, "n_tokens", "n_known", "base_score", "score"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[1:])
    return own.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, base_score double, score double")


def held_out(id_col: str, folds: int = 5, fold: int = 1) -> Column:
    """Whether a row is kept from training: crc32 of its id as text (null: the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = 3, whole: int = WHOLE) -> DataFrame:
    """Fit on the rows that are not held out and score all; an empty table gives no rows."""
    model = fit(docs.where(~held_out(id_col)), text, order, whole)
    return score(docs, model, id_col, text, [held_out(id_col).alias("held_out"), F.lit(model.train_tokens).cast("long").alias("train_tokens")])
