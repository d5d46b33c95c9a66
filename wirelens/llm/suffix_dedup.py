"""Repeated substrings removed across documents, by prefix-free parsing.

Every window of ``length`` bytes has a trigger, the k-gram with the smallest rolling hash in it (the last
one in a tie).  Windows in a row with the same trigger form a phrase, so phrases overlap by
``length - 1`` bytes, no window is cut, and equal windows have equal triggers wherever they stand: a
phrase meets every other occurrence of its windows in the bucket of its trigger.  A document is its parse,
the sequence of its phrases.

1. Each chunk of documents sends the distinct triggers of its parse; buckets of triggers answer with one
   bit each, whether more than one document has it.  Most text ends here.
2. Chunks send their distinct phrases with shared triggers and the smallest document that holds them.
   Per bucket these are the dictionary.  A phrase that is alone with its trigger stands for all its
   windows.  The others are cut into parts, the windows that hold the trigger at about the same place.  The
   windows of a part have a core in common; a part that is alone with its core stands for its windows, and the
   other parts are sorted by a suffix array, cores apart from each other; suffixes that agree in their first
   ``length`` bytes are one window, and its smallest document is the smallest over their parts.  So many
   different phrases around one common string are sorted once for each text near it, in blocks of bounded size.
3. The answer, runs of windows with the same smallest document, goes back to the chunks, which lay it over
   their parse.

What travels is at most one entry per chunk for a phrase, however many documents share it.  Several buckets
share the row that a chunk sends, since rows are as many as chunks times receivers.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wirelens.llm import spans
from wirelens.llm.common import parts_for, text_bytes
from wirelens.session import ship_package

CHUNK, BUCKET, GRAM, PARTS = 16 << 20, 4 << 20, 16, 7
TOGETHER = 4  # buckets that get one row of each chunk
SLICE, BLOCK, SORTED = 1 << 18, 1 << 15, 1 << 20  # bytes that are hashed, ranked and sorted together: arrays that fit a cache
_PLACE = np.uint64((1 << 24) - 1)
NO_ID = np.iinfo(np.int64).max  # a null id is smaller than none
_SENT = "bucket int, chunk int, blob binary"


def parse(hashed: spans.SpanHash, offsets: np.ndarray, length: int, gram: int):
    """(first window, last window, trigger) positions of the phrases of one slice."""
    wide, n = length - gram + 1, len(hashed.data) - length + 1
    if n <= 0:
        return [np.zeros(0, np.int64)] * 3
    place = np.arange(min(BLOCK, n) + wide - 1, dtype=np.uint64)
    trigger = np.empty(n, np.int64)
    for base in range(0, n, BLOCK):
        until = min(base + BLOCK, n)
        end = until + wide - 1
        key = spans.mix((hashed.sums[base + gram:end + gram] - hashed.sums[base:end]) * hashed.back[base:end])
        key &= ~_PLACE
        key |= _PLACE - place[:end - base]
        width = 1
        while 2 * width <= wide:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < wide:
            key = np.minimum(key[:width - wide], key[wide - width:])
        trigger[base:until] = (_PLACE + np.uint64(base)) - (key & _PLACE)
    edges = np.zeros(n + 1, np.int8)  # of the windows inside one document
    lo = np.clip(offsets[:-1], 0, n)
    hi = np.clip(offsets[1:] - length + 1, lo, n)
    np.add.at(edges, lo, 1)
    np.add.at(edges, hi, -1)
    valid = np.cumsum(edges[:-1], dtype=np.int8) > 0
    same = np.zeros(n + 1, bool)
    same[1:-1] = (trigger[1:] == trigger[:-1]) & valid[:-1] & valid[1:]
    begin = np.flatnonzero(valid & ~same[:-1])
    last = np.flatnonzero(valid & ~same[1:])
    return begin, last, trigger[begin]


class Chunk:
    """The parse of all documents of a chunk; positions are those in its bytes."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        ids = table.column("doc_id").combine_chunks()
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        self.length, self.slices, found, base = length, [], [], 0
        for lo, hi, data, offsets in spans.slices(table.column("text"), SLICE):
            hashed = spans.SpanHash(data)
            first, last, trigger = parse(hashed, offsets, length, gram)
            found.append((first + base, last + base, trigger + base, lo + np.searchsorted(offsets, first, "right") - 1,
                          hashed(trigger, trigger + gram), hashed(first, last + length)))
            self.slices.append((lo, hi, data, offsets, base))
            base += len(data)
        found = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
        self.first, self.last, self.trigger, self.row, self.key, self.phrase = found

    def triggers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases in rising order of their triggers, and where each distinct trigger begins; which of these several rows have."""
        order = np.argsort(self.key)
        key, row = self.key[order], self.row[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        if not len(begin):
            return order, begin, np.zeros(0, bool)
        return order, begin, np.minimum.reduceat(row, begin) != np.maximum.reduceat(row, begin)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _edges(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in rising keys."""
    return np.searchsorted(_bucket(key, buckets), np.arange(buckets + 1, dtype=np.uint64))


def _rows(names: list[str], rows: list[tuple]) -> pa.Table:
    kinds = {"bucket": pa.int32(), "chunk": pa.int32(), "blob": pa.binary()}
    return pa.table({n: pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)})


def _phrases(chunk: Chunk, answers: pa.Table, buckets: int) -> dict:
    """The phrases of a chunk with shared triggers, from the buckets' bits, and the distinct ones among them.

    ``use`` are the phrases in the order of the parse, ``number`` which distinct one each is.  The distinct ones are
    in the order of their triggers and hashes, so that each parse of the chunk numbers them alike.
    """
    order, begin, _ = chunk.triggers()
    edges, shared = _edges(chunk.key[order[begin]], buckets), np.zeros(len(begin), bool)
    for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob")):
        bits = np.frombuffer(blob.as_buffer(), np.uint8)
        shared[edges[b]:edges[b + 1]] = np.unpackbits(bits, count=edges[b + 1] - edges[b]).astype(bool)
    times = np.diff(np.append(begin, len(order)))
    several = np.repeat(shared & (times > 1), times)
    mine = order[several]
    order[several] = mine[np.lexsort((chunk.phrase[mine], chunk.key[mine]))]
    order = order[np.repeat(shared, times)]
    k, p = chunk.key[order], chunk.phrase[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    number = np.empty(len(chunk.key), np.int64)
    number[order] = np.cumsum(fresh) - 1
    use = np.zeros(len(chunk.key), bool)
    use[order] = True
    use, begin = np.flatnonzero(use), np.flatnonzero(fresh)
    ids = chunk.ids[chunk.row[order]]
    return {"use": use, "number": number[use], "key": k[begin], "where": order[begin],
            "smallest": np.minimum.reduceat(ids, begin) if len(begin) else ids}


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(values)
    ranked = values[order]
    twin = np.zeros(len(values) + 1, bool)
    twin[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(values), bool)
    out[order] = twin[1:] | twin[:-1]
    return out


def _grouped(one: np.ndarray, other: np.ndarray, smallest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each row, a row of each entry, its smallest) of rows that agree in both hashes, in their order."""
    order = np.lexsort((other, one))
    a, b = one[order], other[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    entry = np.empty(len(a), np.int64)
    entry[order] = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    return entry, order[begin], np.minimum.reduceat(smallest[order], begin) if len(begin) else smallest


def _hashes(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, of: np.ndarray, *asked) -> list[np.ndarray]:
    """Hashes of (start, end) pairs of rising texts; ``of`` is the text of each pair.  Hashes take sixteen times the bytes."""
    out = [np.empty(len(of), np.uint64) for _ in asked]
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + SLICE, "right")))
        hashed = spans.SpanHash(text[begins[lo]:ends[hi - 1]])
        a, b = np.searchsorted(of, [lo, hi])
        for to, (start, end) in zip(out, asked):
            to[a:b] = hashed(start[a:b] - begins[lo], end[a:b] - begins[lo])
        lo = hi
    return out


def _joined(raw: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]), np.uint8)


def sorted_minimum(symbols: np.ndarray, own: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """Smallest value of each window of texts of ``own`` bytes, over all texts that hold it, by their suffix array."""
    ends = np.cumsum(own)
    padded = np.append(symbols, np.zeros(8, np.uint8))
    codes = np.zeros(len(symbols), np.uint64)
    for i in range(8):
        codes = (codes << np.uint64(8)) | padded[i:i + len(symbols)].astype(np.uint64)
    sorted_to = spans.SuffixArray(codes, np.repeat(ends, own), limit=length, by_document=False, unit=8)
    width, rank = sorted_to.width, sorted_to.levels[-1]
    count = own - length + 1
    at = np.repeat(ends - own, count) + spans.ragged(count)
    pair = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[at + max(length - width, 0)].astype(np.uint64)
    same = np.argsort(pair)
    ranked = pair[same]
    begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    group = np.minimum.reduceat(np.repeat(least, count)[same], begin)
    found = np.empty(len(same), np.int64)
    found[same] = np.repeat(group, np.diff(np.append(begin, len(same))))
    return found


def parts_minimum(text: np.ndarray, own: np.ndarray, place: np.ndarray, least: np.ndarray,
                  length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs of each phrase, windows of each run, its smallest value) of phrases of ``own`` bytes that share triggers.

    A part of a phrase are its windows with about as many bytes before the trigger.
    """
    ends = np.cumsum(own)
    begins = ends - own
    n = own - length + 1
    step = -(-(length - gram + 1) // PARTS)
    high = place // step
    parts = high - (place - n + 1) // step + 1
    of = np.repeat(np.arange(len(own)), parts)
    bin_ = np.repeat(high, parts) - spans.ragged(parts)
    most = np.minimum(bin_ * step + step - 1, length - gram)
    first, last = np.minimum(place[of], most), np.maximum(place[of] - n[of] + 1, bin_ * step)
    at = begins[of] + place[of]
    core, whole = _hashes(text, begins, ends, of, (at - bin_ * step, at - most + length), (at - first, at - last + length))
    part, some, low = _grouped(spans.pair(core, bin_.astype(np.uint64)), whole, least[of])
    odd = np.flatnonzero(_repeated(core[some]))  # rising cores and bins, so equal ones are neighbours
    counts = np.ones(len(some), np.int64)
    counts[odd] = (first - last + 1)[some[odd]]
    starts = np.cumsum(counts) - counts
    values = np.repeat(low, counts)
    if len(odd):
        raw, a, b = memoryview(text), (at - first)[some[odd]], (at - last + length)[some[odd]]
        key = spans.pair(core, bin_.astype(np.uint64))[some[odd]]
        group = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(odd))
        size = np.append(0, np.cumsum(b - a))[group]
        lo = 0
        while lo < len(group) - 1:  # cores share no window
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + SORTED, "right")) - 1)
            x, y = group[lo], group[hi]
            times = counts[odd[x:y]]
            values[np.repeat(starts[odd[x:y]], times) + spans.ragged(times)] = sorted_minimum(_joined(raw, a[x:y], b[x:y]), b[x:y] - a[x:y], low[odd[x:y]], length)
            lo = hi

    times = counts[part]
    value = values[np.repeat(starts[part], times) + spans.ragged(times)]
    width = np.repeat(np.where(times > 1, 1, first - last + 1), times)
    owner = np.repeat(of, times)
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(fresh)
    return np.bincount(owner[begin], minlength=len(own)), np.add.reduceat(width, begin), value[begin]


def dictionary_minimum(text: np.ndarray, lengths: np.ndarray, places: np.ndarray, smallest: np.ndarray,
                       length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest document of every window of the phrases of one bucket.

    Returns (entry of each phrase, runs of each entry, windows of each run, its smallest document).
    """
    ends = np.cumsum(lengths)
    begins = ends - lengths
    at = begins + places
    phrase, trigger = _hashes(text, begins, ends, np.arange(len(ends)), (begins, ends), (at, at + gram))
    entry, where, least = _grouped(trigger, phrase, smallest)
    windows = lengths[where] - length + 1
    twin = np.flatnonzero(_repeated(trigger[where]))
    if not len(twin):
        return entry, np.ones(len(where), np.int64), windows, least

    raw, chosen = memoryview(text), where[twin]
    own, t = lengths[chosen], trigger[chosen]
    group = np.append(np.flatnonzero(np.append(True, t[1:] != t[:-1])), len(twin))
    size = np.append(0, np.cumsum(own))[group]
    found, lo = [], 0
    while lo < len(group) - 1:  # triggers share no window
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + SORTED, "right")) - 1)
        x = chosen[group[lo]:group[hi]]
        found.append(parts_minimum(_joined(raw, begins[x], ends[x]), lengths[x], places[x], least[twin[group[lo]:group[hi]]], length, gram))
        lo = hi
    several, some_windows, some_values = (np.concatenate(f) for f in zip(*found))
    runs = np.ones(len(where), np.int64)
    runs[twin] = several
    run_windows, run_values = np.repeat(windows, runs), np.repeat(least, runs)
    to = np.repeat((np.cumsum(runs) - runs)[twin], several) + spans.ragged(several)
    run_windows[to], run_values[to] = some_windows, some_values
    return entry, runs, run_windows, run_values


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 50,
                     gram: int = GRAM, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of ``docs``.

    Removes each byte covered by a ``length``-byte string that also starts in a row with a smaller id;
    strings are judged on the input.  A null text is empty.  Rows with equal ids do not remove from each
    other; a null id is larger than any other.  Texts shorter than ``length`` stay whole.  ``kept`` are
    the bytes that are left, which need not be whole characters.  An empty table gives no rows.
    """
    if not 8 <= gram <= length or length < 16:
        raise ValueError("windows need at least 16 bytes and triggers 8 to the window's length")
    spark = docs.sparkSession
    ship_package(spark)
    size = text_bytes(docs, text)
    chunks, buckets = parts_for(spark, size, CHUNK), parts_for(spark, size, TOGETHER * BUCKET)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")

    def send_triggers(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, length, gram)
        order, begin, several = chunk.triggers()
        key = chunk.key[order[begin]]
        edges, name = _edges(key, buckets), table.column("chunk")[0].as_py()
        return _rows(["bucket", "chunk", "blob"], [
            (b, name, key[edges[b]:edges[b + 1]].tobytes() + np.packbits(several[edges[b]:edges[b + 1]]).tobytes())
            for b in np.flatnonzero(np.diff(edges)).tolist()])

    def share(table: pa.Table) -> pa.Table:
        keys, several = [], []
        for blob in table.column("blob"):
            raw = np.frombuffer(blob.as_buffer(), np.uint8)
            n = 8 * len(raw) // 65  # n keys of 8 bytes and n bits
            n = next(m for m in (n, n - 1, n + 1) if 8 * m + (m + 7) // 8 == len(raw))
            keys.append(raw[:8 * n].view(np.uint64))
            several.append(np.unpackbits(raw[8 * n:], count=n).astype(bool))
        shared = _repeated(np.concatenate(keys)) | np.concatenate(several)
        at = np.cumsum([0] + [len(k) for k in keys])
        return _rows(["bucket", "chunk", "blob"], [
            (b, c, np.packbits(shared[at[i]:at[i + 1]]).tobytes()) for i, (b, c) in enumerate(
                zip(table.column("bucket").to_pylist(), table.column("chunk").to_pylist()))])

    small = np.dtype("u1" if length - gram < 1 << 8 else "<u4")  # holds how far a trigger lies into its phrase, and windows less one

    def send_phrases(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(["bucket", "chunk", "blob"], [])
        chunk = Chunk(table, length, gram)
        distinct = _phrases(chunk, answers, buckets)
        where, raw = distinct["where"], [memoryview(x[2]) for x in chunk.slices]
        first = chunk.first[where]
        size = chunk.last[where] + length - first
        place = (chunk.trigger[where] - first).astype(small)
        base = np.array([x[4] for x in chunk.slices] or [0])
        home = np.searchsorted(base, first, "right") - 1
        first -= base[home]
        edges, name, rows = _edges(distinct["key"], buckets * TOGETHER), table.column("chunk")[0].as_py(), []
        for b in np.flatnonzero(np.diff(edges[::TOGETHER])).tolist():
            own = edges[b * TOGETHER:(b + 1) * TOGETHER + 1]
            lo, hi = own[0], own[-1]
            texts = [raw[i][a:b] for i, a, b in zip(home[lo:hi].tolist(), first[lo:hi].tolist(), (first[lo:hi] + size[lo:hi]).tolist())]
            rows.append((b, name, b"".join([np.diff(own).astype("<i8").tobytes(), distinct["smallest"][lo:hi].astype("<i8").tobytes(),
                                            size[lo:hi].astype("<u4").tobytes(), place[lo:hi].tobytes(), *texts])))
        return _rows(["bucket", "chunk", "blob"], rows)

    def look_up(table: pa.Table) -> pa.Table:
        parts = []
        for blob in table.column("blob"):
            raw = np.frombuffer(blob.as_buffer(), np.uint8)
            counts = raw[:8 * TOGETHER].view("<i8")
            cut = np.cumsum([8 * TOGETHER] + [w * int(counts.sum()) for w in (8, 4, small.itemsize)])
            size = raw[cut[1]:cut[2]].view("<u4").astype(np.int64)
            parts.append((np.append(0, np.cumsum(counts)), raw[cut[0]:cut[1]].view("<i8"), size, raw[cut[2]:cut[3]].view(small), raw[cut[3]:],
                          np.append(0, np.cumsum(size))))
        found = [[] for _ in parts]
        for i in range(TOGETHER):
            own = [p for p in parts if p[0][i + 1] > p[0][i]]
            if not own:
                continue
            smallest, size, place = (np.concatenate([p[x][p[0][i]:p[0][i + 1]] for p in own]).astype(np.int64) for x in (1, 2, 3))
            text_in = np.concatenate([p[4][p[5][p[0][i]]:p[5][p[0][i + 1]]] for p in own])
            entry, runs, windows, values = dictionary_minimum(text_in, size, place, smallest, length, gram)
            starts, done = np.cumsum(runs) - runs, 0
            for p, answer in zip(parts, found):
                mine = entry[done:done + p[0][i + 1] - p[0][i]]
                done += len(mine)
                at = np.repeat(starts[mine], runs[mine]) + spans.ragged(runs[mine])
                answer.append(((runs[mine] - 1).astype(small), (windows[at] - 1).astype(small), values[at].astype("<i8")))
        return _rows(["bucket", "chunk", "blob"], [
            (b, c, b"".join([x.tobytes() for kind in zip(*answer) for x in kind]))
            for b, c, answer in zip(table.column("bucket").to_pylist(), table.column("chunk").to_pylist(), found)])

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("kept", pa.binary())] * with_kept

    def lay_over(table: pa.Table, bits: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table, length, gram)
        distinct = _phrases(chunk, bits, buckets)
        edges, got = _edges(distinct["key"], buckets), []
        for b, blob in sorted(zip(answers.column("bucket").to_pylist(), answers.column("blob")), key=lambda x: x[0]):
            raw, n = np.frombuffer(blob.as_buffer(), np.uint8), edges[b + 1] - edges[b]
            runs = raw[:n * small.itemsize].view(small).astype(np.int64) + 1
            cut = (n + int(runs.sum())) * small.itemsize
            got.append((runs, raw[n * small.itemsize:cut].view(small).astype(np.int64) + 1, raw[cut:].view("<i8")))
        runs, windows, value = (np.concatenate(x) for x in zip(*got)) if got else [np.zeros(0, np.int64)] * 3
        start = np.cumsum(runs) - runs
        behind = np.cumsum(windows) - windows  # windows of the phrase before a run
        behind -= np.repeat(behind[start], runs)
        use, number = distinct["use"], distinct["number"]
        first = chunk.first[use]
        out = {n: [] for n, _ in fields}
        done = 0
        for lo, hi, data, offsets, base in chunk.slices:
            until = int(np.searchsorted(first, base + len(data)))
            here, mine = use[done:until], number[done:until]
            done = until
            at = np.repeat(start[mine], runs[mine]) + spans.ragged(runs[mine])
            own = np.repeat(here, runs[mine])
            gone = value[at] < chunk.ids[chunk.row[own]]
            at, own = at[gone], own[gone]
            cover = spans.covered(chunk.first[own] - base + behind[at], windows[at] + length - 1, len(data))
            edge = np.zeros(len(cover) + 1, bool)
            edge[offsets] = True
            before = np.append(False, cover[:-1]) if len(cover) else cover
            out["n_spans"].append(spans.per_document(cover & (~before | edge[:-1]), offsets))
            removed = spans.per_document(cover, offsets)
            out["n_removed"].append(removed)
            out["n_bytes"].append(np.diff(offsets))
            left = data[~cover].tobytes()
            ends = np.cumsum(np.diff(offsets) - removed).tolist()
            raw = [left[a:b] for a, b in zip([0] + ends[:-1], ends)]
            out["kept_sha256"] += [hashlib.sha256(r).hexdigest() for r in raw]
            if with_kept:
                out["kept"] += raw
        result = {n: pa.array(np.concatenate(v) if v else [], t) if n.startswith("n_") else pa.array(v, t)
                  for (n, t) in fields if n != "doc_id" for v in [out[n]]}
        return pa.table({"doc_id": table.column("doc_id")} | result)

    sent = dealt.groupBy("chunk").applyInArrow(send_triggers, _SENT)
    bits = sent.groupBy("bucket").applyInArrow(share, _SENT)
    phrases = dealt.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(send_phrases, _SENT)
    minima = phrases.groupBy("bucket").applyInArrow(look_up, _SENT)
    both = bits.withColumn("step", F.lit(1)).unionByName(minima.withColumn("step", F.lit(2)))

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in fields})
        step = answers.column("step").to_numpy()
        return lay_over(table, answers.filter(pa.array(step == 1)), answers.filter(pa.array(step == 2)))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish, schema)
