"""Alignment of the tokens of two tokenizers, with corpus-wide counts of the id pairs that overlap.

Both tokenizers encode a whole text.  What their tokens spell must be the text, byte by byte, else the text has no
tokens here.  Then a byte offset where tokens of both end is verified, and those of them that stand before a token
that begins with a space are anchors: they cut both id lists into windows, mostly of one word.  The alignment of
a window depends on its ids alone, so it is worked out once per worker and remembered under its two id tuples.

Counts: texts are aligned in slices of bounded size; a slice keeps, per text, which of its pairs are linked and how
often.  Distinct pairs of slices are summed over the corpus, the best partners of every id found, and the counts a
slice needs go back to it by a join.  No worker holds the pairs of the corpus.
"""

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wirelens.llm import spans
from wirelens.llm.common import landed
from wirelens.session import ship_package

REMEMBERED = 300_000  # windows; a full memory is emptied, which costs time and changes no result
BLOCK = 1 << 18  # tokens that are spelled out together
# fixed value: how byte-level vocabularies cut a text into words
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_aligners = {}


class Spelling:
    """The bytes of every token of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.array([t[:1] == b" " for t in tokens])

    def spell(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        for lo in range(0, len(ids), BLOCK):
            some = ids[lo:lo + BLOCK]
            lengths = self.length[some]
            yield self.flat[np.repeat(self.begin[some], lengths) + spans.ragged(lengths)]


def byte_symbols() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(c): b for c, b in [*zip(own, own), *zip(range(256, 512), rest)]}


def ranked(path: str):
    """The same vocabulary as ranks, which its library encodes faster; None unless the file says that nothing else matters.

    That is: byte-level words, no normalizer, no other option of the model, and merges in the order of the ids
    that they make.  Tests compare both over every code point.
    """
    import tiktoken
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, before = held["model"], held.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", ())]
    words, first = model.get("vocab") or {}, 256
    plain = (model.get("type") == "BPE" and not held.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex")
             and not before.get("add_prefix_space") and not any(model.get(o) for o in (
                 "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
             and all(words.get(m.replace(" ", "")) == first + i for i, m in enumerate(merges)))
    if not plain:
        return None
    symbols = byte_symbols()
    ranks = {bytes(symbols[c] for c in t): i for t, i in words.items() if i < first + len(merges)}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """Two tokenizers in one worker and the windows it has aligned."""

    def __init__(self, bytes_file: str, pieces_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a, self.ranked = Tokenizer.from_file(bytes_file), ranked(bytes_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_file)
        symbols = byte_symbols()
        known = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.spell_a = Spelling([bytes(symbols[c] for c in t) if all(c in symbols for c in t) else t.encode() for t in known])
        pieces = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            pieces.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i)
                          else piece.replace("▁", " ").encode())
        self.spell_b = Spelling(pieces)
        self.forget()

    def forget(self):
        self.windows: dict[tuple[bytes, bytes], int] = {}
        self.texts: list[str] = []
        self.groups, self.begin, self.links = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if self.ranked:
            own = [np.array(self.ranked.encode_ordinary(" " + t), np.int64) for t in texts]
        else:
            own = [np.array(e.ids, np.int64) for e in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        return own, [np.array(ids, np.int64) for ids in self.b.encode(texts, num_threads=1)]

    def spelled(self, ids: np.ndarray, spelling: Spelling, text: bytes) -> bool:
        if not len(ids) or int(spelling.length[ids].sum()) != len(text):
            return False
        at, want = 0, np.frombuffer(text, np.uint8)
        for some in spelling.spell(ids):
            if not np.array_equal(some, want[at:at + len(some)]):
                return False
            at += len(some)
        return True

    def learn(self, keys: list[tuple[bytes, bytes]], kind):
        """Align windows that are new: their groups, written out, and the id pairs that overlap."""
        a = np.frombuffer(b"".join(k[0] for k in keys), kind).astype(np.int64)
        b = np.frombuffer(b"".join(k[1] for k in keys), kind).astype(np.int64)
        width = np.dtype(kind).itemsize
        last_a = np.cumsum([len(k[0]) // width for k in keys]) - 1
        ends_a, ends_b = np.cumsum(self.spell_a.length[a]), np.cumsum(self.spell_b.length[b])
        edges = np.union1d(ends_a, ends_b)  # every stretch between two edges is the overlap of one pair
        at_a, at_b = np.searchsorted(ends_a, edges), np.searchsorted(ends_b, edges)
        shared = (ends_a[at_a] == edges) & (ends_b[at_b] == edges)
        stops = np.searchsorted(edges, ends_a[last_a]) + 1  # a window ends where its last tokens end
        starts = np.append(0, stops[:-1])
        n_shared = np.cumsum(shared)
        n_groups = n_shared[stops - 1] - np.append(0, n_shared[stops[:-1] - 1])
        told = []
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        low_a = low_b = 0
        for i, j in zip((at_a[shared] + 1).tolist(), (at_b[shared] + 1).tolist()):
            told.append(",".join(names_a[low_a:i]) + "|" + ",".join(names_b[low_b:j]))
            low_a, low_b = i, j
        low = 0
        for k, n in zip(keys, n_groups.tolist()):
            self.windows[k] = len(self.texts)
            self.texts.append(";".join(told[low:low + n]))
            low += n
        # one concatenation a slice, as the memory is bounded
        self.begin = np.concatenate([self.begin, starts + len(self.flat)])
        self.links = np.concatenate([self.links, stops - starts])
        self.groups = np.concatenate([self.groups, n_groups])
        self.flat = np.concatenate([self.flat, a[at_a] * len(self.spell_b.length) + b[at_b]])

    def align(self, texts: list[str | None]) -> tuple[dict[str, np.ndarray | list], np.ndarray, np.ndarray, np.ndarray]:
        """Per text n_a, n_b, n_groups, n_links, groups_sha256; then its distinct pairs: (text, pair, how often)."""
        n = len(texts)
        out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * n}
        asked = [i for i, t in enumerate(texts) if t]
        own, other = self.encode([texts[i] for i in asked])
        good = [k for k, i in enumerate(asked) if self.spelled(own[k], self.spell_a, raw := b" " + texts[i].encode())
                and self.spelled(other[k], self.spell_b, raw)]
        none = np.zeros(0, np.int64)
        if not good:
            return out, none, none, none
        places = np.array([asked[k] for k in good])
        n_a, n_b = np.array([len(own[k]) for k in good]), np.array([len(other[k]) for k in good])
        a, b = np.concatenate([own[k] for k in good]), np.concatenate([other[k] for k in good])
        del own, other
        # texts stand one after the other: both tokenizers spell the same bytes, so offsets agree
        ends_a, ends_b = np.cumsum(self.spell_a.length[a]), np.cumsum(self.spell_b.length[b])
        at = np.searchsorted(ends_b, ends_a)
        shared = np.flatnonzero(ends_b[at] == ends_a)
        last = np.zeros(len(a), bool)
        last[np.cumsum(n_a) - 1] = True
        spaced = np.append(self.spell_a.spaced[a[1:]], False)  # what follows begins with a space, so in both
        anchors = shared[last[shared] | spaced[shared]]
        stop_a, stop_b = anchors + 1, at[anchors] + 1
        kind = "<u2" if max(len(self.spell_a.length), len(self.spell_b.length)) <= 1 << 16 else "<u4"
        raw_a, raw_b, w = a.astype(kind).tobytes(), b.astype(kind).tobytes(), np.dtype(kind).itemsize
        cuts_a, cuts_b = [0, *(stop_a * w).tolist()], [0, *(stop_b * w).tolist()]
        if len(self.windows) > REMEMBERED:
            self.forget()
        keys = [(raw_a[p:q], raw_b[r:s]) for p, q, r, s in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])]
        get = self.windows.get
        of = np.fromiter(map(get, keys, itertools.repeat(-1)), np.int64, len(keys))
        fresh = np.flatnonzero(of < 0)
        if len(fresh):
            new = [keys[i] for i in fresh.tolist()]
            self.learn(list(dict.fromkeys(new)), kind)
            of[fresh] = np.fromiter(map(get, new), np.int64, len(new))
        del keys, raw_a, raw_b
        first = np.append(0, np.flatnonzero(last[anchors]) + 1)  # windows of each text
        told, known = self.texts, of.tolist()
        for k, i in enumerate(places.tolist()):
            whole = ";".join([told[m] for m in known[first[k]:first[k + 1]]])
            out["groups_sha256"][i] = hashlib.sha256(whole.encode()).hexdigest()
        out["n_a"][places], out["n_b"][places] = n_a, n_b
        out["n_groups"][places] = spans.per_document(self.groups[of], first)
        counts = self.links[of]
        out["n_links"][places] = spans.per_document(counts, first)
        pairs = self.flat[np.repeat(self.begin[of], counts) + spans.ragged(counts)]
        text = np.repeat(np.repeat(places, np.diff(first)), counts)
        size = len(self.spell_a.length) * len(self.spell_b.length)
        each, times = np.unique(text * size + pairs, return_counts=True)
        return out, each // size, each % size, times


def aligner(*files: str) -> Aligner:
    if files not in _aligners:
        _aligners.clear()
        _aligners[files] = Aligner(*files)
    return _aligners[files]


def _small(values: np.ndarray) -> bytes:
    """Integers from 0, in 2 bytes each where they fit, else in 4; the reader knows how many there are."""
    return values.astype("<u2" if not len(values) or values.max() < 1 << 16 else "<u4").tobytes()


def _read(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def align_slices(docs: DataFrame, bytes_file: str, pieces_file: str, id_col: str, text: str, limit: int) -> DataFrame:
    """A row per slice: its texts' figures as arrays, its distinct pairs with the number of texts that hold each, and
    per text which of them (``held``, ``times``, from ``offsets``)."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), itertools.count()
        for batch in batches:
            for lo, hi, _, _ in spans.slices(batch.column(1), limit):
                some = batch.slice(lo, hi - lo)
                figures, at, pairs, times = aligner(bytes_file, pieces_file).align(some.column(1).to_pylist())
                known, held, hits = np.unique(pairs, return_inverse=True, return_counts=True)
                offsets = np.searchsorted(at, np.arange(hi - lo + 1))
                row = {"slice": [part << 32 | next(number)], "doc_ids": [some.column(0)],
                       **{c: [figures[c]] for c in NUMBERS}, "groups_sha256": [figures["groups_sha256"]],
                       "pairs": [known], "hits": [hits], "offsets": [_small(offsets)], "held": [_small(held)], "times": [_small(times)]}
                yield pa.RecordBatch.from_pydict({c: pa.array(v, schema[c]) if c in schema else pa.ListArray.from_arrays(
                    [0, hi - lo], v[0]) for c, v in row.items()})
    longs = pa.list_(pa.int64())
    schema = {"slice": pa.int64(), **{c: longs for c in NUMBERS}, "groups_sha256": pa.list_(pa.string()), "pairs": longs, "hits": longs,
              **{c: pa.binary() for c in ("offsets", "held", "times")}}
    return own.mapInArrow(run, f"slice long, doc_ids array<{kind}>, " + ", ".join(f"{c} array<long>" for c in NUMBERS)
                          + ", groups_sha256 array<string>, pairs array<long>, hits array<long>, offsets binary, held binary, times binary")


def align_tokenizers(docs: DataFrame, bytes_file: str, pieces_file: str, id_col: str = "doc_id", text: str = "text",
                     limit: int = 1 << 20) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), one row per row of ``docs``.

    A null or empty text, and one that either tokenizer does not spell back, has zeros and an empty digest.  Rows
    with equal or null ids, and equal rows, are as many texts: each counts and has its row.  Other columns
    are not looked at.  Of several best partners of an id (ties) each is best.  An empty table gives no rows.
    ``limit`` is the bytes of text aligned together; a longer text is a slice of its own.
    """
    slices = landed(align_slices(docs, bytes_file, pieces_file, id_col, text, limit), "aligned")
    vocabulary = _pieces(pieces_file)
    used = slices.select("slice", F.explode(F.arrays_zip("pairs", "hits")).alias("x")).select("slice", "x.pairs", "x.hits")
    counts = used.groupBy("pairs").agg(F.sum("hits").alias("texts")).withColumn("a", F.floor(F.col("pairs") / vocabulary))
    counts = landed(counts, "pair-counts")
    best = counts.groupBy("a").agg(F.max("texts").alias("most"))
    rated = counts.join(best, "a").select("pairs", "texts", (F.col("texts") == F.col("most")).alias("best"))
    back = used.select("slice", "pairs").join(rated, "pairs").select(F.col("slice").alias("of_slice"), "pairs", "texts", "best")
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0] for c in left.column_names}
        order = np.argsort(right.column("pairs").to_numpy())
        texts = right.column("texts").to_numpy()[order]
        ahead = right.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        n = len(row["doc_ids"])
        offsets = _read(row["offsets"].as_py(), n + 1)
        held, times = (_read(row[c].as_py(), offsets[-1]) for c in ("held", "times"))
        columns = {"doc_id": row["doc_ids"].values, **{c: row[c].values for c in (*NUMBERS, "groups_sha256")},
                   "n_best": spans.per_document(ahead[held] * times, offsets), "count_sum": spans.per_document(texts[held] * times, offsets)}
        return pa.table({c: pa.array(v) if isinstance(v, np.ndarray) else v for c, v in columns.items()})
    whole = slices.select("slice", "doc_ids", *NUMBERS, "groups_sha256", "offsets", "held", "times")
    return whole.groupBy("slice").cogroup(back.groupBy("of_slice")).applyInArrow(
        finish, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in NUMBERS) + ", groups_sha256 string, n_best long, count_sum long")


def _pieces(pieces_file: str) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=pieces_file).get_piece_size()
