"""Token ids of texts by a public tokenizer, inside tasks.

The tokenizer drops white space and looks at words one by one, so the ids of a text are those of its
blank-separated words in order.  Each distinct word is encoded once per worker and remembered, up to a
bound; tests hold the result against encoding whole texts.
"""

import os

import numpy as np
import pyarrow as pa

from wirelens.llm import spans

REMEMBERED = 1_000_000  # words; a full memory is emptied, which costs time and changes no result
_encoders = {}


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.forget()

    def forget(self):
        """The memory: sorted word hashes, where the ids of each word begin and how many there are."""
        self.hashes, self.begin, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0

    def learn(self, hashes: np.ndarray, texts: list[str]):
        """Encode new words, given in rising order of their hashes."""
        begin, length = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        for lo in range(0, len(texts), 5_000):
            found = [e.ids for e in self.many(texts[lo:lo + 5_000], add_special_tokens=False)]
            sizes = np.array([len(ids) for ids in found], np.int64)
            ids = np.fromiter((i for each in found for i in each), np.uint32, int(sizes.sum()))
            if len(ids) and ids.max() > np.iinfo(self.flat.dtype).max:
                self.flat = self.flat.astype(np.uint32)
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), self.flat.dtype)])
            self.flat[self.used:self.used + len(ids)] = ids
            length[lo:lo + len(sizes)] = sizes
            begin[lo:lo + len(sizes)] = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begin, self.length = (np.insert(old, at, new) for old, new in (
            (self.hashes, hashes), (self.begin, begin), (self.length, length)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a slice, their offsets)."""
        starts, ends, doc = spans.words(data, offsets)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        each, where, back = np.unique(spans.SpanHash(data)(starts, ends), return_index=True, return_inverse=True)
        if len(each):
            at = np.searchsorted(self.hashes, each)
            fresh = np.ones(len(each), bool)
            inside = at < len(self.hashes)
            fresh[inside] = self.hashes[at[inside]] != each[inside]
            new = np.flatnonzero(fresh)
            self.learn(each[new], [data[a:b].tobytes().decode() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())])
        slots = np.searchsorted(self.hashes, each)[back] if len(each) else np.zeros(0, np.int64)
        lengths = self.length[slots]
        ids = self.flat[np.repeat(self.begin[slots], lengths) + spans.ragged(lengths)]
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        return ids, total[np.searchsorted(doc, np.arange(len(offsets)))]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded_documents(texts: pa.Array, path: str, end_id: int):
    """Per slice of the batch: (first row, ids with the end id after each document, their offsets)."""
    for lo, hi, data, offsets in spans.slices(texts):
        ids, at = encoder(path).encode(data, offsets)
        n = hi - lo
        out = np.empty(len(ids) + n, np.uint32)
        ends = at[1:] + np.arange(n)
        out[ends] = end_id
        rest = np.ones(len(out), bool)
        rest[ends] = False
        out[rest] = ids
        yield lo, out, at + np.arange(n + 1)
