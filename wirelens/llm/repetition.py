"""Quality rules on repetition inside a document, by a suffix array over its words.

Neighbours in suffix order give, for every word, the longest repeat that begins there (its larger
LCP).  The repeats that are not the tail of a longer one are the maximal repeated substrings; the
union of their spans is the repeated part.  A text is rejected if too many of its characters are
repeated or one repeat is too long.  Texts are judged whole and alone, so the work is one map pass.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.functions import arrow_udf

from wirelens.llm import spans
from wirelens.session import ship_package

FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
          ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
          ("repeated_chars", pa.int64()), ("longest_repeat", pa.int64())]
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, repeated_chars long, longest_repeat long")
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def measure(data: np.ndarray, offsets: np.ndarray, window: int, min_repeat: int) -> dict[str, np.ndarray]:
    """Counts per document of one slice."""
    n = len(offsets) - 1
    starts, ends, doc = spans.words(data, offsets)
    hashed = spans.SpanHash(data)
    first = np.searchsorted(doc, np.arange(n + 1))
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
    chars = letters[ends] - letters[starts]
    order = spans.SuffixArray(hashed(starts, ends), first[doc + 1])
    longest = order.longest_repeat()

    at = np.flatnonzero(longest >= window)
    in_window = spans.covered(at, np.full(len(at), window), len(starts))
    tail = np.zeros(len(longest), bool)  # all of it lies in the repeat that begins one word earlier
    if len(longest) > 1:
        tail[1:] = (longest[:-1] == longest[1:] + 1) & (doc[:-1] == doc[1:])
    at = np.flatnonzero((longest >= min_repeat) & ~tail)
    repeated = spans.covered(at, longest[at], len(starts))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc, longest)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1, offsets[-1:]]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    broken = np.isin(line_ends - 1, breaks)
    words_before = np.searchsorted(starts, np.append(line_starts, len(data)))
    has_word = np.diff(words_before) > 0
    line = hashed(line_starts, line_ends - broken)[has_word]
    line_doc = line_doc[has_word]
    by = np.lexsort((line, line_doc))
    again = np.zeros(len(by), bool)
    if len(by) > 1:
        again[1:] = (line[by][1:] == line[by][:-1]) & (line_doc[by][1:] == line_doc[by][:-1])
    return {"n_words": np.diff(first), "word_chars": spans.per_document(chars, first),
            "n_symbols": spans.per_document(SYMBOL[data], offsets),
            "n_dup_lines": np.bincount(line_doc[by][again], minlength=n).astype(np.int64),
            "n_repeat_words": spans.per_document(in_window, first),
            "repeated_chars": spans.per_document(chars * repeated, first), "longest_repeat": most}


def repetition(text: Column, window: int = 8, min_words: int = 20, max_window_percent: int = 30, min_repeat: int = 10,
               max_repeated_percent: int = 25, max_repeat: int = 200) -> Column:
    """Struct of counts and verdicts for a text column.

    ``base_failed``: fewer than ``min_words`` words, or over ``max_window_percent`` of the words lie in
    windows of ``window`` words found twice or more.  ``kept``: not failed, and repeats of at least
    ``min_repeat`` words cover at most ``max_repeated_percent`` of the characters in words, and none is
    longer than ``max_repeat`` words.  A null or empty text has no words and fails.
    """
    @arrow_udf(SCHEMA)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [measure(data, offsets, window, min_repeat) for _, _, data, offsets in spans.slices(texts)]
            c = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k, _ in FIELDS if k not in ("base_failed", "kept")}
            c["base_failed"] = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_window_percent * c["n_words"])
            c["kept"] = (~c["base_failed"] & (100 * c["repeated_chars"] <= max_repeated_percent * c["word_chars"])
                         & (c["longest_repeat"] <= max_repeat))
            yield pa.StructArray.from_arrays([pa.array(c[k], t) for k, t in FIELDS], [k for k, _ in FIELDS])
    return judge(text)


def judge_documents(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """(row, q) for every row of ``docs``: its columns unchanged, and the struct of ``repetition``."""
    ship_package(docs.sparkSession)
    return docs.select(F.struct("*").alias("row"), repetition(F.col(text), **limits).alias("q"))
