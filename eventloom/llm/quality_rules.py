"""Quality rules by repetition coverage (operator 7).

Rolling hashes of several n-gram lengths, computed in numpy over whole texts, give the share of
a text's characters that lie inside n-grams found at two or more places, and inside lines that
repeat an earlier line. A text is rejected if a share passes its threshold, if it has more symbols
for each word than allowed, or if it fails the base rules (fewer than 10 words, or more than a fifth of its words in repeated 5-word windows).
One map over the rows: no shuffle, and memory bounded by a block or by the longest text.

Nulls and empty texts have no words and fail the base rules. Rows are judged one by one, so
repeated rows and ties change nothing; an empty table gives an empty result. Extra columns pass
through ``filter_rows`` unless one bears the name of a result column, which is an error that the
caller resolves by renaming; ``measure`` reads two columns and ignores the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import _kernels as k

SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rules:
    """Thresholds; ``ngrams`` has the largest share of characters in repeated n-grams by n."""

    least_words: int = 10
    window: int = 5
    window_percent: int = 20
    ngrams: tuple[tuple[int, float], ...] = ((5, 0.25), (7, 0.24), (10, 0.22), (13, 0.20))
    dup_line_share: float = 0.30
    symbols_per_word: float = 0.30


def _shares(w: k.Words, at: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in windows found twice or more in their text."""
    keys = k.mixed(hashes + w.text[at].astype(np.uint64) * np.uint64(k.BASE))
    return k.covered(at[k.repeated(keys)], size, len(w.hashes))


def measure_block(column: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    w = k.words(column)
    n_words = w.counts
    begins = k.code_points(w.data)
    char_sums = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(begins, out=char_sums[1:])
    chars = char_sums[w.ends] - char_sums[w.starts]  # of each word
    word_chars = k.per_text(chars, w.first)
    n_symbols = k.per_text(SYMBOLS[w.data], w.bounds)

    at, hashes = k.windows(w, rules.window)
    flags = _shares(w, at, hashes, rules.window)
    n_repeat = k.per_text(flags, w.first)

    cuts = np.flatnonzero(w.data == 0x0A)
    line_starts = np.sort(np.concatenate([w.bounds[:-1], cuts + 1]))
    # a cut at the last byte of a text begins a line at the next text's bound; it belongs to the text of the cut
    own = np.sort(np.concatenate([np.arange(len(w.bounds) - 1), np.searchsorted(w.bounds, cuts, "right") - 1]))
    text = own
    line_ends = np.concatenate([line_starts[1:] - 1, w.bounds[-1:]])
    last = np.concatenate([text[1:] != text[:-1], [True]]) if len(text) else np.zeros(0, bool)
    line_ends[last] = w.bounds[text[last] + 1]
    n_in = np.searchsorted(w.starts, line_ends) - np.searchsorted(w.starts, line_starts)
    full = n_in > 0
    line_starts, line_ends, text = line_starts[full], line_ends[full], text[full]
    keys = k.mixed(k.spans_hash(w.data, line_starts, line_ends) + text.astype(np.uint64) * np.uint64(k.BASE))
    by = np.argsort(keys)  # of equal lines any but one counts as later: they have the same characters
    later = np.zeros(len(keys), bool)
    later[by[1:]] = keys[by][1:] == keys[by][:-1]
    n_dup_lines = np.bincount(text[later], minlength=len(n_words))
    dup_chars = np.zeros(len(n_words), np.int64)
    line_chars = char_sums[line_ends] - char_sums[line_starts]
    np.add.at(dup_chars, text[later], line_chars[later])

    total = np.maximum(word_chars, 1)
    all_chars = np.maximum(k.per_text(begins, w.bounds), 1)
    verdict = dup_chars / all_chars <= rules.dup_line_share
    verdict &= n_symbols <= rules.symbols_per_word * n_words
    coverage = {}
    window_flags = flags
    for size, most in rules.ngrams:
        if size == rules.window:
            flags = window_flags
        else:
            at, hashes = k.windows(w, size)
            flags = _shares(w, at, hashes, size)
        share = k.per_text(chars * flags, w.first) / total
        coverage[f"cover_{size}"] = share
        verdict &= share <= most
    failed = (n_words < rules.least_words) | (100 * n_repeat > rules.window_percent * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat, "base_failed": failed, "kept": ~failed & verdict, "dup_line_share": dup_chars / all_chars, **coverage,
    }


def measure(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its key, the measures, ``base_failed``, ``kept`` and the coverages."""
    source = docs.select(F.col(key), F.col(text).alias("_text"))
    covers = ", ".join(f"cover_{n} double" for n, _ in rules.ngrams)
    kind = source.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {MEASURES}, base_failed boolean, kept boolean, dup_line_share double, {covers}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in k.blocks(batch.column(1)):
                found = measure_block(part, rules)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *(pa.array(v) for v in found.values())], names=[key, *found])

    return source.mapInArrow(run, schema)


def filter_rows(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep. One pass, no shuffle."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in k.blocks(batch.column(at)):
                yield batch.slice(first, len(part)).filter(pa.array(measure_block(part, rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
