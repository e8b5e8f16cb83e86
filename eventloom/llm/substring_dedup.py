r"""Substring deduplication by suffix automata of reference shards (operator 1).

A window of ``size`` consecutive words that also starts anywhere else in the corpus is repeated,
and every word that a repeated window covers goes. The corpus is its own reference, so automata of
all of it would grow with it: broadcasting them to every task, and streaming every document past
every one of them, costs the square of the corpus. The reference is therefore dealt out instead, so
that shards stay small and each text streams through the one shard that can match it:

1. Anchors. Each window is led by the smallest hash among its ``GRAM``-word grams (leftmost of
   equals). Consecutive windows with the same leading gram form a run, so equal windows lie in
   runs with equal anchors. Runs whose anchor leads no other run hold no repeated window.
2. The other runs' texts are fetched, and equal ones of an anchor are counted as one text with its
   number of occurrences, before they move. Texts are compared by their words.
3. The distinct texts of an anchor are a reference shard: it becomes a suffix automaton of words, its
   texts stream through it, and the occurrences of each match of ``size`` words or more tell which
   windows are repeated. A task makes one automaton of several anchors, up to ``SHARD`` words.
4. An anchor with more than ``TEXTS`` distinct texts (the edge of a passage that very many documents
   share, or a form with one varying word) would make a shard large: its windows are dealt out again by all their
   grams beside the anchor, from the first word to the last, and equal ones are counted as one. Windows that differ in
   any word part there, so such a shard holds one distinct window, however many documents share the rest of it. Shards of
   step 3 hold at most ``TEXTS`` texts of at most 3 * size words. So no automaton exceeds ``SHARD`` words and one shard.
5. The repeated spans are gathered by document and the texts rewritten.

Whether words go is decided by automata on words alone. Hashes bring together what may be equal: two
texts of one anchor whose 128-bit digests agree though their words differ are found out and judged
as not repeated, so a collision removes nothing.

``remove_reference`` is the plain form for a bounded outside reference: its automata, in shards
of at most ``SHARD`` words, are broadcast one after the other.

Shuffles: a narrow row for each run (about a fifteenth of the words) twice; the distinct texts of
shared runs; and the texts of documents that have shared runs, to fetch them and to be rewritten. The
other documents pass by unmoved, told apart by a broadcast bitmap of keys that has one size for any
corpus (``_shared.parted``). All joins are of two written tables, which Spark splits where a key is hot. Memory: a block of
texts or the longest text, one shard, and a document with its spans.

A null or empty text has no words. Rows that share a doc_id are documents of their own, told
apart by their text; identical rows repeat each other, and all are returned. A null doc_id is
kept. An empty table gives an empty result; extra columns pass through ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import _kernels as k
from eventloom.llm._shared import kept, parted, small_or_shuffled

SIZE, GRAM = 35, 8
#: A shard's distinct texts of one anchor, and its words.
TEXTS, SHARD = 64, 50_000
#: Anchors or digests beyond this number are joined by a shuffle.
MOST_BROADCAST = 500_000
U = np.uint64


class SuffixAutomaton:
    """Suffix automaton of word sequences, each added with its number of occurrences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, next_: dict, link: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, word) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def add(self, words: Iterable, times: int = 1) -> None:
        last = 0
        for word in words:
            p = last
            q = self.next[p].get(word)
            if q is not None:  # an earlier sequence went this way
                last = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
            else:
                last = self._state(self.length[p] + 1, {}, 0)
                while p >= 0 and (q := self.next[p].get(word)) is None:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
            self.count[last] += times

    def seal(self) -> None:
        """Sums occurrences over the suffix links; call it after the last ``add``."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def statistics(self, words: Iterable) -> Iterator[tuple[int, int]]:
        """(length of the longest match that ends at the word, its state) of each word."""
        s = n = 0
        for word in words:
            while s and word not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if word in self.next[s]:
                s = self.next[s][word]
                n += 1
            yield n, s

    def repeated(self, words: list, size: int, least: int = 2) -> np.ndarray:
        """Which windows of ``size`` words (by their first word) occur ``least`` times or more."""
        out = np.zeros(max(0, len(words) - size + 1), bool)
        link, length, count = self.link, self.length, self.count
        for at, (n, s) in enumerate(self.statistics(words)):
            if n >= size:
                while length[link[s]] >= size:
                    s = link[s]
                out[at - size + 1] = count[s] >= least
        return out


def _least_in(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest of each ``span`` consecutive values and its (leftmost) place."""
    n = len(values) - span + 1
    value, place, have = values, np.arange(len(values)), 1

    def joined(by: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        right = value[by : by + n] < value[:n]
        return np.where(right, value[by : by + n], value[:n]), np.where(right, place[by : by + n], place[:n])

    while have < span:
        by = min(have, span - have)
        value, place = joined(by, len(value) - by)
        have += by
    return value[:n], place[:n]


def runs_of(w: k.Words, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first word, number of windows, anchor) of every run."""
    n = len(w.hashes) - size + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty.astype(U)
    m = len(w.hashes) - gram + 1
    grams = w.hashes[:m].copy()
    for j in range(1, gram):
        grams *= U(k.BASE)
        grams += w.hashes[j : j + m]
    value, place = _least_in(k.mixed(grams), size - gram + 1)
    valid = w.text[:n] == w.text[size - 1 :]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = np.append(np.flatnonzero(new | ~valid), n)
    count = stop[np.searchsorted(stop, first, "right")] - first
    return first, count, value[first]


def text_digest(words: bytes) -> tuple[int, int]:
    """128 bits that name a text among those of its anchor."""
    digest = hashlib.blake2b(words, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _runs(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """(_k, _h, start, n, anchor) of the runs of rows (_k, _h, _t)."""
    kind = rows.schema["_k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in k.blocks(batch.column(2)):
                w = k.words(part)
                first, count, anchor = runs_of(w, size, gram)
                row = pa.array(w.text[first] + at)
                start = (first - w.first[w.text[first]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(start), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64))],
                    names=["_k", "_h", "start", "n", "anchor"],
                )

    return rows.mapInArrow(run, f"_k {kind}, _h long, start int, n int, anchor long")


def _run_texts(wanted: DataFrame, size: int) -> DataFrame:
    """(_k, _h, start, n, anchor, d1, d2, words) of rows (_k, _h, _t, wanted array<struct<start, n, anchor>>)."""
    kind = wanted.schema["_k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                row, spans, names, texts = [], [], [], []
                for i, (text, own) in enumerate(zip(part.column(2), part.column(3).to_pylist(), strict=True)):
                    words = (text.as_py() or "").encode().split()
                    for s in own:
                        row.append(i)
                        spans.append((s["start"], s["n"], s["anchor"]))
                        texts.append(b" ".join(words[s["start"] : s["start"] + s["n"] + size - 1]))
                        names.append(text_digest(texts[-1]))
                take = pa.array(row, pa.int64())
                columns = [pa.array([x[c] for x in spans], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64()))] + [pa.array([x[c] for x in names], pa.int64()) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *columns, pa.array(texts, pa.binary())], names=["_k", "_h", "start", "n", "anchor", "d1", "d2", "words"])

    return wanted.mapInArrow(run, f"_k {kind}, _h long, start int, n int, anchor long, d1 long, d2 long, words binary")


def _windows(texts: DataFrame, size: int) -> DataFrame:
    """(shard, d1, d2, words, times, anchor, t1, t2, at) of every window of rows (anchor, d1, d2, words, times), whose
    digest is (t1, t2) now; a shard is what agrees in the anchor and in every gram, so in every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                out: list[tuple] = []
                for anchor, t1, t2, text, times in zip(*(c.to_pylist() for c in batch.slice(start, 500).columns), strict=True):
                    words = text.split(b" ")
                    for at in range(len(words) - size + 1):
                        joined = b" ".join(words[at : at + size])
                        d1, d2 = text_digest(joined)
                        out.append((anchor ^ d2, d1, d2, joined, times, anchor, t1, t2, at))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                columns = zip(*out, strict=True) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "d1", "d2", "words", "times", "anchor", "t1", "t2", "at"])

    return texts.select("anchor", "d1", "d2", "words", "times").mapInArrow(run, "shard long, d1 long, d2 long, words binary, times long, anchor long, t1 long, t2 long, at int")


def together(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows (shard, …, words) that come by shard, as lists for one automaton each: whole shards, one more until ``SHARD`` words are reached."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        if total >= SHARD and row[0] != held[-1][0]:
            yield held
            held, total = [], 0
        held.append(row)
        total += len(row[-1])
    if held:
        yield held


def _judged(texts: DataFrame, size: int) -> DataFrame:
    """(shard, d1, d2, mask binary): which windows of the distinct texts (shard, d1, d2, words, times) are repeated, by
    automata of shards; texts without one have no row."""
    dealt = texts.select("shard", "d1", "d2", "times", "words").repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(held: list[tuple]) -> pa.RecordBatch:
            automaton = SuffixAutomaton()
            for *_, times, words in held:
                automaton.add(words, times)
            automaton.seal()
            found = [(*names, np.packbits(mask).tobytes()) for *names, _, words in held if (mask := automaton.repeated(words, size)).any()]
            columns = zip(*found, strict=True) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "d1", "d2", "mask"])

        pieces = (batch.slice(start, 2000) for batch in batches for start in range(0, batch.num_rows, 2000))
        rows = ((shard, d1, d2, times, words.split(b" ")) for piece in pieces for shard, d1, d2, times, words in zip(*(c.to_pylist() for c in piece.columns), strict=True))
        yield from map(judged, together(rows))

    return dealt.mapInArrow(run, "shard long, d1 long, d2 long, mask binary")


def _told_apart(texts: DataFrame, name: str) -> DataFrame:
    """``texts`` (shard, d1, d2, words, …) without those of one shard and digest whose words differ."""
    key = ["shard", "d1", "d2"]
    clash = kept(texts.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(*key), name)
    return texts.join(small_or_shuffled(clash, clash.count(), MOST_BROADCAST), key, "left_anti")


def _parted(rows: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (_k, _h, …) that may have a row in ``spans``, and those that have none."""
    return parted(rows, F.xxhash64("_k", "_h"), spans, F.xxhash64("_k", "_h"))


def _met(rows: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Documents (_k, _h, …) joined with spans of these keys, by a sort-merge join at every size."""
    right = spans.withColumnsRenamed({"_k": "_k2", "_h": "_h2"}).hint("merge")
    return rows.join(right, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_h") == F.col("_h2")), how)


def repeated_spans(docs: DataFrame, size: int = SIZE, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_k, _h, spans): for documents with repeated windows, their runs as array<struct<start, n, mask,
    ats>>; windows are marked in the mask or listed in ats. _h is the text's hash."""
    rows = docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_h"), F.col(text).alias("_t"))
    runs = kept(_runs(rows.where(F.col("_t").isNotNull()), size, gram), "substring-runs")
    anchors = kept(runs.groupBy("anchor").agg(F.count("*").alias("of")).where(F.col("of") > 1).select("anchor"), "substring-anchors")
    # rows that share key and text have the same runs; the texts are fetched for each of them
    found = runs.join(anchors, "anchor").groupBy("_k", "_h").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("wanted"))
    wanted = kept(found, "substring-wanted")
    fetched = _met(_parted(rows, wanted)[0], wanted, "inner")
    texts = kept(_run_texts(fetched.select("_k", "_h", "_t", "wanted"), size), "substring-texts")

    distinct = kept(texts.groupBy("anchor", "d1", "d2", "words").agg(F.count("*").alias("times")).withColumnRenamed("anchor", "shard"), "substring-distinct")
    wide = kept(distinct.groupBy("shard").agg(F.count("*").alias("of")).where(F.col("of") > TEXTS).select("shard"), "substring-wide")
    apart, few = _told_apart(distinct, "substring-clashes"), small_or_shuffled(wide, wide.count(), MOST_BROADCAST)
    plain = _judged(apart.join(few, "shard", "left_anti"), size).withColumnRenamed("shard", "anchor")
    windows = _windows(apart.join(few, "shard", "left_semi").withColumnRenamed("shard", "anchor"), size)
    pieces = kept(windows.groupBy("shard", "d1", "d2", "words").agg(F.sum("times").alias("times")), "substring-pieces")
    again = kept(_judged(_told_apart(pieces, "substring-piece-clashes"), size).select("shard", "d1", "d2"), "substring-again")
    ats = windows.select("shard", "d1", "d2", "anchor", "t1", "t2", "at").join(again, ["shard", "d1", "d2"]).groupBy("anchor", F.col("t1").alias("d1"), F.col("t2").alias("d2")).agg(F.collect_set("at").alias("ats"))
    none = {"mask": F.lit(None).cast("binary"), "ats": F.lit(None).cast("array<int>")}
    masks = kept(plain.withColumn("ats", none["ats"]).unionByName(ats.withColumn("mask", none["mask"])), "substring-masks")

    judged = texts.select("_k", "_h", "start", "n", "anchor", "d1", "d2").join(masks, ["anchor", "d1", "d2"])
    return judged.groupBy("_k", "_h").agg(F.collect_set(F.struct("start", "n", "mask", "ats")).alias("spans"))


def removed_words(n_words: int, spans: list[dict] | None, size: int) -> np.ndarray:
    """Which words of a document its repeated windows cover."""
    steps = np.zeros(n_words + 1, np.int64)
    for s in spans or []:
        if s["ats"] is not None:
            at = np.asarray(s["ats"]) + s["start"]
        else:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(s["mask"], np.uint8), count=s["n"])) + s["start"]
        np.add.at(steps, at, 1)
        np.add.at(steps, at + size, -1)
    return np.cumsum(steps[:-1]) > 0


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``text`` replaced by the kept words joined by one space, and n_words
    and n_removed, which replace columns of these names."""
    spans = kept(repeated_spans(docs, size, gram, key, text), "substring-spans")
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(F.lit(0).alias("_sd_0"), *others).alias("_rest"), F.col(key).alias("_k"), F.xxhash64(text).alias("_h"), F.col(text).alias("_t"))
    maybe, without = _parted(rows, spans)
    without = without.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    both = without.select("_rest", "_t", "spans").unionByName(_met(maybe, spans, "left").select("_rest", "_t", "spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, texts = [], [], []
            for value, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = (value.as_py() or "").encode().split()
                gone = removed_words(len(words), spans.as_py(), size)
                n.append(len(words))
                removed.append(int(gone.sum()))
                texts.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=["_rest", "_new", "n_words", "n_removed"])

    rest = rows.schema["_rest"].dataType.simpleString()
    made = both.select("_rest", "_t", "spans").mapInArrow(run, f"_rest {rest}, _new string, n_words long, n_removed long")
    return made.select(*[(F.col("_new") if c == text else F.col("_rest")[c]).alias(c) for c in docs.columns if c not in ("n_words", "n_removed")], "n_words", "n_removed")


def remove_reference(docs: DataFrame, reference: list[str], size: int = SIZE, text: str = "text") -> DataFrame:
    """``docs`` without the words inside matches of ``size`` words or more with a reference text.

    The reference is bounded by the caller; shards of at most ``SHARD`` words (or one text) are
    broadcast as automata, and every document streams through each for its matching statistics.
    """
    shards, held = [], []
    for t in reference:
        held.append((t or "").encode().split())
        if sum(map(len, held)) >= SHARD:
            shards.append(held)
            held = []
    shards += [held] if held else []
    sent = [docs.sparkSession.sparkContext.broadcast(s) for s in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for shard in sent:
            automaton = SuffixAutomaton()
            for words in shard.value:
                automaton.add(words)
            automata.append(automaton)
        for batch in batches:
            at, texts = batch.schema.get_field_index(text), []
            for value in batch.column(at):
                words = (value.as_py() or "").encode().split()
                gone = np.zeros(len(words), bool)
                for automaton in automata:
                    for i, (n, _) in enumerate(automaton.statistics(words)):
                        if n >= size:
                            gone[i + 1 - n : i + 1] = True
                texts.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
