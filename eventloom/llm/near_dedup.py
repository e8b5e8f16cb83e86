r"""MinHash near-duplicate detection by a multi-index Hamming join (operator 10).

A document's set holds its distinct shingles of five words; documents with equal sets form a
class, represented by its smallest id, and only representatives are compared. A signature has
``CHUNKS * ROWS`` b-bit min-hash values (b = 8); it is split into chunks, and for each chunk every
way of ignoring ``ERRORS`` of its values is a key (an index of its own). By the pigeonhole
principle two signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` values share a key:
all pairs under that distance are found (23 of 84 values; two sets of similarity 0.85 differ in
12.6 on average, standard deviation 3.3). A pair beyond it is still found unless every chunk has two
errors or more: at similarity 0.85 a pair is missed with probability 3e-7.

A bucket (a key) may hold very many documents, so its pairs are never listed:

1. Keys are counted, aggregated before they move, and keys of one document dropped.
2. Each bucket has a hub, the member that shares most keys with others. A member is compared with
   the hub it meets in most buckets: one pair for each document, confirmed on full sets.
3. Components are formed from these links. Buckets inside one component need no more work. For
   the others the pairs between components are tested inside tasks, in blocks of at most
   ``BLOCK`` members a side, once for each pair of blocks. Signatures (84 bytes) go through the
   blocks first: of each block a task returns the members that have a partner within the distance
   in the first bucket that both share, no pairs. Only these members' full sets are then sent to
   their blocks, where pairs are confirmed, skipping those that earlier links of the block have
   joined. A task returns the links it needed, fewer than its members.
4. Components of all links give each document the smallest id that it reaches.

Tables that a hot key's rows meet are written before they are joined, so that a join has two plain
shuffles below it, which Spark splits where a key is hot. Components come from alternating large-star and small-star steps on tables: no link, label or
document goes through the driver. Full sets are made and moved for members of shared buckets only.

A null or empty text, or one without words, has an empty set and is linked with nothing. Rows that
share a doc_id are one component with that id and keep their own set sizes; ``kept`` is true for
all rows of the smallest id. Rows with a null doc_id are linked with nothing and kept, component null.
An empty table gives an empty result; extra columns pass through ``keep_one``. Ids are integers; other
ids are an error of the cast. Memory: a block of texts or the longest text, and two blocks of sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm import _kernels as k
from eventloom.llm._shared import kept, packed, parted, unpacked

SHINGLE, PERCENT = 5, 85
CHUNKS, ROWS, ERRORS = 12, 7, 1
VALUES = CHUNKS * ROWS
#: Signatures of pairs of this similarity differ in more values with probability below 1e-7.
FARTHEST = 32
BLOCK = 400
MOST_BROADCAST = 1_000_000
U = np.uint64
_random = np.random.default_rng(7)
FACTORS = _random.integers(0, 1 << 63, VALUES, dtype=np.uint64) * U(2) + U(1)
TERMS = _random.integers(0, 1 << 64, VALUES, dtype=np.uint64)
#: the values that each of a chunk's keys looks at
PICKS = [list(p) for p in itertools.combinations(range(ROWS), ROWS - ERRORS)]
SET = "_k long, _n int, _c1 long, _c2 long, _sig binary"


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles."""
    w = k.words(column, lower=True)
    at, hashes = k.windows(w, shingle)
    counts = w.counts
    for i in np.flatnonzero((counts > 0) & (counts < shingle)):  # the whole sequence as one
        words = w.hashes[w.first[i] : w.first[i + 1]]
        value = U(0)
        with np.errstate(over="ignore"):
            for h in words:
                value = value * U(k.BASE) + h
        at = np.append(at, w.first[i])
        hashes = np.append(hashes, k.mixed(np.array([value + U(len(words))], U)))
    order = np.lexsort((hashes, w.text[at])) if len(at) else np.zeros(0, np.int64)
    hashes, text = hashes[order], w.text[at][order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    ends = np.searchsorted(text, np.arange(len(counts) + 1))
    for a, b in itertools.pairwise(ends):
        yield hashes[a:b]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The b-bit min-hash values of a set."""
    least = np.full(VALUES, ~U(0), U)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * FACTORS + TERMS
        np.minimum(least, part.min(axis=0), out=least)
    return (k.mixed(least) >> U(56)).astype(np.uint8)


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_k, _n, class digest, signature) of every row; no signature for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in k.blocks(batch.column(1)):
                n, c1, c2, sig = [], [], [], []
                for hashes in shingle_sets(part):
                    digest = xxhash.xxh3_128_digest(hashes.tobytes())
                    n.append(len(hashes))
                    c1.append(int.from_bytes(digest[:8], "little", signed=True))
                    c2.append(int.from_bytes(digest[8:], "little", signed=True))
                    sig.append(signature(hashes).tobytes() if len(hashes) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(n, pa.int32()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(sig, pa.binary())], names=["_k", "_n", "_c1", "_c2", "_sig"])

    return docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t")).mapInArrow(run, SET)


def _keys(reps: DataFrame) -> DataFrame:
    """(key, _k): the index keys of every signature; a key's lowest 7 bits are its slot (chunk and pick)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = CHUNKS * len(PICKS)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in part.column(1)]).reshape(-1, CHUNKS, ROWS).astype(U)
                keys = np.zeros((len(sig), CHUNKS, len(PICKS)), U)
                for j, pick in enumerate(PICKS):
                    for p in pick:
                        keys[:, :, j] = keys[:, :, j] << U(8) | sig[:, :, p]
                keys = keys << U(7) | np.arange(per, dtype=U).reshape(CHUNKS, -1)  # the slot, below the values looked at
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), per))], names=["key", "_k"])

    return reps.select("_k", "_sig").mapInArrow(run, "key long, _k long")


def _full_sets(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """(_k, _set binary): the sets of the members, whose texts alone are read on."""
    few = members.count() <= MOST_BROADCAST
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t"), F.monotonically_increasing_id().alias("_r"))
    some = rows.join(F.broadcast(members) if few else members, "_k").select("_k", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in k.blocks(batch.column(1)):
                sets = pa.array([s.tobytes() for s in shingle_sets(part)], pa.binary())
                digests = [xxhash.xxh3_128_digest(s.as_buffer()) for s in sets]
                c1 = pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), c1, sets], names=["_k", "_c1", "_set"])

    return some.mapInArrow(run, "_k long, _c1 long, _set binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def components(nodes: DataFrame, links: DataFrame, name: str = "near-links") -> DataFrame:
    """(_k, _c): each node's smallest reachable node, over undirected links (a, b).

    Large-star and small-star steps until nothing changes; a step is a join of links with the
    least neighbour of each node, a narrow aggregate, so a hub's links are never gathered.
    """
    links = kept(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = (0, None)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where(F.col("a") != F.col("b"))
        links = kept(small.distinct(), name)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.groupBy("a").agg(F.min("b").alias("_c")).withColumnRenamed("a", "_k")
    return nodes.join(roots, "_k", "left").select("_k", F.coalesce("_c", "_k").alias("_c"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    a, b = (sets.select(F.col("_k").alias(x), F.col("_set").alias(f"_s{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "_sa", "_sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _near(rows: list[dict]) -> Iterator[tuple[int, np.ndarray, list[dict], list[dict]]]:
    """(i, js, left, right) of one pair of blocks: left member i has the partners js within the distance, in
    another component, and this is the first bucket that they share."""
    chunk, pick = divmod(rows[0]["key"] & 127, len(PICKS))
    same = rows[0]["side"] == 0
    left = [r for r in rows if r["side"] != 2]
    right = [r for r in rows if r["side"] != 1]
    if not left or not right:
        return
    sig = np.stack([np.frombuffer(r["_sig"], np.uint8) for r in right])
    comp = np.array([r["_c"] for r in right])
    for i, r in enumerate(left):
        differ = sig != np.frombuffer(r["_sig"], np.uint8)
        errors = differ.reshape(-1, CHUNKS, ROWS).sum(axis=2)
        first = (errors <= ERRORS).argmax(axis=1)
        near = (differ.sum(axis=1) <= FARTHEST) & (comp != r["_c"]) & (first == chunk)
        # of the keys of that chunk the first that both share: the only one if they differ in it
        near &= (errors[:, chunk] > 0) | (pick == 0)
        if same:
            near[: i + 1] = False
        if near.any():
            yield i, np.flatnonzero(near), left, right


def block_members(rows: list[dict]) -> list[dict]:
    """The members of one pair of blocks that have a partner to be confirmed, once for each side."""
    left_at, right_at, sides = set(), set(), ([], [])
    for i, js, left, right in _near(rows):
        left_at.add(i)
        right_at.update(js.tolist())
        sides = left, right
    found = {id(sides[0][i]): sides[0][i] for i in left_at} | {id(sides[1][j]): sides[1][j] for j in right_at}
    return list(found.values())


def block_links(rows: list[dict]) -> list[tuple[int, int]]:
    """Links between components within one pair of blocks of one bucket, enough to join what is linked."""
    parent: dict[int, int] = {r["_c"]: r["_c"] for r in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets: dict[int, np.ndarray] = {}
    found = []
    for i, js, left, right in _near(rows):
        r = left[i]
        for j in js:
            other = right[j]
            x, y = root(r["_c"]), root(other["_c"])
            if x == y:
                continue
            a, b = (sets.setdefault(q["_k"], np.frombuffer(q["_set"], U)) for q in (r, other))
            if similar(a, b):
                parent[max(x, y)] = min(x, y)
                found.append((r["_k"], other["_k"]))
    return found


def _by_block(blocks: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``work`` on the rows of each (key, u, v), as record batches; a task holds one pair of blocks."""
    dealt = blocks.select("key", "u", "v", *columns).repartition("key", "u", "v").sortWithinPartitions("key", "u", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        at = None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                for row in batch.slice(start, 500).to_pylist():
                    if (to := (row["key"], row["u"], row["v"])) != at:
                        if len(held) > 1 and (found := work(held)):
                            yield found
                        held, at = [], to
                    held.append(row)
        if len(held) > 1 and (found := work(held)):
            yield found

    return dealt.mapInArrow(run, schema)


def _member_batch(rows: list[dict]) -> pa.RecordBatch | None:
    found = block_members(rows)
    kinds = {"key": pa.int64(), "u": pa.int32(), "v": pa.int32(), "side": pa.int32(), "_k": pa.int64(), "_c": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in kinds.items()], names=list(kinds)) if found else None


def _link_batch(rows: list[dict]) -> pa.RecordBatch | None:
    found = block_links(rows)
    return _links(found) if found else None


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def label(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(every row's set: _k, _n, ...), (_k, component) of every id with a set."""
    sets = kept(_sets(docs, key, text), "near-sets")
    full = sets.where(F.col("_sig").isNotNull() & F.col("_k").isNotNull())
    classes = full.groupBy("_c1", "_c2").agg(F.min("_k").alias("_rep"), F.first("_sig").alias("_sig"))
    reps = kept(classes, "near-classes")
    copies = full.join(reps.select("_c1", "_c2", "_rep"), ["_c1", "_c2"]).select(F.col("_k").alias("a"), F.col("_rep").alias("b")).where(F.col("a") != F.col("b"))

    reps = reps.select(F.col("_rep").alias("_k"), "_c1", "_sig")
    keys = kept(_keys(reps), "near-keys")
    shared = kept(keys.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1), "near-shared")
    rows = kept(keys.join(shared, "key"), "near-rows")
    fame = kept(rows.groupBy("_k").agg(F.sum("size").alias("fame")), "near-fame")
    hubs = rows.join(fame, "_k").groupBy("key").agg(F.max(F.struct("fame", (-F.col("_k")).alias("_m"))).alias("hub")).select("key", (-F.col("hub._m")).alias("hub"))
    stars = rows.join(kept(hubs, "near-hubs"), "key").where(F.col("_k") != F.col("hub")).groupBy("_k", "hub").agg(F.count("*").alias("times"))
    pairs = stars.groupBy("_k").agg(F.max(F.struct("times", (-F.col("hub")).alias("_m"))).alias("best")).select(F.col("_k").alias("a"), (-F.col("best._m")).alias("b"))
    members = kept(fame.select("_k"), "near-members")
    chosen = reps.join(members, "_k").select("_k", "_c1", "_sig")
    bodies = kept(_full_sets(docs, members, key, text).join(chosen, ["_k", "_c1"]).dropDuplicates(["_k", "_c1"]).select("_k", "_sig", "_set"), "near-bodies")
    first = kept(_confirmed(pairs, bodies), "near-star")
    within = kept(components(members, first), "near-within")

    placed = rows.join(within, "_k")
    open_ = kept(placed.groupBy("key").agg(F.min("_c").alias("lo"), F.max("_c").alias("hi"), F.max("size").alias("size")).where(F.col("lo") != F.col("hi")).select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "near-open")
    own = placed.select("key", "_k", "_c").join(open_, "key").withColumn("own", F.pmod(F.xxhash64("_k"), F.col("blocks")).cast("int"))
    at = F.explode(F.expr("transform(sequence(0, blocks - 1), j -> struct(least(own, j) AS u, greatest(own, j) AS v, CASE WHEN j = own THEN 0 WHEN own < j THEN 1 ELSE 2 END AS side))"))
    signed = own.join(bodies.select("_k", "_sig"), "_k").select("key", "_k", "_c", "_sig", at.alias("x")).select("key", "_k", "_c", "_sig", "x.*")
    asked = kept(_by_block(signed, ["side", "_k", "_c", "_sig"], _member_batch, "key long, u int, v int, side int, _k long, _c long"), "near-asked")
    rest = kept(_by_block(asked.join(bodies, "_k"), ["side", "_k", "_c", "_sig", "_set"], _link_batch, "a long, b long"), "near-rest")
    links = first.unionByName(rest).unionByName(copies)
    return sets, components(full.select("_k").distinct(), links)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row."""
    sets, labels = label(docs, key, text)
    return sets.select("_k", "_n").join(labels, "_k", "left").select(
        F.col("_k").alias(key), F.col("_n").cast("long").alias("n_shingles"),
        F.coalesce("_c", "_k").alias("component_id"), F.coalesce(F.col("_c") == F.col("_k"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those whose component has a smaller id."""
    _, labels = label(docs, key, text)
    gone = kept(labels.where(F.col("_c") != F.col("_k")).select(F.col("_k").alias("_gone")), "near-gone")
    maybe, others = parted(packed(docs), F.xxhash64(F.col("_row")[key].cast("long")), gone, F.xxhash64("_gone"))
    return unpacked(others.unionByName(maybe.join(gone.hint("merge"), F.col("_row")[key] == F.col("_gone"), "left_anti")), docs.columns)
