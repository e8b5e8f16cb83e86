"""Sharding, conversation repair and whitening against brute force, and on nulls, ties, repeats and odd columns."""

from __future__ import annotations

import collections
import functools
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import queries, repair, sharding, whitening

FOLDER = "/root/testdata/sf0.001"


# --- sharding ---------------------------------------------------------------


@pytest.mark.parametrize(("good", "bad", "sample"), [(7, 9, 6), (1, 30, 4), (40, 25, 50), (3, 3, 5), (0, 4, 2), (4, 0, 3), (5, 5, 0), (60, 90, 75)])
def test_hypergeometric_counts_follow_their_law(spark, good, bad, sample):
    n, longs = 20_000, [F.lit(x).cast("long") for x in (good, bad, sample)]
    drawn = spark.range(n).select(sharding.hypergeometric(*longs, lambda i: sharding._uniform(5, F.col("id"), i)).alias("x")).groupBy("x").count().collect()
    got = {r["x"]: r["count"] for r in drawn}
    chi, cells = 0.0, 0
    for x in range(max(0, sample - bad), min(good, sample) + 1):
        p = n * math.comb(good, x) * math.comb(bad, sample - x) / math.comb(good + bad, sample)
        if p >= 5:
            chi, cells = chi + (got.get(x, 0) - p) ** 2 / p, cells + 1
    assert all(max(0, sample - bad) <= x <= min(good, sample) for x in got) and chi < cells + 5 * math.sqrt(2 * cells) + 3


def test_hypergeometric_hat_covers_the_law():
    log = lambda z, low, high, m: -sum(math.lgamma(v + 1) for v in (z, low - z, m - z, high - m + z))
    rng = random.Random(2)
    cases = [(low, high, m) for low in range(1, 14) for high in (low, low + 3, 5 * low) for m in range(1, (low + high) // 2 + 1)]
    cases += [(low := rng.randrange(11, 900), high := rng.randrange(low, 9000), rng.randrange(1, min(900, (low + high) // 2) + 1)) for _ in range(150)]
    for low, high, m in cases:
        n = low + high
        spread, centre = math.sqrt((n - m) * m * (low / n) * (high / n) / (n - 1) + 0.5), m * low / n + 0.5
        mode = (m + 1) * (low + 1) // (n + 2)
        reach = max(max(abs(z - centre), abs(z + 1 - centre)) * math.exp((log(z, low, high, m) - log(mode, low, high, m)) / 2) for z in range(min(m, low) + 1))
        assert reach <= (sharding.WIDE * spread + sharding.MORE) / 2


def test_hypergeometric_at_large_counts(spark):
    good, bad, m = 10**10, 3 * 10**10, 2 * 10**9
    longs = [F.lit(x).cast("long") for x in (good, bad, m)]
    row = spark.range(20_000).select(sharding.hypergeometric(*longs, lambda i: sharding._uniform(9, F.col("id"), i)).alias("x")).agg(F.avg("x").alias("mean"), F.stddev("x").alias("dev")).first()
    n = good + bad
    dev = math.sqrt(m * 0.25 * 0.75 * (n - m) / (n - 1))
    assert abs(row["mean"] - m / 4) < 5 * dev / math.sqrt(20_000) and abs(row["dev"] / dev - 1) < 0.03


def test_matrix_has_both_margins(spark):
    rng = random.Random(4)
    parts = {p: rng.randrange(1, 900) for p in rng.sample(range(5000), 300)}
    n = sum(parts.values())
    sizes = [n // 5 + (s < n % 5) for s in range(5)]
    counts = spark.createDataFrame(list(parts.items()), "part long, n long")
    rows = {r["part"]: r["dealt"] for r in sharding.matrix(counts, F.array(*map(F.lit, sizes)), 3).collect()}
    assert {p: sum(v) for p, v in rows.items()} == parts and [sum(v[s] for v in rows.values()) for s in range(5)] == sizes
    chi = sum((v[s] - parts[p] / 5) ** 2 / (parts[p] / 5) for p, v in rows.items() for s in range(5) if parts[p] > 50)
    freedom = 4 * sum(x > 50 for x in parts.values())
    assert abs(chi - freedom) < 6 * math.sqrt(2 * freedom)
    assert not sharding.matrix(counts.limit(0), F.array(F.lit(0)), 3).count()


def test_shuffle_is_exact_and_uniform(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 40)
    n, shards = 3001, 7
    df = spark.range(n).select("id", F.lit("same").alias("text"), F.lit(None).cast("string").alias("slot"), F.lit(1).alias("_shard"), F.lit(2).alias("_row")).repartition(13)
    rows = sharding.shuffled(df, shards, 1).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append((r["slot"], r["id"]))
    assert set(rows[0].asDict()) == {"id", "text", "slot", "_shard", "_row", "shard"} and sorted(r["id"] for r in rows) == list(range(n))
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in by.values()) and [len(by[s]) for s in range(shards)] == [n // shards + (s < n % shards) for s in range(shards)]
    # neither shard nor slot follows the place in the input: chi-square over a grid of input tenths
    grid = collections.Counter((r["id"] * 10 // n, r["shard"]) for r in rows)
    chi = sum((grid[i, s] - n / 70) ** 2 / (n / 70) for i in range(10) for s in range(shards))
    half = collections.Counter((r["id"] * 10 // n, r["slot"] * 2 * shards // n) for r in rows)
    chi_slot = sum((half[i, h] - n / 20) ** 2 / (n / 20) for i in range(10) for h in range(2))
    assert 15 < chi < 110 and chi_slot < 35
    assert {(r["id"], r["shard"], r["slot"]) for r in sharding.shuffled(df, shards, 2).collect()} != {(r["id"], r["shard"], r["slot"]) for r in rows}


def test_shuffle_of_few_and_no_rows(spark, tmp_path):
    few = spark.createDataFrame([(1, None), (1, None), (2, "")], "doc_id long, text string")
    rows = sharding.shuffled(few, 5).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(0, 0), (1, 0), (2, 0)] and sorted(r["doc_id"] for r in rows) == [1, 1, 2]
    assert sharding.shuffled(few.limit(0), 5).count() == 0 and sharding.shuffled(few.limit(0), 5).columns == ["doc_id", "text", "shard", "slot"]
    sharding.write_shards(sharding.shuffled(few, 2), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 2


def test_sharding_query(spark):
    import zlib

    rows = queries.op11_sharding(spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {k: (len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in texts.items()}
    sizes = collections.Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1 and {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


# --- conversation repair -----------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) by looking at every list of edits, cheapest and least first."""
    seen, faults, turns = set(), [], [t for t, _, _ in rows if t is not None]
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))

    @functools.cache
    def best(at, state, inserted):
        """The least (cost, audit, lines) from row ``at`` on, after roles that end in ``state``."""
        ways = []
        follow = {"": "ua"[0], "s": "u", "u": "a", "a": "u"}[state]
        full = {"u": "user", "a": "assistant"}[follow]
        if at == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 2:
            c, a, lines = best(at, follow, inserted + 1)
            ways.append((c + 2, "I" + a, (f"{full}:", *lines)))
        if at < len(rows):
            _, role, text = rows[at]
            cut = faults[at] == "truncated"
            c, a, lines = best(at + 1, state, 0)
            ways.append((c + 3, "D" + a, lines))
            if faults[at] not in ("blank", "duplicate"):
                if role[:1] == follow or (role[:1] == "s" and state == ""):
                    c, a, lines = best(at + 1, role[:1], 0)
                    ways.append((c + cut, "K" + a, (f"{role}:{text}", *lines)))
                c, a, lines = best(at + 1, follow, 0)
                ways.append((c + 2 + cut, "R" + a, (f"{full}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    count = collections.Counter(faults)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), list(lines)


def conversations(rng, n):
    texts = ["Yes.", "no", "So!  \n", " ", "", "Really?", "half a", "Well. Then", "é.", "."]
    out = {}
    for c in range(n):
        rows = [(rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "usher"]), rng.choice([*texts, f"text {rng.random()}.", f"text {rng.random()}."])) for _ in range(rng.randrange(1, 26))]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        out[c if c else None] = rows
    return out


@pytest.mark.parametrize("least", [None, 2])
def test_repair_equals_brute_force(spark, least):
    made = conversations(random.Random(7 if least else 8), 60)
    rows = [(c, *r, "x", 1) for c, rs in made.items() for r in rs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string, _key int")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(df, least=least).collect()}
    want = {c: brute_repair(rs) for c, rs in made.items()}
    assert got == {c: w[:-1] for c, w in want.items()}
    lines = collections.defaultdict(list)
    for r in sorted(repair.repaired(df, least).collect(), key=lambda r: r["place"]):
        assert r["place"] == len(lines[r["conv_id"]])
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: lines[c] for c in made} == {c: w[-1] for c, w in want.items()}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in v)) for v in lines.values())


def test_walks_through_blocks_are_those_of_the_whole():
    rng = random.Random(3)
    for _ in range(300):
        rows = "".join(rng.choice("suaoSUAObd") for _ in range(rng.randrange(1, 30)))
        whole, _ = repair.walk(rows, repair.END, repair.START, True)
        size = rng.randrange(1, 9)
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        ends = repair._checkpoints([[x for row in repair.through(p) for x in row] for p in parts])
        state, out = repair.START, ""
        for i, (p, end) in enumerate(zip(parts, ends, strict=True)):
            edits, state = repair.walk(p, tuple(end), state, i + 1 == len(parts))
            out += edits
        assert out == whole


def test_repair_of_a_hot_conversation_uses_many_blocks(spark):
    rng = random.Random(5)
    hot = [(1, t, rng.choice(["user", "assistant"]), f"{rng.randrange(900)}.") for t in range(3000)]
    df = spark.createDataFrame([*hot, (2, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    blocks = repair.blocks_of(repair.placed(df), 16).collect()
    assert max(len(b["classes"]) for b in blocks) == 55 and len(blocks) == 56
    got = {r["conv_id"]: r for r in repair.report(df, least=16).collect()}
    one = {r["conv_id"]: r for r in repair.report(df, least=5000).collect()}
    assert got == one and got[1]["audit"].count("D") == got[1]["duplicate"] > 100


def test_repair_of_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, None, "user", "x." * 200_000), (2, 5, "assistant", "So.")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:8] for r in repair.report(df, df.select("conv_id").union(spark.createDataFrame([(9,), (None,)], "conv_id long"))).collect()}
    assert got == {1: (0, 1, 0, 0, 1, 5, "DKI"), 2: (0, 0, 0, 0, 0, 2, "IK"), 9: (0,) * 6 + ("",), None: (0,) * 6 + ("",)}
    assert repair.report(df.limit(0)).count() == 0 and repair.repaired(df.limit(0)).count() == 0


def test_damage_by_crc(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in (None, *range(30)) for t in (None, 0, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = collections.Counter()
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault:
            want[c, t, "user" if fault == 4 else role, {1: "", 2: "One Two"}.get(fault, text)] += 2 if fault == 3 else 1
    assert collections.Counter(map(tuple, repair.damaged(df).collect())) == want


# --- whitening -----------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40, 90])
def test_leading_eigenpairs_equal_those_of_the_library(n):
    b = np.random.default_rng(n).standard_normal((n, n))
    a = b @ b.T
    values, vectors = whitening.leading(a, 8)
    want, q = np.linalg.eigh(a)
    want, q = want[::-1][:8], q[:, ::-1][:, :8].T
    assert np.allclose(values, want, rtol=0, atol=1e-13 * want[0]) and np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-13)
    assert np.abs(np.abs((vectors * q).sum(axis=1)) - 1).max() < 1e-9


def test_clusters_ties_and_zeros_give_orthonormal_vectors():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((64, 64)))
    near = q @ np.diag(np.r_[[100.0] * 4, [100 + 1e-9] * 4, np.ones(56)]) @ q.T
    chain = np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)  # pairs of values that agree to 15 digits
    for a in (near, chain, np.eye(9), np.zeros((5, 5)), np.ones((12, 12)), np.diag([5.0, 5, 5, 1, 0, 0, 0, 0, 0, 0])):
        values, vectors = whitening.leading(a, 8)
        scale = max(values[0], 1)
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12) and np.abs(a @ vectors.T - vectors.T * values).max() < 1e-12 * scale


def test_sturm_counts():
    d, e = np.array([2.0, 0, 1, 5]), np.array([1.0, 0, 3])
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-5, 9, 57)
    assert list(whitening.below(d, e, at)) == [int((values < x).sum()) for x in at]


def test_whitening_query_equals_numpy(spark):
    rows = queries.op13_whitening(spark, FOLDER).collect()
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in r["embedding"]] for r in table])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    v = centred.T @ centred / n
    values, q = np.linalg.eigh(v)
    values, q = values[::-1], q[:, ::-1]
    by = {r["vec_id"]: i for i, r in enumerate(table)}
    got = np.zeros((n, 8))
    for r in rows:
        got[by[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == int(((n * x[by[r["vec_id"]]] - sums) ** 2).sum()) and abs(r["explained"] / (values[r["component"] - 1] / v.trace()) - 1) < 1e-9 and r["identity_error"] < 1e-9
    assert len(rows) == 8 * n and len({r["identity_error"] for r in rows}) == 1
    want = centred @ q[:, :8] / np.sqrt(values[:8])
    assert np.allclose(got, want * np.sign((got * want).sum(axis=0)), atol=1e-7)


def test_whitening_of_nulls_odd_vectors_and_repeats(spark):
    rng = np.random.default_rng(2)
    good = [[float(c) for c in rng.standard_normal(3)] for _ in range(30)]
    rows = [(i, v, "a") for i, v in enumerate(good)] + [(0, good[0], "a"), (90, None, None), (91, [1.0, None, 2.0], "b"), (92, [float("nan"), 1.0, 2.0], "b"), (93, [float("inf"), 1.0, 2.0], "b"), (94, [], "b"), (95, [1.0], "b"), (None, [1.0, 2.0, 1e17], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string").withColumn("odd name", F.lit(1))
    out, model, error = whitening.whiten(df, components=8)
    got = out.collect()
    assert out.columns == ["vec_id", "embedding", "odd name", "whitened", "deviation"] and sorted(r["vec_id"] for r in got) == [0, *range(30)] and model.n == 31 and len(model.values) == 3 and error < 1e-12
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    out, model, error = whitening.whiten(same)
    assert [(r["vec_id"], r["whitened"], r["deviation"]) for r in sorted(out.collect())] == [(1, [], 0), (2, [], 0)] and error == 0.0
    out, model, error = whitening.whiten(same.limit(0))
    assert out.count() == 0 and model.n == 0 and out.columns == ["vec_id", "embedding", "whitened", "deviation"]


def test_deviations_are_exact_at_any_size():
    sums = (3 * 100_000 + 7, 3 * 100_000 - 5)
    x = whitening._whole(np.array([[0.5, -0.25], [2.0**50, -(2.0**49)]]))
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert list(map(int, whitening._squares(np.array([[0.5, -0.25], [2.0**50, -(2.0**49)]]), 3, sums))) == want
    assert list(map(int, whitening._squares(np.array([[0.5, -0.25]]), 3, sums))) == want[:1]


# --- substring dedup of forms -----------------------------------------------------------------


def test_windows_of_a_form_with_one_varying_word_are_dealt_out_apart(spark):
    """50,000 forms of 30 fixed words, a name and 30 fixed words: no shard holds more than one distinct window."""
    from eventloom.llm import substring_dedup as sd

    head, tail = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    forms = spark.range(50_000).select(F.lit(5).cast("long").alias("anchor"), F.col("id").alias("d1"), F.col("id").alias("d2"), F.concat(F.lit(f"{head} n"), F.col("id"), F.lit(f" {tail}")).cast("binary").alias("words"), F.lit(1).cast("long").alias("times"))
    shards = sd._windows(forms, 35).groupBy("shard").agg(F.count_distinct("words").alias("n")).groupBy("n").count().collect()
    assert [(r["n"], r["count"]) for r in shards] == [(1, 50_000 * 27)]


def test_an_automaton_holds_a_bound_of_words_and_one_shard():
    from eventloom.llm import substring_dedup as sd

    rng = random.Random(1)
    rows = [(shard, ["w"] * 62) for shard in range(3000) for _ in range(rng.randrange(1, sd.TEXTS + 1))]
    held = list(sd.together(iter(rows)))
    assert [r for h in held for r in h] == rows and max(sum(len(r[-1]) for r in h) for h in held) <= sd.SHARD + sd.TEXTS * 62
    assert all(a[-1][0] != b[0][0] for a, b in zip(held, held[1:], strict=False)) and not list(sd.together(iter([])))


def test_substring_dedup_of_forms(spark):
    from eventloom.llm import substring_dedup as sd

    rng = random.Random(2)
    head, tail = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    names = [f"n{rng.randrange(300)}" for _ in range(400)]
    texts = [" ".join([*head, name, *tail, f"own{i}"]) for i, name in enumerate(names)]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in sd.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    shared = {n for n, c in collections.Counter(names).items() if c > 1}
    assert got == {i: ((61, f"own{i}") if n in shared else (0, t)) for i, (n, t) in enumerate(zip(names, texts, strict=True))}
