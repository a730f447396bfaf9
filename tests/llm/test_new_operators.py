"""Hard negatives, mixing and periodic runs on small tables, odd rows included, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tidemark.llm import hard_negatives as H
from tidemark.llm import mixing as M
from tidemark.llm import periodic_runs as P

# Hard negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 64, 9), (33, 7, 65), (64, 64, 64), (100, 3, 130)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 20), 1 << 20, shape[:2]), rng.integers(-(1 << 20), 1 << 20, shape[1:])
    assert (H.strassen(a, b, 4) == a @ b).all()


def test_products_beyond_64_bits():
    a, b = np.array([[2.0**60, 3.0], [1.0, 1.0]]), np.array([[2.0**60, -1.0, 5.0]])
    assert H.products(a, b).tolist() == [[2**120 - 3], [2**60 - 1]]
    assert H.products(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0] * 3] * 2


def test_heaps_merge():
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(0, 6, (7, 40)), np.arange(100, 140)
    allowed = rng.random((7, 40)) < 0.7
    whole = H._best(scores, ids, allowed, 5)
    parts = [H._best(scores[:, k : k + 3], ids[k : k + 3], allowed[:, k : k + 3], 5) for k in range(0, 40, 3)]
    rng.shuffle(parts)
    heap = parts[0]
    for part in parts[1:]:
        heap = H.merged(heap, part)
    assert all((x == y).all() for x, y in zip(heap, whole, strict=True))
    as_object = H._best(scores.astype(object), ids, allowed, 5)
    assert all((x == y).all() for x, y in zip(as_object, whole, strict=True))


def vectors(n=330, dim=6, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5, 1.0]) + 0.01 * rng.randrange(3) for _ in range(dim)], rng.randrange(3)) for i in range(n)]
    odd = [(7, None, 1), (400, [1.0] * dim, None), (500, [1.0, None] + [0.0] * (dim - 2), 1), (600, [math.inf] + [0.0] * (dim - 1), 1), (601, [math.nan] * dim, 1)]
    return rows + odd + [(5, [1.0] * dim, 2), (5, [1.0] * dim, 2), (5, [1.0] * dim, 2), (11, [], 1), (12, [1.0], 0)]


def brute_negatives(rows):
    ok = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, va, la in ok:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v, strict=False)), i, label) for i, v, label in ok if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == la)[:5]:
            window = sorted(x for x in scored if x[2] != la and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(window, 1)]
    return Counter(out)


def mined(spark, rows, monkeypatch=None, **sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(H, k, v)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, score string").repartition(3)
    made = H.prepared(df)
    got = H.hard_negatives(made, made.where("vec_id % 100 = 0"))
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got.collect())


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    rows = vectors()
    want = brute_negatives(rows)
    assert want and mined(spark, rows) == want
    # Small blocks: many tiles, several anchor blocks, heaps merged within tasks and between them.
    assert mined(spark, rows, monkeypatch, BLOCK_ROWS=16, BLOCKS_A_TASK=2) == want


def test_hard_negatives_of_odd_tables(spark):
    assert not mined(spark, [(1, [1.0], 1)])
    assert not mined(spark, [(100, [1.0], 1)])
    assert not mined(spark, [(100, None, 1), (200, [1.0], None)])
    assert spark.createDataFrame([], "vec_id long, embedding array<float>, label int").transform(H.prepared).count() == 0
    # A null id is a candidate that comes last; equal anchors count once.
    rows = [(100, [1.0], 1), (100, [1.0], 1), (3, [1.0], 1), (None, [0.5], 2), (4, [0.5], 2)]
    assert mined(spark, rows) == Counter({(100, 3, 1, 4, 65536, 32768): 1, (100, 3, 2, None, 65536, 32768): 1})


def test_hard_negatives_sql(spark, tmp_path):
    rows = [r for r in vectors(260) if r[1] and r[0] != 5]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet' WHERE vec_id NOT IN (11, 12)")
    got = H.prepared(spark.read.parquet(str(tmp_path / "embeddings.parquet")).where("vec_id not in (11, 12)"))
    got = H.hard_negatives(got, got.where("vec_id % 100 = 0"))
    assert sorted(map(tuple, got.collect())) == sorted(db.sql(H.OP11_SQL).fetchall())


# Mixing

DOCS = "doc_id long, text string, source string, lang string, size long, _s string, _mix string"


def mixed_docs(n=400, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rng.randrange(0, 30))), rng.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(n)]
    rows += [(None, None, "a"), (None, "", None), (n, " \t\n", "none"), (7, "same words here", "a"), (7, "same words here", "a"), (8, "x " * 9000, "tiny"), (9, "one", "𝄞")]
    return [(*r, "en", 1, "mine", "mine") for r in rows]


def brute_targets(sizes, weights=(1, 2, 3), epochs=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, clamped = sum(sizes.values()), set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in clamped)
        free = [s for s in order if s not in clamped]
        share = {s: Fraction(rest * w[s], sum(w[f] for f in free)) for s in free}
        over = {s for s in free if share[s] >= epochs * sizes[s]}
        if not over:
            return {s: float(share.get(s, epochs * sizes[s])) for s in order}
        clamped |= over
        if len(clamped) == len(order):
            return {s: float(epochs * sizes[s]) for s in order}


@pytest.mark.parametrize("few", [4096, 4])
def test_mixing_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(M, "FEW_ROWS", few)
    rows = mixed_docs()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = M.mix(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += count(t)
    targets = brute_targets(sizes)
    assert Counter((r["doc_id"], r["source"], r["lang"], r["_s"], r["_mix"]["size"]) for r in got) == Counter((i, s, "en", "mine", count(t)) for i, t, s, *_ in rows)
    taken = defaultdict(int)
    for r in got:
        m = r["_mix"]
        assert m["source_size"] == sizes[r["source"]] and m["target"] == pytest.approx(targets[r["source"]], abs=1e-9)
        words = m["size"] * m["copies"] + m["part"]
        assert 0 <= m["part"] <= m["size"] and words <= 3 * m["size"]
        taken[r["source"]] += words
    assert all(abs(taken[s] - t) <= 0.5 for s, t in targets.items())
    # Whole repetitions differ by one pass at most, of which one document is cut.
    for s in sizes:
        assert sum(0 < r["_mix"]["part"] < r["_mix"]["size"] for r in got if r["source"] == s) <= 1
    again = M.mix(docs.repartition(5)).collect()
    key = lambda rs: Counter((r["doc_id"], r["source"], tuple(r["_mix"])) for r in rs)
    assert key(again) == key(got)
    other = M.mix(docs, seed=18).collect()
    assert key(other) != key(got)


def test_repeated_rows_are_dealt_exactly(spark):
    """Most rows of a source are equal: the cut lies among them, and takes exactly what is missing."""
    docs = spark.createDataFrame([(None, "one", "a")] * 900 + [(1, "w " * 1000, "b"), (2, "v", "c")], "doc_id long, text string, source string").repartition(4)
    got = M.mix(docs, weights=(3, 1, 1)).collect()
    sums = defaultdict(int)
    for r in got:
        sums[r["source"]] += r["_mix"]["size"] * r["_mix"]["copies"] + r["_mix"]["part"]
    assert sums == {"a": round(got[0]["_mix"]["target"]) if got[0]["source"] == "a" else sums["a"], "b": sums["b"], "c": 3}
    assert sum(sums.values()) == pytest.approx(1901, abs=2)


def test_mixed_texts_are_the_mix(spark):
    docs = spark.createDataFrame(mixed_docs(60), DOCS)
    plan = M.mix(docs).where("doc_id is not null and doc_id != 7").collect()
    want = Counter()
    for r in plan:
        want[r["doc_id"]] += r["_mix"]["size"] * r["_mix"]["copies"] + r["_mix"]["part"]
    texts = M.mixed_texts(docs)
    assert texts.columns == [c for c in docs.columns if c != "_mix"]
    got = defaultdict(int)
    for r in texts.where("doc_id is not null and doc_id != 7").collect():
        got[r["doc_id"]] += len((r["text"] or "").split())
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_mixing_of_odd_tables(spark):
    assert M.mix(spark.createDataFrame([], DOCS)).count() == 0
    (only,) = M.mix(spark.createDataFrame([(1, None, None, "en", 1, "a", "b")], DOCS)).collect()
    assert tuple(only["_mix"]) == (0, 0, 0.0, 0, 0)
    with pytest.raises(ValueError):
        M.water_fill(spark.createDataFrame([("a", 1, 1)], "_s string, size long, weight long"), 0)


# Periodic runs


def brute_runs(w, least=12):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and q < best.get((i, j + q), q + 1):
                best[i, j + q] = q
            i = max(j, i + 1)
    return sorted(((b, e - b, q) for (b, e), q in best.items()), key=lambda r: (r[0], r[2]))


def periodic_text(rng):
    kind = rng.randrange(7)
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(200))]
    if kind == 1:  # one repeated unit between other words
        u = [rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        return [rng.randrange(9) for _ in range(rng.randrange(20))] + u * rng.randrange(2, 6) + u[: rng.randrange(len(u))] + [rng.randrange(9) for _ in range(10)]
    if kind == 2:  # Fibonacci words hold as many runs as any
        a, b = [0], [0, 1]
        while len(b) < rng.randrange(50, 300):
            a, b = b, b + a
        return b
    if kind == 3:  # a square whose half is periodic itself
        u = ([rng.randrange(2) for _ in range(rng.randrange(1, 6))] * 100)[: rng.randrange(12, 120)]
        return [5] * rng.randrange(3) + u + u + [rng.randrange(2)] * rng.randrange(4)
    if kind == 4:
        return [x for _ in range(rng.randrange(1, 8)) for x in ([0] * rng.randrange(1, 40) + [1]) * rng.randrange(1, 4)]
    if kind == 5:
        x = [0]
        for _ in range(rng.randrange(1, 9)):
            x = x + [1 - c for c in x] if rng.random() < 0.5 else x + x
        return x[:400]
    u = ([rng.randrange(2) for _ in range(rng.randrange(1, 8))] * 60)[: rng.randrange(10, 150)]
    return ((u + [7] * rng.randrange(2)) * 4)[:400]


def test_runs_against_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        texts = [periodic_text(rng) for _ in range(rng.randrange(1, 9))]
        assert P.runs_of([np.array(t, dtype=np.int64) for t in texts]) == [brute_runs(t) for t in texts]


def test_runs_of_long_texts():
    one = np.zeros(30_000, dtype=np.int64)
    assert P.runs_of([one]) == [[(0, 30_000, 1)]]
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 1 << 40, 7_000)
    assert P.runs_of([np.concatenate([rng.integers(0, 9, 5), np.tile(unit, 3)[:20_000], [-5]])]) == [[(5, 20_000, 7_000)]]
    # Blocks of one word, parted by another: regions of period 1 within larger periods.
    w = np.array(([0] * 50 + [1]) * 200)
    assert sorted(P.runs_of([w])[0]) == sorted([(0, 10_200, 51)] + [(51 * k, 50, 1) for k in range(200)])


def test_periodic_runs_query(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{x}" for x in periodic_text(rng)) for _ in range(60)] + [None, "", "  \t", "one", " a " * 40, "x\x0by\x1fz " * 9, "word " * 3000]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(3, "a " * 30), (3, "a " * 30), (None, "b c " * 20), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, n_runs int, start string")
    got = P.run_digests(docs, plant=True).collect()
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = len(words)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute_runs(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert Counter(map(tuple, got)) == Counter(want)
    listed = P.periodic_runs(docs).collect()
    assert len(listed) == sum(len(brute_runs(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for _, t in rows)
    assert P.run_digests(docs.limit(0)).count() == 0 and P.periodic_runs(docs.limit(0)).count() == 0
