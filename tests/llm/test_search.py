"""Near-duplicates, vector search and mixing against brute force, edge cases and skew."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from conftest import SMALL
from sparkloom.llm import components as C
from sparkloom.llm import mixing as M
from sparkloom.llm import simhash as S
from sparkloom.llm.queries import ORACLE_SQL, QUERIES
from sparkloom.llm.topk import top_k
from sparkloom.llm.vectors import near_vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, radius=4):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(fps))]
    return [min((ids[j] for j in range(len(fps)) if roots[j] == r and ids[j] is not None), default=None) for r in roots]


def test_fingerprints(monkeypatch):
    texts = [None, "", " \t\n", "one", "one two three", "A b\tc\nd e", "x " * 500, "É É É É é", "a b c d " * 3]
    for t in texts:
        assert S.fingerprint(t) == brute_fingerprint(t)
    long = " ".join(random.Random(3).choices(["alpha", "beta", "Gamma", "d"], k=5000))
    want = brute_fingerprint(long)
    assert S.fingerprint(long) == want
    monkeypatch.setattr(S.word_pieces, "__defaults__", (37,))
    assert S.fingerprint(long) == want


def test_spark_hashes_alike(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] == np.array([xxhash.xxh64_intdigest(b"a b c d", 42)], np.uint64).view(np.int64)[0]


def test_golay_keys_meet():
    table, counts = S.error_patterns()
    assert sorted(np.unique(counts)) == [1, 6] and (counts == 1).sum() == 277
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 3000)
    for errors in (0, 1, 2):
        y = x.copy()
        for i in range(len(x)):
            for b in rng.choice(23, errors, replace=False):
                y[i] ^= 1 << int(b)
        a, b = S.golay_keys(x), S.golay_keys(y)
        assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).all()


def test_fingerprints_that_link_share_a_key():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    y = x.copy()
    for i in range(len(x)):
        for b in rng.choice(64, 4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    for k in range(len(x)):
        assert set(S.fingerprint_keys(x[k : k + 1])[1]) & set(S.fingerprint_keys(y[k : k + 1])[1])


@pytest.mark.parametrize("block", [8192, 12])
def test_links_of_dense_groups(spark, block):
    """A ball of fingerprints around a few centres, with short and long runs of keys."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 5).astype(np.uint64)
    fps = set(rng.integers(0, 2**63, 100).tolist())
    for c in centres:
        for _ in range(60):
            f = int(c)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    found = {r["node"]: r["root"] for r in C.components(S.fingerprint_links(nodes, block=block)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = brute_components(fps, signed)
    groups = lambda labels: sorted(sorted(s for s, x in zip(signed, labels) if x == v) for v in set(labels))
    assert groups([found.get(s, s) for s in signed]) == groups(want)


@pytest.mark.parametrize("tail", range(1, 10))
@pytest.mark.parametrize("rows", [3, 16])
def test_tails_of_long_runs_stay_with_them(tail, rows):
    """A run that is handed over keeps its last rows, however few share a batch with the next key."""
    block = 2 * rows
    first = -(-(block + 1) // rows) * rows  # whole batches, after which the run has been handed over
    fps = np.arange(first + tail, dtype=np.int64) << 5
    keys, other = np.full(len(fps), 7), np.array([1, 3, 127 << 40])
    table = pa.table({"key": np.concatenate([keys, [8] * 3]), "fp": np.concatenate([fps, other])})
    out = [r for b in S._scan(table.to_batches(max_chunksize=rows), 4, block) if b is not None for r in b.to_pylist()]
    assert sorted(r["u"] for r in out if r["key"] == 7) == fps.tolist()
    assert [(r["u"], r["v"]) for r in out if r["key"] is None] == [(1, 3)]


def test_near_duplicates_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    fps, ids = [brute_fingerprint(r["text"]) for r in rows], [r["doc_id"] for r in rows]
    want = {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(fps, ids))}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(docs).collect()}
    assert found == want


def brute_similar(rows, size=5, least=0.8):
    """doc_ids that stay: the smallest of each component of texts whose shingle sets are similar, nulls last."""

    def shingles(text):
        words = (text or "").encode().lower().split()
        return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()

    order = {}
    for i, t in rows:
        order.setdefault(b" ".join((t or "").encode().lower().split()), []).append((i is None, i if i is not None else 0))
    texts = sorted(order)
    sets, first = [shingles(t.decode()) for t in texts], [min(order[t]) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    where = {}
    for k, own in enumerate(sets):
        for j in {j for x in own for j in where.get(x, ())}:
            both = len(own & sets[j])
            if both >= least * (len(own) + len(sets[j]) - both) - 1e-9:
                root[find(k)] = find(j)
        for x in own:
            where.setdefault(x, []).append(k)
    kept = {}
    for k, f in enumerate(first):
        kept[find(k)] = min(f, kept.get(find(k), f))
    return sorted((None if none else i for none, i in kept.values()), key=repr)


def changed(rng, words, share):
    """Words with a share of them replaced, dropped or doubled."""
    out = []
    for w in words:
        x = rng.random()
        out += [w] if x >= share else [] if x < share / 3 else [w + "x"] if x < share * 2 / 3 else [w, w]
    return out


@pytest.mark.parametrize("piece", [S.PIECE, 600])
def test_similar_texts_of_all_sizes(spark, piece):
    """Groups of near copies, whole and in pieces, against all pairs that share a shingle."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "en", "ing", "or", "ust", "el")]
    rows = []
    for size in (3, 12, 60, 250, 900):
        for _ in range(6):
            base = rng.choices(vocabulary, k=size)
            rows += [" ".join(base)] * rng.choice([1, 2])
            rows += [" ".join(changed(rng, base, share)) for share in (0.005, 0.01, 0.015, 0.02, 0.05, 0.2)]
    base = rng.choices(vocabulary, k=200)
    rows += [" ".join(changed(rng, base, 0.012)) for _ in range(80)]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(rows)] + [(5000, None), (5001, ""), (5002, " \n\t"), (4, rows[4].upper().replace(" ", "  ")), (4, rows[4]), (5003, "É é"), (5004, "é é")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    nodes = S.similar_documents(docs, piece=piece).collect()
    assert sum(r["n"] for r in nodes) == len(rows)
    found = {(r["component"]["none"], r["component"]["doc_id"], r["component"]["node"]) for r in nodes}
    assert sorted((i for _, i, _ in found), key=repr) == brute_similar(rows)


def test_keep_one_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted((r["doc_id"] for r in S.keep_one(docs).collect()), key=repr) == brute_similar([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("members", [S.MEMBERS, 1])
def test_a_third_of_all_rows_are_one_text(spark, monkeypatch, members):
    monkeypatch.setattr(S, "MEMBERS", members)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words, n))
    hot, near = text(60), text(50)
    rows = [(i, hot) for i in range(100)] + [(200 + i, near + f" end{i}") for i in range(50)] + [(300 + i, text(40)) for i in range(50)] + [(400, None), (401, ""), (402, " \n"), (None, hot), (403, "twice said"), (403, "twice said")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": S.F.lit(1), "id": S.F.lit("own"), "_node": S.F.lit(2)})
    kept = sorted(r["doc_id"] for r in S.keep_one(docs.repartition(4)).collect())
    assert kept == [0, 200, *range(300, 350), 400, 403]
    assert S.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("remembered", [500_000, 5])
def test_forests_keep_components(spark, monkeypatch, remembered):
    import sparkloom.llm.components as K

    monkeypatch.setattr(K, "REMEMBERED", remembered)
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + i, 100 + j) for i in range(20) for j in range(20)] + [(None, 1), (7, 7)], "u long, v long").repartition(3)
    forest = K.spanning_forest(edges)
    assert sorted(map(tuple, K.components(forest).collect())) == sorted(map(tuple, K.components(edges).collect()))
    assert remembered == 5 or forest.where("u >= 100").count() <= 19 * forest.rdd.getNumPartitions()


def test_long_fingerprints():
    """Texts whose shingles are four fifths alike share a key and differ in few bits, but for one in twenty at most."""
    rng = random.Random(12)
    vocabulary, met = [f"w{i}" for i in range(3000)], []
    for _ in range(300):
        base = rng.choices(vocabulary, k=300)
        other = list(base)
        for at in rng.sample(range(300), 7):  # at most 35 of 296 shingles go: a similarity of about 0.8
            other[at] = "new"
        a, b = (S.long_prints(" ".join(x))[0][None, :] for x in (base, other))
        met.append(bool(set(S.long_keys(a)[1]) & set(S.long_keys(b)[1])) and S.apart(a[:, :2], b[:, :2])[0] <= S.WIDE_RADIUS)
    assert sum(met) >= 285
    assert (S.long_prints(None)[0] == 0).all() and (S.long_prints("a")[0] == S.long_prints(" A ")[0]).all() and S.long_prints("a B\nc")[1] == 3


def test_long_fingerprints_in_pieces(monkeypatch):
    text = " ".join(random.Random(13).choices([f"w{i}" for i in range(50)], k=700))
    whole = S.long_prints(text)
    monkeypatch.setattr(S.word_pieces, "__defaults__", (37,))
    assert (S.long_prints(text)[0] == whole[0]).all() and S.long_prints(text)[1] == whole[1] == 700


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "same words in this text", None, "a", None), (9, "same words in this text", None, None, 1), (7, "Same words  in\nthis text", "en", "a", 5)]
    docs = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    odd = docs.withColumns({"fp": F.lit(1), "component_id": F.lit("x"), "node": F.lit(2.0)})
    found = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(odd).collect()), key=repr)
    assert found == sorted([(1, 1), (2, 1), (2, 1), (None, 7), (9, 7), (7, 7)], key=repr)
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [1, 7]
    assert S.keep_one(odd.limit(0)).count() == 0
    twice = spark.createDataFrame([(3, "one text of some words", "en", "a", 1), (3, "another text that is not like it", "en", "a", 1), (None, "and one without an id", "en", "a", 1), (None, "and one without an id", "en", "a", 1)], DOCS)
    assert sorted((r["doc_id"], r["text"][:3]) for r in S.keep_one(twice).collect() if r["doc_id"]) == [(3, "ano"), (3, "one")] and S.keep_one(twice).count() == 3
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(300)] + [(None, 1)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {n: find(n) for n in list(parent)}
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def brute_top(rows, k=5, every=50, exact=False):
    out = []
    usable = [(i, [int(np.floor(256 * np.float64(x if exact else np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in usable:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(b) == len(a))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 30])).astype(np.float32).tolist(), 0) for i in range(400)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(20)] + [(50_000, rows[3][1], 0), (60_000, [0.0] * 6, 0), (150_000, None, 0), (200_000, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (250_000, [float("nan")] * 6, 0), (300_000, [], 0), (None, rows[0][1], 0), (350_000, [1.0, 2.0], 0), (401, [3.0, 1.0], None)]
    for blocks in ({}, {"candidates": 64, "queries": 3}):
        assert sorted(map(tuple, top_k(vectors(spark, rows), **blocks).collect())) == brute_top(rows)
    assert sorted(map(tuple, top_k(vectors(spark, rows), longest=3).collect())) == brute_top(rows)
    assert top_k(vectors(spark, [])).count() == 0
    assert top_k(vectors(spark, [(0, [1.0], 0)])).count() == 0


@pytest.mark.parametrize("size", [3e5, 1e9, 4e9, 1e20, 1e307])
def test_top_k_of_large_components(spark, size):
    """Products beyond doubles' whole numbers are exact; beyond 64 bits they count as the largest long."""
    rng, clip = np.random.default_rng(7), lambda x: min(max(x, -(2**63)), 2**63 - 1)
    rows = [(i, (rng.normal(size=8) * size).tolist(), 0) for i in range(120)] + [(200, [0.5] * 8, 0), (250, [0.0] * 8, 0)]
    whole = {i: [int(np.floor(min(max(256 * x, -1.7e308), 1.7e308))) for x in v] for i, v, _ in rows}
    want = []
    for q in whole:
        if q % 50 == 0:
            scored = sorted((-clip(sum(x * y for x, y in zip(whole[q], whole[i]))), i) for i in whole if i != q)[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, top_k(vectors(spark, rows, "double"), candidates=64, queries=2, longest=8).collect())) == sorted(want)


def test_top_k_meets_fewer_bands_than_there_are(spark):
    """Lengths that fall quickly: far fewer products than all pairs of blocks and bands would take."""
    rng = np.random.default_rng(8)
    rows = [(i, (np.abs(rng.normal(size=8)) * 100 / (1 + i)).tolist(), 0) for i in range(1000)]
    found = top_k(vectors(spark, rows, "double"), candidates=50, queries=5, longest=64)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and sorted(map(tuple, found.collect())) == brute_top([(i, v, lab) for i, v, lab in rows], exact=True)


@pytest.mark.parametrize("most", [4096, 16])
def test_near_vectors(spark, most):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(100)]
    rows += [(200 + i, (centre + rng.normal(size=16) * 0.12).tolist(), 1) for i in range(60)] + [(300 + i, (centre * (i + 1)).tolist(), 1) for i in range(5)] + [(400 + i, centre.tolist(), 1 if i % 2 else 2) for i in range(8)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [None] * 16, 1), (503, [float("inf")] * 16, 1), (504, centre.tolist(), None), (None, centre.tolist(), 1), (505, [], 1), (506, [1.0, 0.0], 1), (507, [1.0, 0.001], 1)]
    fine = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = [f[0] for f in fine]
    near = [[i != j and len(a[1]) == len(b[1]) and a[2] == b[2] and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98 for j, b in enumerate(fine)] for i, a in enumerate(fine)]
    label = list(ids)
    for _ in ids:
        label = [min([label[i]] + [label[j] for j in range(len(ids)) if near[i][j]]) for i in range(len(ids))]
    want = {i: (sum(n), c, i == c) for i, n, c in zip(ids, near, label)}
    found = near_vectors(vectors(spark, rows, "double"), most=most).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_links"], r["component_id"], r["kept"]) == want.get(r["vec_id"], (0, r["vec_id"], True)), r
    assert near_vectors(vectors(spark, [])).count() == 0
    extreme = [(1, [1e-170, 2e-170], 1), (2, [1e200, 2e200], 1), (3, [3e200, 6e200], 1), (4, [-0.0, 1.0], 1), (5, [0.0, 1.0], 1), (6, [1e-320, 0.0], 1)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(vectors(spark, extreme, "double")).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_near_vectors_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0, 0.0, 0.0], 1), (0, [0.0, 1.0, 0.0, 0.0], 1), (1, [1.0, 0.01, 0.0, 0.0], 1), (5, [0.0, 0.0, 1.0, 0.0], 1), (5, [0.0, 0.0, 1.0, 0.0], 1), (7, [0.0, 1.0, 0.01, 0.0], 2)]
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(vectors(spark, rows, "double")).collect())
    assert found == [(0, 0, 0, True), (0, 1, 0, True), (1, 1, 0, False), (5, 1, 5, True), (5, 1, 5, True), (7, 0, 7, True)]


@pytest.mark.parametrize("weights", [[1], [3, 2, 5], [1, 1, 1, 1], [97, 2, 1], [7, 11, 13, 29]])
def test_pfair_deviation(weights):
    slots, period = M.pfair_slots(weights), sum(weights)
    order = sorted((t, i) for i, own in enumerate(slots) for t in own)
    assert [t for t, _ in order] == list(range(period))
    done = [0] * len(weights)
    for t, i in order:
        done[i] += 1
        assert all(abs(d * period - w * (t + 1)) < period for d, w in zip(done, weights))


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, "x", None, rng.choices(["big", "b", "c", None], [70, 20, 8, 2])[0], 1) for i in range(1500)] + [(None, None, None, "b", None)] * 3
    docs = spark.createDataFrame(rows, DOCS)
    weights = {"big": 4, "b": 2, "c": 1, None: 1}
    found = sorted(map(tuple, M.mixing_order(docs, weights, block=4).select("slot", "place", "source", "block", "doc_id").collect()), key=lambda r: r[:2])
    assert sorted(repr(r[4]) for r in found) == sorted(repr(r[0]) for r in rows)
    assert len({r[:2] for r in found}) == len(rows)
    slots = {}
    for slot, _, source, block, _ in found:
        assert slots.setdefault(slot, (source, block)) == (source, block)
    assert sorted(slots) == list(range(len(slots)))
    blocks = {s: -(-sum(r[3] == s for r in rows) // 4) for s in weights}
    whole = min(blocks[s] // w for s, w in weights.items()) * 8  # slots before a source runs short
    assert whole
    done = dict.fromkeys(weights, 0)
    for t in range(len(slots)):
        done[slots[t][0]] += 1
        if t < whole:
            assert all(abs(done[s] - w * (t + 1) / 8) < 1 for s, w in weights.items())
    assert done == blocks
    for s in weights:
        own = [slots[t][1] for t in range(len(slots)) if slots[t][0] == s]
        assert own == list(range(blocks[s]))


def brute_schedule(blocks, weights):
    """(source, block) by slot, one slot at a time: of the blocks released the one with the earliest deadline, ties by source; period by period."""
    left, done, out = dict(blocks), dict.fromkeys(blocks, 0), []
    while any(left.values()):
        own = {s: min(weights[s], n) for s, n in sorted(left.items()) if n}
        period, had = sum(own.values()), dict.fromkeys(own, 0)
        for t in range(period):
            open_blocks = [(-((had[s] + 1) * period // -w), i, s) for i, (s, w) in enumerate(own.items()) if had[s] < w and had[s] * period // w <= t]
            s = min(open_blocks)[2]
            out.append((s, done[s]))
            had[s], done[s], left[s] = had[s] + 1, done[s] + 1, left[s] - 1
    return out


@pytest.mark.parametrize("broadcast", [M.BROADCAST, 0])
def test_schedule_is_the_brute_force_one(spark, broadcast):
    rng = random.Random(9)
    n = {f"s{i}": rng.choice([1, 2, 3, 7, 20, 41, 60]) for i in range(25)}
    weights = {s: rng.choice([1, 2, 3, 5]) for s in n}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, k in n.items() for _ in range(k * 2))], "doc_id long, source string")
    found, (block, slot, _) = M.schedule(docs, weights, block=2, broadcast=broadcast)
    rows = {(r[slot], r["source"], r[block]) for r in found.collect()}
    assert sorted(rows) == [(t, s, k) for t, (s, k) in enumerate(brute_schedule(n, weights))]


def test_a_thousand_sources_keep_to_their_weights(spark):
    """Less than one block from the share at every slot, as long as no source runs short."""
    rng = random.Random(10)
    weights = {f"s{i}": rng.choice([1, 1, 2, 3, 40]) for i in range(1000)}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, w in weights.items() for _ in range(2 * w))], "doc_id long, source string")
    found, (_, slot, _) = M.schedule(docs, weights, block=1)
    period, done = sum(weights.values()), dict.fromkeys(weights, 0)
    rows = sorted((r[slot], r["source"]) for r in found.collect())
    assert [t for t, _ in rows] == list(range(2 * period))
    for t, s in rows:
        # A source's lag is largest just before and just after it is served.
        assert done[s] * period - weights[s] * t > -period
        done[s] += 1
        assert done[s] * period - weights[s] * (t + 1) < period
    assert done == {s: 2 * w for s, w in weights.items()}


@pytest.mark.parametrize("name", ["op5_norm_sorted_topk", "op7_pfair_mixing", "op9_subspace_near_dedup"])
def test_queries_match_sql(name, spark, duck, same):
    same(QUERIES[name](spark, SMALL), duck.sql(ORACLE_SQL[name]))


def test_mixing_keeps_rows_and_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "t", "en", f"s{i % 400}", 1) for i in range(900)], DOCS).withColumns({"mix_slot": F.lit(1), "p_key": F.lit(2), "rank": F.lit(3)})
    out = M.mixed(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == list(range(900))
    assert M.mixed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.mixing_order(docs, {"s1": 0})
