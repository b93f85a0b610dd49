"""Prefix tries, importance resampling and files of token ids."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import sparkloom.llm.idcodec as C
import sparkloom.llm.resample as R
import sparkloom.llm.tokenfiles as T
import sparkloom.llm.trie as P
from conftest import SMALL
from sparkloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_importance_resampling"])
def test_new_queries_match_sql(name, spark, duck, same):
    same(QUERIES[name](spark, SMALL), duck.sql(ORACLE_SQL[name]))


# Tries


def brute_trie(rows, shared=5, heads=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), role, digest[:30], text))
    own = {c: [(role, text) for _, role, _, text in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = own.get(c - c % shared, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for path, ids in members.items():
        under = [p for p in members if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[:-1] == p for q in members) for p in under)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = ",".join(str(c) for c in sorted(ids) if len(whole[c]) == len(path))
        children = sum(len(q) == len(path) + 1 and q[:-1] == path for q in members)
        out.add((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(df):
    return {tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


@pytest.mark.parametrize("cell", [P.CELL, 3])
def test_trie_by_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(P, "CELL", cell)
    monkeypatch.setattr(P.running, "__defaults__", ("sum", cell))
    monkeypatch.setattr(P, "PIECE", 2)
    rng = random.Random(5)
    rows = [(c, rng.choice([None, *range(4)]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None, "long " * 50])) for c in range(40) for _ in range(rng.randint(1, 12))]
    rows += [(70 + i, t, "user", "same") for i in range(12) for t in range(3)]  # copies
    rows += [(90, 1, "user", "again")] * 9  # repeated rows are turns of their own
    rows += [(None, 0, "user", "nobody's")]
    found = P.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS).repartition(3))
    assert nodes(found) == brute_trie(rows)
    # Preorder: subtrees are intervals, and parents' intervals hold their children's.
    at = {(r.conv_id, r.depth): (r.rank, r.rank_end, r.parent_conv_id) for r in found.collect()}
    assert sorted(x[0] for x in at.values()) == list(range(len(at)))
    for (_, depth), (rank, end, parent) in at.items():
        assert rank < end <= len(at)
        if depth:
            above = at[parent, depth - 1]
            assert above[0] < rank and end <= above[1]


def test_trie_of_odd_tables(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert not P.prefix_trie(empty).collect()
    # 7 takes all its turns from conversation 5, which isn't there.
    h = zlib.crc32(b"7") % 9
    assert h > 0
    turnless = spark.createDataFrame([(7, 0, "user", "gone")], CONVERSATIONS).withColumn("k1", P.F.lit("clash")).withColumn("depth", P.F.lit(1)).withColumn("n", P.F.lit(1))
    (root,) = P.prefix_trie(turnless).collect()
    assert (root.conv_id, root.depth, root.parent_conv_id, root.n_convs, root.n_children, root.n_leaves, root.ends_sha256) == (7, 0, None, 1, 0, 1, hashlib.sha256(b"7").hexdigest())


def test_deep_conversations(spark):
    rows = [(c, t, "user", f"{t if t < 300 else c}") for c in (5, 10, 15) for t in range(400)]
    assert {x[:4] for x in nodes(P.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS)))} == {(5, d, 5 if d else None, 3 if d <= 300 else 1) for d in range(401)} | {(c, d, 5 if d == 301 else c, 1) for c in (10, 15) for d in range(301, 401)}


# Importance resampling

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("ngrams", [1, 2, 3])
def test_byte_automaton(ngrams):
    rng = random.Random(ngrams)
    texts = ["", None, "One two", "é É x", "a" * 5000 + " b", "日本語のテキスト", "-", "x", "a-b_c9", "\U0001f600 ok", " ".join(["same"] * 100)]
    texts += ["".join(rng.choice("aZ9é -\nあ") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["skipped", *texts]).slice(1), pa.array([], pa.string())):
        n_words, found = R.text_features(column, ngrams)
        own = [WORDS.findall(lower(t)) for t in column.to_pylist()]
        assert n_words.tolist() == [len(w) for w in own]
        for n, (of, crc) in enumerate(found, 1):
            wanted = [(i, zlib.crc32(" ".join(w[k : k + n]).encode())) for i, w in enumerate(own) for k in range(len(w) - n + 1)]
            assert list(zip(of.tolist(), crc.tolist(), strict=True)) == wanted


def test_importance_by_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 19, 20, 21, 200])))) for i in range(300)]
    docs += [(7, docs[7][1])] * 40 + [(None, "word " * 30), (900, None), (901, "")]
    target = [(1, " ".join(rng.choices(vocabulary[:9], k=300))), (2, None)]
    found = R.importance_scores(spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", R.F.lit("clash")), spark.createDataFrame(target, "item_id long, text string"), buckets=50, percent=25, keep=("score",)).collect()

    def counts(texts):
        return Counter(zlib.crc32(w.encode()) % 50 for t in texts for w in WORDS.findall(lower(t)))

    s, t = counts(x for _, x in docs), counts(x for _, x in target)
    gain = {b: int(np.floor(1000 * np.log((t[b] + 1) * (sum(s.values()) + 50) / ((s[b] + 1) * (sum(t.values()) + 50))))) for b in range(50)}
    rows = []
    for i, text in docs:
        w = [gain[zlib.crc32(x.encode()) % 50] for x in WORDS.findall(lower(text))]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(w) // len(w) if w else 0
        rows.append((i, len(w), weight, weight + int(np.floor(-1000 * np.log(-np.log((h + 0.5) / 2**32))))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    wanted = [(*r, k) for k, r in enumerate(fit[: len(fit) * 25 // 100], 1)] + [(*r, None) for r in fit[len(fit) * 25 // 100 :]] + [(*r, None) for r in rows if r[1] < 20]
    assert sorted(map(repr, ((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found))) == sorted(map(repr, wanted))


def test_importance_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20, "x"), (2, None, "y")], "doc_id long, text string, rank string")
    none = docs.where("false")
    target = spark.createDataFrame([], "text string")
    assert R.importance_scores(none, docs).collect() == []
    assert [(r.doc_id, r.n_features, r["rank"]) for r in R.importance_scores(docs, target, percent=100).orderBy("doc_id").collect()] == [(1, 40, 1), (2, 0, None)]
    assert R.importance_sample(docs, target, percent=100).collect() == docs.limit(1).collect()


# Files of token ids


@pytest.mark.parametrize("n", [1, 2, 255, 257, 5000, 70_001])
@pytest.mark.parametrize("kind", ["zeros", "random", "text", "last"])
def test_blocks_of_ids(n, kind):
    rng = np.random.default_rng(n)
    ids = {"zeros": np.zeros(n), "random": rng.integers(0, 50_257, n), "text": rng.zipf(1.3, n) % 50_257, "last": np.full(n, 50_256)}[kind].astype(np.uint32)
    block = C.encode(ids, 50_257)
    assert (C.decode(block) == ids).all()
    if n > 5000:
        assert len(block) < (2.5 if kind == "random" else 1.6) * n


def test_blocks_are_independent_and_checked():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.5, 3000) % 1000).astype(np.uint32)
    block = C.encode(ids, 1000)
    assert C.encode(ids, 1000) == block  # nothing is left of a block before
    for at in [0, 5, 9, 13, 17, 21, 40, len(block) // 2, len(block) - 1]:
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(C.CodecError):
            C.decode(bytes(broken))
    for size in (0, 10, len(block) - 1):
        with pytest.raises(C.CodecError):
            C.decode(block[:size])


def test_orders_help():
    rng = np.random.default_rng(2)
    after = rng.permutation(500)
    chain = [0]
    for _ in range(50_000):
        chain.append(int(after[chain[-1]]) if rng.random() < 0.8 else int(rng.integers(500)))
    ids = np.array(chain, np.uint32)
    assert len(C.encode(ids, 500)) < 0.6 * len(C.encode(rng.permutation(ids), 500))


def test_carries_reach_back():
    # Ids of the highest parts push the interval upwards again and again.
    for seed in range(20):
        ids = (999 - np.random.default_rng(seed).geometric(0.9, 4000) % 3).astype(np.uint32)
        assert (C.decode(C.encode(ids, 1000)) == ids).all()


HOSTILE = ["", "a  b", " x", "x ", "\n\n y", "a  b", "don't stop<|endoftext|> now <|endoftext|>", "é É, ç.", "1 2 33, 4.4", "\x1c a \x1d b", "日本 語。 テスト", "a \tb", "ǆ. Ω, ɐ. x", "'s 't ''re dogs' (x)", "\U0001d538. b", "a\r\n b", "two\nlines here\n", "͸. ͸", "a­ b"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_are_encoded_as_whole_texts(name):
    own = T.PieceEncoder(tokenizer_path(name))
    rng = random.Random(7)
    texts = HOSTILE + ["".join(rng.choice(["a", "The", " ", " ", "\n", ".", ",", "é", "'s", "9", "<|endoftext|>", "\t"]) for _ in range(30)) for _ in range(300)]
    for _ in range(2):  # unknown pieces, then known ones
        ids, n = own.encode(pa.array(texts))
        for text, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert part.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_files_of_odd_rows(spark, monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = [(i, text) for i, text in enumerate(HOSTILE)] + [(3, "x")] * 5 + [(None, "nobody's"), (-4, None), (50, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", T.F.lit("clash"))
    groups = T.write_ids(docs.repartition(5), path)
    found = T.read_ids(groups).orderBy("start").collect()
    own = T.encoder(path)
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in found:
        assert r.start == at
        at += len(r.ids)
    wanted = sorted((repr(i), own.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows)
    assert sorted((repr(r.doc_id), r.ids) for r in found) == wanted
    sums = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in T.id_checksums(docs, path).collect()}
    assert {(r.doc_id, len(r.ids)) for r in found} == {(k[0], v[0]) for k, v in sums.items()}
    assert sorted(v[1] for v in sums.values()) == sorted(zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)
    assert T.id_checksums(docs.where("false"), path).collect() == []
    # A byte that changes on the disk is found.
    file = groups.orderBy("part").first().file
    with open(file.removeprefix("file://"), "r+b") as f:
        f.seek(-1, 2)
        last = f.read(1)
        f.seek(-1, 2)
        f.write(bytes([last[0] ^ 1]))
    with pytest.raises(Exception, match="aren't those that were written"):
        T.read_ids(groups).collect()


def test_long_documents_take_several_blocks():
    docs = [(1, np.arange(7, dtype=np.uint32)), (None, (np.arange(T.BLOCK + 5) % 50).astype(np.uint32)), (2, np.zeros(1, np.uint32))]
    out = list(T.unpack_group(T.pack_group(docs, 50)))
    assert [d for d, _ in out] == [1, None, 2] and all((a == b).all() for (_, a), (_, b) in zip(docs, out, strict=True))


def test_token_file_query(spark):
    tokenizer = T.encoder(tokenizer_path("byte_bpe_50k.json")).tokenizer
    at = 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op13_token_files"](spark, SMALL).orderBy("doc_id").collect():
        ids = np.array([*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_new_words_are_encoded_many_at_a_call(monkeypatch):
    own = T.PieceEncoder(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 9))) + rng.choice(["", ".", "'s", ",\nNext", "7²"]) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(300)]
    calls = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            calls.append(name)
            return getattr(self.inner, name)

    own.model = Counted(own.model)
    wanted = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for kept in (10**6, 500, 0):  # what is kept goes again and again
        monkeypatch.setattr(T, "KEPT", kept)
        for at in range(0, 300, 100):
            ids, n = own.encode(pa.array(texts[at : at + 100]))
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == wanted[at : at + 100]
    assert len(calls) < 200  # 3,000 words and more, with up to three in a piece, again and again
