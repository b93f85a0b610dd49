"""SimHash near-duplicates, found through Golay-code keys.

Texts become SimHash fingerprints of word shingles.  The candidate search
decodes fingerprint segments with the perfect binary Golay code (23,12): a
segment gets as keys all codewords within distance 4 (one if the nearest
codeword is at most 2 away, else six), and any two words that differ in at most
2 bits share a key.

``near_duplicates`` links 64-bit fingerprints that differ in few bits, and
finds all of these.  ``similar_documents`` links texts by the similarity of
their sets of five-word shingles: longer fingerprints give candidates, which
are verified exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SharedTable, bound_batches, join_unique
from .components import components, spanning_forest

CHUNK = 1 << 20


def word_pieces(text: str, piece: int = CHUNK) -> Iterator[list[bytes]]:
    """ASCII-lower-cased words of a text, a bounded piece of it at a time."""
    start = 0
    while start < len(text):
        end = min(len(text), start + piece)
        while end < len(text) and text[end] not in " \t\n\v\f\r":
            end += 1
        yield text[start:end].encode("utf-8", "surrogatepass").lower().split()
        start = end


def fingerprint(text: str | None, size: int = 4) -> int:
    """64-bit SimHash of the word shingles; fewer words than ``size``: the whole sequence; none: 0."""
    if not text:
        return 0
    ones, total, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in word_pieces(text):
        words = tail + words
        if len(words) < size:
            tail = words
            continue
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - size + 1].tolist()
        ends = ends[size - 1 :].tolist()
        hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(starts))
        for k in range(0, len(hashes), 1 << 14):
            bits = np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int32)
        total += len(hashes)
        tail = words[len(words) - size + 1 :]
    if not total:
        if not tail:
            return 0
        return digest(b" ".join(tail), 42)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", size: int = 4) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))

    return simhash(df[text])


# --- Golay code (23,12): keys of 23-bit words

#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Bits of the three fingerprint segments, lowest first; each is padded to 23.
SEGMENTS = (22, 21, 21)


def _syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(None)
def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the six lightest error patterns of weight 4 at most (repeats fill up), and how many there are."""
    from itertools import combinations

    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        words = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        for word, s in zip(words.tolist(), _syndrome(words).tolist()):
            if weight < 4 or patterns[s][0].bit_count() == 3:
                patterns[s].append(word)
    return np.array([(p * 6)[:6] for p in patterns]), np.array([len(p) for p in patterns])


def golay_keys(words: np.ndarray) -> np.ndarray:
    """Six 12-bit keys of each 23-bit word: indices of the codewords within distance 4, or the nearest one six times."""
    return (words[:, None] ^ error_patterns()[0][_syndrome(words)]) >> 11


def fingerprint_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints: for each two of three segments, each pair of their Golay keys.

    Four differing bits leave at most two in some two of three segments, so
    fingerprints that link share a key.
    """
    keys, shift = [], 0
    for width in SEGMENTS:
        keys.append(golay_keys((fps >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)))
        shift += width
    rows, out = [], []
    for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        both = (k << 24 | keys[a][:, :, None] << 12 | keys[b][:, None, :]).reshape(len(fps), 36)
        both.sort(axis=1)
        new = np.ones(both.shape, bool)
        new[:, 1:] = both[:, 1:] != both[:, :-1]
        row, at = np.nonzero(new)
        rows.append(row)
        out.append(both[row, at])
    return np.concatenate(rows), np.concatenate(out)


# --- links among the fingerprints of a key

#: Runs of a key up to this length compare all pairs at once over a whole batch.
SHORT = 8
#: Longer runs than this leave the task and are split into blocks of this size.
BLOCK = 8192


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints: rows of arrays of 64-bit columns."""
    return sum(np.bitwise_count(a[..., c] ^ b[..., c]).astype(np.int32) for c in range(a.shape[-1]))


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links, by first columns, that connect all fingerprints which links within ``radius`` connect: one less than each tree has nodes."""
    rest, edges = np.unique(fps, axis=0) if fps.shape[1] > 1 else np.unique(fps)[:, None], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            node = front.pop()
            near = apart(rest, node) <= radius
            if near.any():
                edges += [(int(node[0]), x) for x in rest[near, 0].tolist()]
                front += list(rest[near])
                rest = rest[~near]
    return edges


def forest_between(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """As forest(), of the links between two sets."""
    rest, edges = [np.unique(a, axis=0), np.unique(b, axis=0)], []
    while len(rest[0]) and len(rest[1]):
        front, rest[0] = [(0, rest[0][0])], rest[0][1:]
        while front:
            side, node = front.pop()
            near = apart(rest[1 - side], node) <= radius
            found = rest[1 - side][near]
            edges += [(int(node[0]), x) for x in found[:, 0].tolist()]
            front += [(1 - side, x) for x in found]
            rest[1 - side] = rest[1 - side][~near]
    return edges


def _prints(table, columns) -> np.ndarray:
    """Fingerprints as rows of 64-bit columns."""
    return np.stack([table.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in columns], axis=1)


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _links(edges: list[tuple[int, int]], runs: list[tuple[int, np.ndarray]], width: int = 1) -> pa.RecordBatch | None:
    """Links have no key; rows of long runs have a key and no v, and all columns of their fingerprints."""
    pairs = np.unique(np.array(edges, np.uint64).reshape(-1, 2), axis=0)
    keys = np.concatenate([np.full(len(f), k, np.int64) for k, f in runs]) if runs else np.empty(0, np.int64)
    long = np.concatenate([f for _, f in runs]) if runs else np.empty((0, width), np.uint64)
    if not len(pairs) + len(long):
        return None
    none = lambda n: pa.nulls(n, pa.int64())
    more = [pa.concat_arrays([none(len(pairs)), _signed(long[:, c])]) for c in range(1, width)]
    columns = [pa.concat_arrays([none(len(pairs)), pa.array(keys)]), pa.concat_arrays([_signed(pairs[:, 0]), _signed(long[:, 0])]), pa.concat_arrays([_signed(pairs[:, 1]), none(len(long))])]
    return pa.RecordBatch.from_arrays([*columns, *more], ["key", "u", "v", *(f"u{c}" for c in range(1, width))])


def _scan(batches, radius: int, block: int):
    """Links within each run of equal keys; rows come sorted by key.  Holds a batch and a block at most.

    A fingerprint is one column of 64 bits or several; the first one names it.
    """
    key, fps, spilled = np.empty(0, np.int64), None, None

    def settle(key, fps, spilled):
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        lengths, edges, runs = ends - starts, [], []
        # The last rows of a run that was handed over belong to it, few as they may be.
        whole = np.ones(len(starts), bool) if spilled is None else key[starts] != spilled
        short = whole & (lengths <= SHORT)
        small = np.repeat(short, lengths)
        k, f = key[small], fps[small]
        for lag in range(1, SHORT):
            near = (k[lag:] == k[:-lag]) & (apart(f[lag:], f[:-lag]) <= radius)
            edges += zip(f[:-lag, 0][near].tolist(), f[lag:, 0][near].tolist())
        for i in np.flatnonzero(~short):
            run = fps[starts[i] : ends[i]]
            if not whole[i] or len(run) > block:
                runs.append((int(key[starts[i]]), run))
            else:
                edges += forest(run, radius)
        return _links(edges, runs, fps.shape[1])

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        new = _prints(batch, range(1, batch.num_columns))
        fps = new if fps is None else np.concatenate([fps, new])
        if not len(key):
            continue
        if key[0] == key[-1]:
            if len(key) > block or key[0] == spilled:  # a run that goes on: hand it over as it comes
                spilled = int(key[0])
                yield _links([], [(spilled, fps)], fps.shape[1])
                key, fps = key[:0], fps[:0]
            continue
        cut = np.searchsorted(key, key[-1])
        if (out := settle(key[:cut], fps[:cut], spilled)) is not None:
            yield out
        key, fps, spilled = key[cut:].copy(), fps[cut:].copy(), spilled if key[cut] == spilled else None
    if len(key) and (out := settle(key, fps, spilled)) is not None:
        yield out


def fingerprint_links(nodes: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect distinct fingerprints exactly as all links within ``radius`` (at most 4) bits do."""
    if radius > 4:
        raise ValueError("the keys find up to four differing bits")

    def emit(batches):
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(all_fps), 4096):
                rows, keys = fingerprint_keys(fps := all_fps[k : k + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys), _signed(fps[rows])], ["key", "fp"])

    return key_links(nodes.select("fp").mapInArrow(emit, "key long, fp long"), radius, block)


def key_links(keyed: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect the fingerprints of each key exactly as all links within ``radius`` bits do.

    The columns after ``key`` are a fingerprint's; u and v are of the first one.
    """
    width, names = len(keyed.columns) - 1, keyed.columns[1:]

    def between(key, table):
        fps, side = _prints(table, names), table.column("side").to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        edges = forest(fps, radius) if i == j else forest_between(fps[side == 0], fps[side == 1], radius)
        pairs = np.array(edges, np.uint64).reshape(-1, 2)
        return pa.table({"u": _signed(pairs[:, 0]), "v": _signed(pairs[:, 1])})

    more = [f"u{c}" for c in range(1, width)]
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{c} long" for c in ["key", "u", "v", *more])
    found = SharedTable(keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda b: _scan(b, radius, block), schema), "links").df
    links = found.where("key is null").select("u", "v")
    long = found.where("key is not null").select("key", *[F.col(c).alias(name) for c, name in zip(["u", *more], names)]).distinct()
    if long.isEmpty():
        return links
    # Long runs: blocks by hash; every two blocks meet in a task of their own.
    n = long.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))
    dealt = long.join(n, "key").withColumn("own", F.pmod(F.xxhash64(names[0], F.lit(7)), F.col("n")).cast("int"))
    cells = dealt.select("key", *names, "own", F.explode(F.expr("sequence(0, n - 1)")).alias("other"))
    cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *names, F.expr("if(own <= other, 0, 1)").alias("side"))
    return links.union(cells.groupBy("key", "i", "j").applyInArrow(between, "u long, v long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    A null text counts as empty and has fingerprint zero, which links like any
    other.  Repeated rows stay; component_id is the smallest non-null doc_id
    reachable, null only if there is none.  Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    prints = SharedTable(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(docs, text, size).alias("fp")), "fingerprints").df
    nodes = SharedTable(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes").df
    roots = components(fingerprint_links(nodes, radius)).withColumnRenamed("node", "fp")
    named = SharedTable(_least_ids(nodes, roots, "fp"), "named").df
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    total = named.agg(F.sum("n")).first()[0] or 0
    return join_unique(prints, named, "fp", total).select("doc_id", hexed, "component_id")


def _least_ids(nodes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, n, component_id) of each node: the smallest id, column ``least``, of its component."""
    rooted = nodes.join(roots, key, "left").withColumn("root", F.coalesce("root", key))
    own = SharedTable(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "roots").df
    return join_unique(rooted, own, "root", nodes.count(), n="members").select(key, "n", "component_id")


# --- texts by the similarity of their sets of word shingles

#: Segments of 23 bits of a long fingerprint; each two of them that follow make a key.
PAIRS = 4
#: Candidates differ in at most so many of the 128 bits that are compared: three standard deviations over what a similarity of 0.8 gives.
WIDE_RADIUS = 24
#: Shingles that one task compares at once, about.
PIECE = 1 << 20


def long_prints(text: str | None) -> tuple[np.ndarray, int]:
    """Three times 64 SimHash bits of the distinct two-word shingles of a text, and its number of words.

    Texts that share most of their five-word shingles share more of their
    two-word ones, so their fingerprints differ in fewer bits.
    """
    out, n, last, found = np.zeros(3, np.uint64), 0, [], []
    for words in word_pieces(text or ""):
        n += len(words)
        h = np.fromiter(map(zlib.crc32, last + words), np.uint64, len(last) + len(words))
        found.append(np.unique(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]))
        last = words[-1:] or last
    if not n:
        return out, 0
    pairs = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    if n == 1:
        pairs = np.array([zlib.crc32(last[0])], np.uint64)
    for c in range(3):
        mixed = (pairs + np.uint64(c)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(33)
        ones = np.zeros(64, np.int64)
        for k in range(0, len(pairs), 1 << 14):
            ones += np.unpackbits(mixed[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[c] = int.from_bytes(np.packbits(2 * ones > len(pairs), bitorder="little").tobytes(), "little")
    return out, n


def long_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of long fingerprints: for each two segments that follow, each pair of their Golay keys."""
    segments, rows, out = [], [], []
    for k in range(2 * PAIRS):
        word, shift = divmod(23 * k, 64)
        bits = prints[:, word] >> np.uint64(shift)
        if shift > 64 - 23:
            bits = bits | prints[:, word + 1] << np.uint64(64 - shift)
        segments.append(golay_keys((bits & np.uint64((1 << 23) - 1)).astype(np.int64)))
    for k in range(PAIRS):
        both = (k << 24 | segments[2 * k][:, :, None] << 12 | segments[2 * k + 1][:, None, :]).reshape(len(prints), 36)
        both.sort(axis=1)
        new = np.ones(both.shape, bool)
        new[:, 1:] = both[:, 1:] != both[:, :-1]
        row, at = np.nonzero(new)
        rows.append(row)
        out.append(both[row, at])
    return np.concatenate(rows), np.concatenate(out)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; fewer words than ``size``: the whole sequence; none: empty."""
    found: list[np.ndarray] = []
    tail: list[bytes] = []
    for words in word_pieces(text or ""):
        words = tail + words
        if len(words) >= size:
            found.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)), np.uint64)))
            tail = words[len(words) - size + 1 :]
        else:
            tail = words
    if not found:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tail), 42)] if tail else [], np.uint64)
    return np.unique(np.concatenate(found))


def similar(sets: list[np.ndarray], sides: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Rows of sets that link: a spanning forest of all links between sets of one side each (all sides 0: among all)."""
    crossed = bool(sides.any())
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    left, edges = sizes > 0, []
    for start in range(len(sets)):
        if not left[start]:
            continue
        left[start] = False
        front = [start]
        while front:
            node = front.pop()
            a, b = np.searchsorted(flat, sets[node]), np.searchsorted(flat, sets[node], "right")
            n = b - a
            at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(sets))
            near = left & (shared >= similarity * (sizes[node] + sizes - shared) - 1e-9)
            if crossed:
                near &= sides != sides[node]
            found = np.flatnonzero(near).tolist()
            edges += [(node, x) for x in found]
            front += found
            left[found] = False
    return edges


def _similar_runs(batches, similarity: float):
    """Links (u, v) within each run of equal (root, i, j); rows (root, i, j, node, shingles, side) come sorted by these three."""
    key, rows = None, []

    def settle():
        if len(rows) < 2:
            return None
        nodes, sets, sides = zip(*rows)
        pairs = np.array(similar(list(sets), np.array(sides), similarity), np.int64).reshape(-1, 2)
        nodes = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], ["u", "v"]) if len(pairs) else None

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
        nodes, sides, shingles = batch.column(3).to_pylist(), batch.column(5).to_pylist(), batch.column(4)
        edges, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy(zero_copy_only=False).view(np.uint64)
        for r, own in enumerate(keys):
            if own != key:
                if (out := settle()) is not None:
                    yield out
                key, rows = own, []
            rows.append((nodes[r], flat[edges[r] : edges[r + 1]].copy(), sides[r]))
    if (out := settle()) is not None:
        yield out


def similar_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, similarity: float = 0.8, piece: int = PIECE) -> DataFrame:
    """(node, n, first, component) of every distinct text.

    A node is a text's hash, 0 for null and all texts without words: n rows
    have it, and ``first`` is their smallest (no id, doc_id, node).
    ``component`` is the smallest ``first`` that links reach.  Texts link if
    their sets of ``size``-word shingles (ASCII-lower-cased) have a Jaccard
    similarity of at least ``similarity``.

    Of the pairs with that similarity those are candidates that share a Golay
    key of long fingerprints and differ in few bits; the groups that candidates
    connect are compared in full.  A group with more than ``piece`` shingles is
    split into pieces, each two of which meet in a task of their own.
    """
    bound_batches(docs.sparkSession)
    spark, named = docs.sparkSession, docs.select(text_hash(F.col(text)).alias("node"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")

    @F.pandas_udf("a long, b long, c long, words long")
    def wide(texts):
        import pandas as pd

        rows = [(*prints.view(np.int64).tolist(), n) for prints, n in map(long_prints, texts)]
        return pd.DataFrame(rows, columns=["a", "b", "c", "words"])

    each = SharedTable(named.select("node", "doc_id", wide("text").alias("p")).select("node", "doc_id", "p.*"), "prints").df
    nodes = SharedTable(each.groupBy("node").agg(F.count("*").alias("n"), F.min(order).alias("first"), *[F.first(c).alias(c) for c in ("a", "b", "c", "words")]), "nodes").df

    def emit(batches):
        for batch in batches:
            prints = _prints(batch, range(3))
            for k in range(0, len(prints), 4096):
                rows, keys = long_keys(part := prints[k : k + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys), _signed(part[rows, 0]), _signed(part[rows, 1])], ["key", "a", "b"])

    keyed = nodes.where("words > 0").select("a", "b", "c").distinct().mapInArrow(emit, "key long, a long, b long")
    candidates = components(spanning_forest(key_links(keyed, WIDE_RADIUS)))
    # Different texts may have one fingerprint: they are candidates too.  Each fingerprint is one row of the table that all its texts meet.
    sized = nodes.where("words > 0").groupBy("a").agg(F.count("*").alias("texts"))
    rooted = SharedTable(sized.join(candidates.withColumnRenamed("node", "a"), "a", "left").select("a", "texts", F.coalesce("root", "a").alias("root")), "rooted").df
    total = nodes.count()
    grouped = join_unique(nodes.where("words > 0").select("a", "node", "words"), rooted, "a", total, n="texts").select("node", "words", "root")
    groups = SharedTable(grouped.groupBy("root").agg(F.count("*").alias("members"), F.sum("words").alias("all")).where("members > 1"), "groups").df
    members = SharedTable(join_unique(grouped, groups, "root", total, n="members").select("node", "root", F.ceil(F.col("all") / F.lit(piece)).cast("int").alias("pieces")), "members").df

    def sets(batches):
        for batch in batches:
            found = [shingle_set(t.as_py(), size).view(np.int64) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["node", "root", "pieces", "shingles"])

    wanted = members.join(nodes.select("node", "n", F.col("first.doc_id").alias("id")), "node")
    texts = _rows_of(named, "node", F.col("doc_id"), wanted, members.count(), each.count())
    found = SharedTable(texts.dropDuplicates(["node"]).select("node", "root", "pieces", "text").mapInArrow(sets, "node long, root long, pieces int, shingles array<long>"), "shingles").df
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("pieces")).cast("int")
    met = found.withColumn("own", own).select("*", F.explode(F.expr("sequence(0, pieces - 1)")).alias("other"))
    met = met.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles", F.expr("if(own <= other, 0, 1)").alias("side"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = SharedTable(met.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(lambda b: _similar_runs(b, similarity), "u long, v long"), "similar").df
    least = nodes.select("node", "n", F.col("first").alias("least"))
    linked = _least_ids(least, components(links), "node")
    return least.join(linked.select("node", F.col("component_id").alias("component")), "node").select("node", "n", F.col("least").alias("first"), "component")


#: Texts of a table that is broadcast, at most (some ten bytes each); a larger one is joined by shuffle.
MEMBERS = 1 << 20


def _rows_of(rows: DataFrame, node: str, doc_id: Column, wanted: DataFrame, n_wanted: int, total: int) -> DataFrame:
    """Rows with the text and the id of a row of ``wanted`` (node, id, n and other columns), with these columns; n goes.

    There is one row of ``wanted`` a text.  Up to MEMBERS of them are broadcast.  More are joined by text and
    id, so that copies of one text, of which one is wanted, don't meet in a task.
    """
    if n_wanted <= MEMBERS:
        named = wanted.withColumnRenamed("node", node).withColumnRenamed("id", "_id").drop("n")
        return rows.join(F.broadcast(named), node).where(doc_id.eqNullSafe(F.col("_id"))).drop("_id")
    key = lambda text, own: F.struct(text.alias("text"), own.isNull().alias("none"), F.coalesce(own.cast("string"), F.lit("")).alias("id"))
    keyed = wanted.select(key(F.col("node"), F.col("id")).alias("_key"), *[c for c in wanted.columns if c not in ("node", "id")])
    return join_unique(rows.withColumn("_key", key(F.col(node), doc_id)), keyed, "_key", total).drop("_key")


def text_hash(text: Column) -> Column:
    """64-bit hash of a text; 0 for null and for texts without words."""
    words = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(words == "", F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of similar_documents(), with all its columns: that with the smallest doc_id.

    Null ids count as larger than all others; of rows that share text and id
    one stays, whichever.  Texts without words are one group.
    """
    names = docs.columns
    nodes = SharedTable(similar_documents(docs, size=size, similarity=similarity), "similar").df
    # Texts that are the only row of their component need no decision.
    node = "_node"
    while node in names:
        node = "_" + node
    stays = F.col("first") == F.col("component")
    rows = docs.withColumn(node, text_hash(F.col("text")))
    total, n_decided = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(~stays | (F.col("n") > 1))).first()
    firsts = nodes.where(stays).select("node", F.col("first.doc_id").alias("id"), "n")
    if n_decided > MEMBERS:  # every text that stays is looked up by text and id
        return _rows_of(rows, node, F.col("doc_id"), firsts, n_decided, total).dropDuplicates([node]).select(*names)
    decided = SharedTable(nodes.where(~stays | (F.col("n") > 1)).select(F.col("node").alias(node)), "decided").df
    alone = rows.join(F.broadcast(decided), node, "left_anti").select(*names)
    several = firsts.where("n > 1")
    return alone.unionByName(_rows_of(rows, node, F.col("doc_id"), several, n_decided, total).dropDuplicates([node]).select(*names))
