"""Files of token ids in document order.

Documents are sorted by id over ranges, each range is encoded and written by
one task, and files consist of groups: the ids and lengths of whole documents,
then their token ids in blocks of the range coder (idcodec).  A group can be
read without the rest of its file.

Tasks that are repeated write files of their own.  What counts is the table of
groups, which Spark writes from the tasks that ended well; so lost executors
and stray files change nothing.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Collection, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTable, bound_batches, shared_folder
from .idcodec import BLOCK, HEADER, CodecError, decode, encode

#: Id that ends a document; pieces of text whose ids a worker keeps; words that the model gets at a call.
END, KEPT, JOINED = 0, 1_000_000, 256
FILE, GROUP = struct.Struct("<8sII"), struct.Struct("<4sIQIII")
MAGIC, GROUP_MAGIC = b"TOKIDS01", b"TIDG"
MANIFEST = "part int, place int, file string, at long, size long, n_docs long, n_ids long"

# The parts of a byte-level tokenizer whose pieces are encoded by themselves.
PARTS = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}


# Characters that all versions of Unicode class alike, and how byte-level tokenizers split texts of them into words.
PLAIN = re.compile("[\n !-~\u00a1-\u00ac\u00ae-\u024f]*")
LETTER, NUMBER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
WORDS = re.compile(rf" ?[{LETTER}]+| ?[{NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself where it is printable, else the next from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def runs(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of ``ids``, one after the other."""
    upto = np.cumsum(lengths)
    at = np.repeat(starts - upto + lengths, lengths)
    at += np.arange(len(at))
    return ids.take(at)


def with_room(kept: np.ndarray, used: int, more: int) -> np.ndarray:
    """``kept`` with room for ``more`` behind the first ``used``."""
    if used + more <= len(kept):
        return kept
    grown = np.zeros(2 * used + more, kept.dtype)
    grown[:used] = kept[:used]
    return grown


class PieceEncoder:
    """Encodes texts exactly as the tokenizer without special tokens added.

    With a byte-level tokenizer of known parts, a space before anything but
    white space begins a new word.  So what stands between two spaces is encoded once
    and kept.  The library's model gets the words of new pieces many at a call,
    with a letter between them that it never merges.
    Pieces with unusual characters or added tokens go through the whole
    library, and so do texts with other white space after a space, and all
    texts of other tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = Tokenizer(self.tokenizer.model)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        self.added = [t["content"] for t in found.get("added_tokens") or ()]
        plain = not any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] for t in found.get("added_tokens") or ())
        letters, tokens = byte_letters(), self.tokenizer.get_vocab(with_added_tokens=False)
        self.letters = np.array([ord(letters[b]) for b in range(256)], "<u4")
        # A control character, which no usual text has, whose letter is in no longer token and so in no merge.
        merged = set("".join(t for t in tokens if len(t) > 1))
        self.between = next((chr(b) for b in range(9) if letters[b] in tokens and letters[b] not in merged), None)
        self.mark = None if self.between is None else tokens[letters[ord(self.between)]]
        known = all(found.get(k) == v for k, v in PARTS.items()) and all(found["model"].get(k) == v for k, v in MODEL.items()) and not found["model"].get("ignore_merges")
        self.pieces = plain and known and self.between is not None
        #: Places of pieces, with the space before them, and of other words, each named with a space; place 0 is that of unknown ones.
        self.known: dict[str, int] = {}
        #: Kept ids, how many there are, where those of each place are, and in how many batches it was a piece.
        self.ids, self.used = np.zeros(0, "<u4"), 0
        self.starts, self.lengths, self.uses = (np.zeros(1, np.int64) for _ in range(3))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def model_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        found = []
        for at in range(0, len(words), JOINED):
            data = np.frombuffer((self.between.join(words[at : at + JOINED]) + self.between).encode(), np.uint8)
            (own,) = self.model.encode_batch_fast([self.letters[data].tobytes().decode("utf-32-le")], add_special_tokens=False)
            found.append(np.array(own.ids, "<u4"))
        ids = np.concatenate(found)
        is_mark = ids == self.mark
        return ids[~is_mark], np.diff(np.flatnonzero(is_mark), prepend=-1) - 1

    def usual(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(a in text for a in self.added)

    def places(self, named: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, named, repeat(0)), np.int64, len(named))

    def word_places(self, words: list[str]) -> np.ndarray:
        """Places of words of usual texts; those not met before are kept."""
        names = [w[1:] if w[0] == " " else " " + w for w in words]
        at = self.places(names)
        if len(missing := np.flatnonzero(at == 0)):
            new: dict[str, int] = {}
            at[missing] = [new.setdefault(names[i], len(new)) for i in missing.tolist()]
            at[missing] += self.keep(new, *self.model_ids([w[1:] if w[0] == " " else " " + w for w in new]))
        return at

    def heads(self, texts: list[str]) -> list[bytes]:
        """Ids of first pieces, which have no space before them."""
        words = [WORDS.findall(t) if self.usual(t) else None for t in texts]
        at = self.word_places([w for own in words if own for w in own])
        n = self.lengths[at]
        data, upto = runs(self.ids, self.starts[at], n).tobytes(), [0, *(4 * np.cumsum(n)).tolist()]
        ends = np.cumsum([len(own or ()) for own in words]).tolist()
        return [self.whole(t) if own is None else data[upto[end - len(own)] : upto[end]] for t, own, end in zip(texts, words, ends, strict=True)]

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Places of new pieces, none of which is empty or begins with white space; they are kept."""
        places = np.zeros(len(pieces), np.int64)
        usual = np.ones(len(pieces), bool) if self.usual(" ".join(pieces)) else np.fromiter(map(self.usual, pieces), bool, len(pieces))
        if len(rest := np.flatnonzero(~usual)):
            own = [pieces[i] for i in rest.tolist()]
            found = [self.whole(" " + p) for p in own]
            places[rest] = self.keep(own, np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found])) + np.arange(len(own))
        if len(rest := np.flatnonzero(usual)):
            # Pieces have no spaces, so words that begin with one are the first of each.
            words = WORDS.findall(" " + " ".join([pieces[i] for i in rest.tolist()]))
            at = self.word_places(words)
            first = np.array([i for i, w in enumerate(words) if w[0] == " "])
            count = np.diff(first, append=len(words))
            places[rest] = at[first]
            if len(several := np.flatnonzero(count > 1)):
                at = at[np.repeat(count > 1, count)]
                n, count, rest = self.lengths[at], count[several], rest[several]
                lengths = np.add.reduceat(n, np.cumsum(count) - count)
                places[rest] = self.keep([pieces[i] for i in rest.tolist()], runs(self.ids, self.starts[at], n), lengths) + np.arange(len(rest))
        return places

    def keep(self, pieces: Collection[str], ids: np.ndarray, lengths: np.ndarray) -> int:
        """Keeps the ids of pieces that are not known; gives the first one's place."""
        at, upto = len(self.known) + 1, np.cumsum(lengths)
        self.starts, self.lengths, self.uses = (with_room(x, at, len(pieces)) for x in (self.starts, self.lengths, self.uses))
        self.starts[at : at + len(pieces)], self.lengths[at : at + len(pieces)], self.uses[at : at + len(pieces)] = self.used + upto - lengths, lengths, 0
        self.ids = with_room(self.ids, self.used, len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(pieces, range(at, at + len(pieces)), strict=True))
        return at

    def forget(self) -> None:
        """Pieces of more than one batch stay, at most half of KEPT: those of most batches."""
        names, uses = list(self.known), self.uses[1 : len(self.known) + 1]
        half = len(uses) - KEPT // 2 - 1
        most = max(1, int(np.partition(uses, half)[half]))
        stay = np.flatnonzero(uses > most)
        n, uses = self.lengths[stay + 1], uses[stay] >> 1
        ids = runs(self.ids, self.starts[stay + 1], n)
        self.known, self.used = {}, 0
        self.keep([names[i] for i in stay.tolist()], ids, n)
        self.uses[1 : len(uses) + 1] = uses

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if not self.pieces or not len(texts):
            found = [self.whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy()
        words = split.values.dictionary_encode()
        codes, named = words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > KEPT:
            self.forget()
        at = self.places(named)
        new = np.flatnonzero(at == 0).tolist()
        other = [i for i in new if not named[i] or named[i][0].isspace()]
        if len(other) < len(new):
            odd = set(other)
            new = [i for i in new if i not in odd]
            at[new] = self.learn([named[i] for i in new])
        self.uses[at] += 1
        # Where others than first pieces are unusual, or the first one is, the whole text is encoded; it then counts as its first piece.
        first = bounds[:-1]
        whole = np.zeros(len(first), bool)
        if other:
            whole[np.searchsorted(bounds, np.flatnonzero(np.isin(codes, other)), "right") - 1] = True
        usual = np.flatnonzero(~whole)
        heads = [b""] * len(first)
        for i, ids in zip(usual.tolist(), self.heads([named[c] for c in codes[first[usual]].tolist()]), strict=True):
            heads[i] = ids
        for i in np.flatnonzero(whole).tolist():
            heads[i] = self.whole(texts[i].as_py())
        # Unusual pieces have place 0 and no ids of their own.  First pieces' ids stand behind what is kept, until something else does.
        of = at.take(codes)
        starts, n = self.starts.take(of), self.lengths.take(of)
        n[np.repeat(whole, np.diff(bounds))] = 0
        n[first] = np.fromiter(map(len, heads), np.int64, len(heads)) // 4
        starts[first] = self.used + np.cumsum(n[first]) - n[first]
        own = np.frombuffer(b"".join(heads), "<u4")
        self.ids = with_room(self.ids, self.used, len(own))
        self.ids[self.used : self.used + len(own)] = own
        ids = runs(self.ids, starts, n)
        return ids, np.add.reduceat(n, first)


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a local path or a URI that Arrow knows."""
    return pa.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1)) if ":/" in uri else (pa.fs.LocalFileSystem(), uri)


def file_head(vocabulary: int, end: int) -> bytes:
    return FILE.pack(MAGIC, vocabulary, end)


def pack_group(docs: list[tuple[int | None, np.ndarray]], vocabulary: int) -> bytes:
    """Whole documents (id, token ids) as a group."""
    named = np.array([d is not None for d, _ in docs], np.uint8)
    table = named.tobytes() + np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.array([len(x) for _, x in docs], "<u8").tobytes()
    table = zlib.compress(table, 1)
    ids = np.concatenate([x for _, x in docs])
    blocks = [encode(ids[at : at + BLOCK], vocabulary) for at in range(0, len(ids), BLOCK)]
    return b"".join([GROUP.pack(GROUP_MAGIC, len(docs), len(ids), len(blocks), len(table), zlib.crc32(table)), table, *blocks])


def unpack_group(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, token ids) of a group's documents, in order."""
    if len(data) < GROUP.size:
        raise CodecError("a group ends in its header")
    magic, n_docs, n_ids, n_blocks, size, crc = GROUP.unpack_from(data)
    table = data[GROUP.size : GROUP.size + size]
    if magic != GROUP_MAGIC or zlib.crc32(table) != crc:
        raise CodecError("a group's documents aren't those that were written")
    table = zlib.decompress(table)
    named, doc_ids, lengths = np.frombuffer(table, np.uint8, n_docs), np.frombuffer(table, "<i8", n_docs, n_docs), np.frombuffer(table, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    at, parts = GROUP.size + size, []
    for _ in range(n_blocks):
        end = at + HEADER.size + HEADER.unpack_from(data, at)[1]
        parts.append(decode(data[at:end]))
        at = end
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if len(ids) != n_ids or lengths.sum() != n_ids or at != len(data):
        raise CodecError("a group's ids aren't those that were written")
    starts = np.cumsum(lengths) - lengths
    for ok, doc, start, n in zip(named, doc_ids.tolist(), starts.tolist(), lengths.tolist(), strict=True):
        yield (doc if ok else None), ids[start : start + n]


def write_ids(docs: DataFrame, path: str, folder: str | None = None, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes all texts, with the id ``end`` after each, into files below ``folder``; gives the table of their groups (MANIFEST), written beside them.

    Documents come by doc_id, null first; rows of one id by a hash of their text, and
    repeated rows stay.  Null texts count as empty.  A group has as many whole
    documents as fit into a block, at least one.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = f"{folder or shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, file, at, rows, held, size = encoder(path), None, 0, [], [], 0
        part = TaskContext.get().partitionId()
        system, root = open_folder(folder)
        name = f"{part:06d}-{uuid.uuid4().hex}.tokids"

        def flush():
            nonlocal file, at, held, size
            if file is None:
                system.create_dir(root, recursive=True)
                file = system.open_output_stream(f"{root}/{name}")
                at = file.write(file_head(tokens.vocabulary, end))
            group = pack_group(held, max(tokens.vocabulary, end + 1))
            file.write(group)
            rows.append((part, len(rows), f"{folder}/{name}", at, len(group), len(held), size))
            at, held, size = at + len(group), [], 0

        for batch in batches:
            ids, lengths = tokens.encode(batch.column(1))
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, np.uint32(end))
            ends += np.arange(1, len(ends) + 1)
            for doc, upto, n in zip(batch.column(0).to_pylist(), ends.tolist(), (lengths + 1).tolist(), strict=True):
                if held and size + n > BLOCK:
                    flush()
                held.append((doc, ids[upto - n : upto]))
                size += n
        if held:
            flush()
        if file is not None:
            file.close()
        columns = zip(*rows, strict=True) if rows else [()] * 7
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    return SharedTable(own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST), "token-groups").df


def read_groups(groups: DataFrame, columns, schema: str) -> DataFrame:
    """Rows of ``columns(start, documents)`` for each group of a table of groups, each read and checked by itself.

    ``start`` is the number of ids before the group in all files, ``documents``
    gives (doc_id, ids) in order.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range of documents.
    parts = groups.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    placed = groups.withColumn("own", F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("place"))), F.lit(0))).join(F.broadcast(parts), "part")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, where = open_folder(file)
                with system.open_input_file(where) as source:
                    if source.read_at(len(MAGIC), 0) != MAGIC:
                        raise CodecError("not a file of token ids")
                    data = source.read_at(size, at)
                yield pa.RecordBatch.from_arrays(columns(start, unpack_group(data)), names)

    n = groups.count()
    tasks = max(1, min(n, max(64, n // 4)))
    return placed.select("file", "at", "size", (F.col("own") + F.col("base")).alias("start")).repartition(tasks).mapInArrow(run, schema)


def read_ids(groups: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of all documents in files of token ids."""

    def columns(start, documents):
        docs, starts, lists = [], [], []
        for doc, ids in documents:
            docs.append(doc), starts.append(start), lists.append(ids.astype(np.int64))
            start += len(ids)
        return [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(lists, pa.list_(pa.int64()))]

    return read_groups(groups, columns, "doc_id long, start long, ids array<long>")


def id_checksums(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, read back from the files written for them; an empty table has no files and no rows."""

    def columns(start, documents):
        rows = []
        for doc, ids in documents:
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            start += len(ids)
        return [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)]

    return read_groups(write_ids(docs, path), columns, "doc_id long, start long, n_tokens long, ids_crc32 long")
