"""BPE encoding and decoding that reuses content-defined chunks.

A rolling hash of the last bytes cuts texts into chunks, so passages that
documents share yield the same chunks wherever they stand.  What lies between
a chunk's first and last white space is encoded once per worker and kept.  A
chunk's broken words at both ends are joined with those of its neighbours and
encoded again; then the joined word is encoded once more together with the
words on both sides, and all ids must agree with those of the parts.  Where they
don't, the whole text is encoded at one go.

Chunks are reused for tokenizers whose parts are known never to join text across
white space; with any other one every text is encoded at one go.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Bytes that the rolling hash sees, and one in how many places it cuts at.
WINDOW, MEAN_CHUNK = 4, 1024
SLICE = 1 << 22
#: What stands before the first, between, and after the last ASCII white space.
_ENDS = re.compile(rb"([^ \t\n\r\v\f]*)([ \t\n\r\v\f](?:.*[ \t\n\r\v\f])?)([^ \t\n\r\v\f]*)", re.DOTALL)
#: Entries that a worker keeps; those not used for longest go when they are full.
CHUNKS_KEPT, WORDS_KEPT = 4096, 400_000


# The parts of a tokenizer whose chunks can be reused.
PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"}


def has_known_parts(path: str) -> bool:
    """Whether the tokenizer's parts are those of PARTS and MODEL, and no token that was added to its vocabulary holds white space."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    model, added = found.get("model", {}), found.get("added_tokens") or ()
    plain = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in added)
    return plain and all(found.get(k) == v for k, v in PARTS.items()) and all(model.get(k) == v for k, v in MODEL.items())


def cuts(data: bytes) -> Iterator[int]:
    """Places where the rolling hash cuts, the end included; they depend on the bytes just before them alone."""
    for start in range(0, len(data), SLICE):
        b = np.frombuffer(data, np.uint8, min(len(data) - start, SLICE + WINDOW), start)
        if len(b) <= WINDOW:
            break
        h = np.zeros(len(b) - WINDOW, np.uint32)
        for k in range(WINDOW):
            h *= np.uint32(0x01000193)
            h += b[k : len(b) - WINDOW + k]
        h *= np.uint32(0x9E3779B1)
        at = np.flatnonzero(h < np.uint32((1 << 32) // MEAN_CHUNK)) + WINDOW
        for i in at[(b[at] & 0xC0) != 0x80].tolist():
            yield start + i
    yield len(data)


class _Kept:
    """The entries used last, in two generations: what is found in the older one moves on to the newer."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most // 2, {}, {}

    def get(self, key):
        if (value := self.new.get(key)) is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value):
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


def _letters(text: str) -> bool:
    """Nothing but letters, in its normal form and lower case too."""
    return text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", text).lower().isalpha())


class ChunkEncoder:
    """Encodes texts exactly as the tokenizer without special tokens added; ids are bytes, four each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunked = has_known_parts(path)
        self.words, self.chunks = _Kept(WORDS_KEPT), _Kept(CHUNKS_KEPT)
        #: Bytes of all texts, and of chunks that were found encoded.
        self.seen = self.reused = 0

    def learn(self, words: set[bytes]) -> None:
        """Encodes all new words of letters at one go; each is one pre-token, whose last token ends the word."""
        new = set()
        for word in words:
            text = word.decode("utf-8")
            text = text[:-1] if text[-1] in ".," else text
            text = text.lower() if text.isascii() else text
            if len(text) <= 64 and _letters(text) and self.words.get(text.encode("utf-8")) is None:
                new.add(text)
        if new:
            new = list(new)
            found, at = self.tokenizer.encode(" ".join(new), add_special_tokens=False), 0
            ids = found.ids
            ends = [i for i, t in enumerate(found.tokens, 1) if t.endswith("</w>")]
            for text, end in zip(new, ends, strict=True):
                self.words.put(text.encode("utf-8"), struct.pack(f"<{end - at}I", *ids[at:end]))
                at = end

    def word(self, word: bytes) -> bytes:
        """A run without ASCII white space."""
        if (known := self.words.get(word)) is not None:
            return known
        text = word.decode("utf-8")
        if len(word) > 1 and word[-1:] in b".," and _letters(text[:-1]):
            return self.words.put(word, self.word(word[:-1]) + self.word(word[-1:]))
        if text.isascii() and text.isalpha() and not text.islower():
            return self.words.put(word, self.word(word.lower()))
        return self.words.put(word, self.encoded(text)) if len(word) <= 64 else self.encoded(text)

    def encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def body(self, body: bytes) -> bytes:
        """A chunk between its first and last white space."""
        if (known := self.chunks.get(body)) is not None:
            self.reused += len(body)
            return known
        words = body.split()
        self.learn(set(words).difference(self.words.new))
        get = self.words.new.get
        piece = b"".join([get(w) or self.word(w) for w in words])
        return self.chunks.put(body, piece) if len(body) <= 16 * MEAN_CHUNK else piece

    def agrees(self, before: bytes, word: bytes, after: bytes) -> bool:
        """Whether a joined word has the same ids by itself as between the words on both sides."""
        return self.encoded(b" ".join([before, word, after]).decode("utf-8")) == self.word(before) + self.word(word) + self.word(after)

    def pieces(self, data: bytes) -> Iterator[bytes | None]:
        """Ids of a text piece by piece; None once a join doesn't agree."""
        last, open_word, before = 0, [], b""
        for cut in cuts(data):
            chunk, last = data[last:cut], cut
            found = _ENDS.fullmatch(chunk)
            if not found:  # no white space: the word goes on
                open_word.append(chunk)
                continue
            head, middle, tail = found.groups()
            if joined := b"".join([*open_word, head]):
                yield self.word(joined)
            words = middle.split()
            if (before or open_word) and not self.agrees(before, joined, words[0] if words else b""):
                yield None
                return
            if words:
                yield self.body(middle)
            before, open_word = words[-1] if words else joined or before, [tail] if tail else []
        if open_word:
            yield self.word(joined := b"".join(open_word))
            if not self.agrees(before, joined, b""):
                yield None

    def encode(self, text: str | None) -> np.ndarray:
        data = (text or "").encode("utf-8")
        self.seen += len(data)
        out = list(self.pieces(data)) if self.chunked else [None]
        return np.frombuffer(b"".join(out) if None not in out else self.encoded(text or ""), "<u4")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the text that the ids decode to."""
        ids = self.encode(text)
        decoded = self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()


@lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode_column(text: Column, path: str) -> Column:
    """Ids of each text; null counts as empty."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        own = encoder(path)
        return pd.Series([own.encode(t).astype(np.int32) for t in texts])

    return ids(text)


def decode_column(ids: Column, path: str) -> Column:
    """Text of each id list; null counts as empty, null ids in it are skipped."""

    @F.pandas_udf("string")
    def decoded(lists):
        import pandas as pd

        tokenizer = encoder(path).tokenizer
        return pd.Series([tokenizer.decode([int(i) for i in x if i is not None] if x is not None else [], skip_special_tokens=False) for x in lists])

    return decoded(ids)


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the ids of each text as the last column, ``token_ids`` (with underscores before it if that name is taken)."""
    bound_batches(docs.sparkSession)
    name = "token_ids"
    while name in docs.columns:
        name = "_" + name
    return docs.select("*", encode_column(F.col(text), path).alias(name))


def token_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; null texts count as empty, repeated rows stay."""
    bound_batches(docs.sparkSession)

    def run(batches):
        own = encoder(path)
        for batch in batches:
            found = [own.digest(t.as_py()) for t in batch.column(1)]
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
