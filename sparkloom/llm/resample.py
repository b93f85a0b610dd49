"""Importance resampling of documents towards the words of a target.

A byte automaton reads the UTF-8 buffer of a whole Arrow batch at once: a table
classifies (and lower-cases) every byte, differences of the classes are the
words' bounds, and the CRC-32 of all words advances a byte at a time over all
starts together.  Features (runs of words) fall into buckets by CRC; how much
more often the target has a bucket than all documents is the bucket's gain, and
the mean gain of a document's features its weight.  Gumbel noise from a hash
of the id is added, so that the highest scores are a draw without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTable, bound_batches

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, "2024"
#: Words that still go on when their number is this small are finished one by one.
FEW = 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words, once lower-cased: digits, a to z, and all of characters beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states after each start's next bytes; all starts take their first byte, then their second one, and so on."""
    order = np.argsort(-lengths, kind="stable")
    own, at, n = state[order], starts[order], lengths[order]
    k, step = int(np.count_nonzero(n)), 0
    while k > FEW:
        own[:k] = CRC[(own[:k] ^ data[at[:k] + step]) & 0xFF] ^ (own[:k] >> 8)
        step += 1
        while k and n[k - 1] <= step:
            k -= int(np.count_nonzero(n[max(0, k - 4096) : k] <= step))
    for i in range(k):
        own[i] = zlib.crc32(data[at[i] + step : at[i] + n[i]].tobytes(), int(own[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(own)
    out[order] = own
    return out


def word_features(data: np.ndarray, offsets: np.ndarray, ngrams: int = 1) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for 1 to ``ngrams`` words: each run's text and CRC-32, texts ascending.

    Text i is ``data[offsets[i]:offsets[i + 1]]``; the texts follow each other.
    """
    low, high = int(offsets[0]), int(offsets[-1])
    data, offsets = LOWER[data[low:high]], offsets.astype(np.int64) - low
    kind = np.zeros(len(data) + 2, np.int8)
    kind[1:-1] = WORD[data]
    step = np.diff(kind)
    begins, ends = step[:-1] == 1, step[1:] == -1
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # a text that goes on in the next one's word ends there
    inner = inner[(kind[inner] == 1) & (kind[inner + 1] == 1)]
    begins[inner], ends[inner - 1] = True, True
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    texts = np.searchsorted(offsets, starts, "right") - 1
    found, state, whole = [], np.full(len(starts), 0xFFFFFFFF, np.uint32), np.arange(len(starts))
    for n in range(ngrams):
        if n:
            whole = whole[: len(whole) - 1] if len(whole) and whole[-1] + n >= len(starts) else whole
            same = texts[whole] == texts[whole + n]
            whole, state = whole[same], state[: len(whole)][same]
            state = CRC[(state ^ 0x20) & 0xFF] ^ (state >> 8)
        state = advance(state, data, starts[whole + n], lengths[whole + n])
        found.append((texts[whole], state ^ np.uint32(0xFFFFFFFF)))
    return np.bincount(texts, minlength=len(offsets) - 1), found


def text_features(column: pa.Array, ngrams: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """word_features() of an Arrow column of strings; null counts as empty."""
    if not len(column):
        return np.zeros(0, np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.uint32))] * ngrams
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    return word_features(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets, ngrams)


def bucket_counts(docs: DataFrame, ngrams: int = 1, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """Features of all texts in each bucket.  A task sends one row a bucket at most; the driver gets ``buckets`` numbers, whatever the rows."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, crc in text_features(batch.column(0), ngrams)[1]:
                total += np.bincount(crc % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's share over the own share), each bucket counted once more than it is."""
    own, target, n = own.astype(float), target.astype(float), float(len(own))
    return np.floor(1000 * np.log((target + 1) * (own.sum() + n) / ((own + 1) * (target.sum() + n)))).astype(np.int64)


def importance_scores(
    docs: DataFrame, target: DataFrame, *, ngrams: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, keep: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, and the columns of ``keep``.

    Of the documents with ``least_words`` words at least, ``percent`` in a
    hundred (rounded down) are drawn: highest scores first, ties to smaller
    ids, repeated rows each for itself; the others have no rank.  A null text
    has no features and weight 0, a null id counts as an empty one in the noise and comes last in ties.

    Texts are read twice: for the counts and for the weights.  Only narrow rows
    are written, and only those of scores that are drawn move.  There are
    some 200,000 different scores at most (logarithms of counts, in
    thousandths), so the table of ranks by score is small whatever the rows.
    """
    bound_batches(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, ngrams, buckets, text), bucket_counts(target, ngrams, buckets, text))
    kept = [c for c in keep if c not in ("doc_id", "n_features", "weight", "score", "rank")]
    own = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c) for c in kept], F.col(text).alias("_text"))
    names = [f.name for f in own.schema.fields[:-1]]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, found = text_features(batch.column(batch.num_columns - 1), ngrams)
            n, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for texts, crc in found:
                bounds = np.searchsorted(texts, np.arange(len(words) + 1))
                sums = np.concatenate([[0], np.cumsum(gains[crc % buckets])])
                n, total = n + np.diff(bounds), total + np.diff(sums[bounds])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], [*names, "_words", "n_features", "weight"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]) + ", _words long, n_features long, weight long"
    noise = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(noise.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = SharedTable(own.mapInArrow(weigh, schema).withColumn("score", score.cast("long")), "importance").df

    fit = F.col("_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    before = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    starts = scored.where(fit).groupBy("score").count().select("score", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")).where(F.col("_start") < drawn)
    among = scored.where(fit).join(F.broadcast(starts), "score")
    ranked = among.withColumn("rank", F.col("_start") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    cut = starts.agg(F.min("score")).first()[0]
    others = scored.where(~fit if cut is None else ~fit | (F.col("score") < cut)).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank", *kept]
    return ranked.select(columns).unionByName(others.select(columns))


def importance_sample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; options as of importance_scores()."""
    doc_id = options.get("doc_id", "doc_id")
    found = importance_scores(docs.withColumn("_all", F.struct(*docs.columns)), target, keep=("_all",), **{**options, "doc_id": doc_id})
    return found.where("rank is not null").select("_all.*")


def importance_sql(buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> str:
    """DuckDB SQL of importance_scores() for single words, CRC-32 included."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    step = "CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END"
    return f"""
WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::UBIGINT, list_transform(range(8), lambda i: i::UBIGINT)), lambda r, i: {step})) AS tab),
d AS (SELECT doc_id, {words} AS words FROM documents), b AS (SELECT unnest({words}) AS word FROM benchmark),
dw AS (SELECT doc_id, unnest(words) AS word FROM d),
vocabulary AS (SELECT word, hex(encode(word)) AS bytes FROM (SELECT word FROM dw UNION SELECT word FROM b)),
coded AS (SELECT word, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(bytes) // 2 + 1), lambda i: ('0x' || substr(bytes, 2 * i - 1, 2))::UBIGINT)),
  lambda c, x: xor(c // 256, tab[(xor(c, x) % 256)::BIGINT + 1])), 4294967295::UBIGINT) % {buckets})::BIGINT AS bucket FROM vocabulary, bits),
own AS (SELECT bucket, count(*) AS s FROM dw JOIN coded USING (word) GROUP BY bucket), wanted AS (SELECT bucket, count(*) AS t FROM b JOIN coded USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {buckets})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + {buckets})::DOUBLE)))::BIGINT AS gain
  FROM own FULL JOIN wanted USING (bucket)),
weights AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN coded USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, CASE WHEN n_features >= {least_words} THEN row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM ranked WHERE n_features >= {least_words}) * {percent} // 100 THEN place END AS rank FROM ranked"""
