"""Target-distribution importance resampling: words are hashed to buckets by CRC-32, a document's weight is the sum
of its buckets' log ratios between target and corpus, and the highest weights with Gumbel noise are drawn.

CRC-32 is linear over XOR, so the sum of a word is the XOR of what each of its bytes gives at its distance from the
word's end (one table of distance by byte) and of a constant of the word's length. Words longer than the table are cut
into blocks from their end and folded block by block.

Texts: null and empty texts have no features, weight 0 and no rank. A null doc_id is hashed as an empty id and comes
last among equal scores. Repeated rows are rows of their own; equal ones are ranked one after another. An empty corpus
gives an empty result, an empty target counts 0 in every bucket. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_texts, ranked, release, saved, small_batches

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Distances from the end that the table has: words of at most this many bytes take one look-up a byte.
REACH = 64
#: Bytes whose positions are worked out at once.
STRETCH = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _table() -> np.ndarray:
    """[distance, byte]: the register after the byte and as many zero bytes, from a register of zero."""
    first = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
    rows = [first]
    for _ in range(REACH - 1):
        rows.append((rows[-1] >> 8) ^ first[rows[-1] & 255])
    return np.stack(rows)


_GIVES = _table()
_OF_LENGTH = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], dtype=np.uint32)


def _spans_xor(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XOR of the bytes' contributions for spans of 1 to REACH bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint32)
    begins = np.cumsum(lengths) - lengths
    inside = np.arange(begins[-1] + lengths[-1]) - np.repeat(begins, lengths)
    gives = _GIVES[np.repeat(lengths, lengths) - 1 - inside, data[np.repeat(starts, lengths) + inside]]
    return np.bitwise_xor.reduceat(gives, begins)


def _past_block(register: np.ndarray) -> np.ndarray:
    """Registers after REACH zero bytes."""
    return np.bitwise_xor.reduce([_GIVES[REACH - 1 - i, (register >> (8 * i)) & 255] for i in range(4)])


def _fold(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of spans longer than REACH: block by block from the front, all spans at once, the first block being the odd one."""
    counts = -(-lengths // REACH)
    order = np.argsort(-counts, kind="stable")
    starts, lengths, counts = starts[order], lengths[order], counts[order]
    heads = lengths - (counts - 1) * REACH
    flip = (starts[:, None] + np.arange(4)).ravel()  # a register of ones at the start is four flipped bytes
    data[flip] ^= 255
    register = _spans_xor(data, starts, heads)
    at = starts + heads
    for k in range(1, int(counts[0])):
        live = int(np.searchsorted(-counts, -k, side="left"))  # spans with more than k blocks
        register[:live] = _past_block(register[:live]) ^ _spans_xor(data, at[:live], np.full(live, REACH))
        at[:live] += REACH
    data[flip] ^= 255
    out = np.empty_like(register)
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    return out


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for each span; all are 1 byte long at least."""
    lengths = ends - starts
    out = np.empty(len(starts), dtype=np.uint32)
    short = lengths <= REACH
    out[short] = _spans_xor(data, starts[short], lengths[short]) ^ _OF_LENGTH[lengths[short]]
    if not short.all():
        out[~short] = _fold(data, starts[~short], lengths[~short])
    return out


def _stretches(inside: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about STRETCH bytes that cut no word; a longer word is whole."""
    at, n = 0, len(inside)
    texts = set(offsets.tolist()) if n > STRETCH else ()
    while at < n:
        end = min(at + STRETCH, n)
        if end < n and end not in texts and inside[end - 1] and inside[end]:
            gaps = np.flatnonzero(~inside[at:end])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < n and inside[end] and end not in texts:
                    rest = np.flatnonzero(~inside[end : end + STRETCH])
                    end = end + int(rest[0]) if len(rest) else min(end + STRETCH, n)
        yield at, end
        at = end


def word_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words in order, how many words each text has)."""
    texts = pa.array(texts.fill_null(""), type=pa.large_string())
    _, offsets, chars = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(chars, dtype=np.uint8)[offsets[0] : offsets[-1]] if chars is not None else np.zeros(0, np.uint8)
    offsets, data = offsets - offsets[0], _LOWER[data]
    inside, found, begins = _IN_WORD[data], [], []
    for a, b in _stretches(inside, offsets):
        part = inside[a:b]
        cuts = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a  # where texts begin
        first, last = part.copy(), part.copy()
        first[1:] &= ~part[:-1]
        first[cuts] = part[cuts]
        last[:-1] &= ~part[1:]
        before = cuts[cuts > 0] - 1
        last[before] = part[before]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        found.append(span_crcs(data[a:b], starts, ends) % np.uint32(buckets))
        begins.append(starts + a)
    words, places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, begins))
    return words.astype(np.int64), np.diff(np.searchsorted(places, offsets))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many words of all texts fall into each bucket: summed in each task, then by bucket; ``buckets`` numbers come back."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for part in chunks(batches):
            total += np.bincount(word_buckets(part["text"].combine_chunks(), buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        release()
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket, both sides smoothed by one word a bucket."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every document; the drawn ones have a rank, highest score first.

    The corpus is read twice: for counts, then for weights. Ranks go over ranges of scores, so no task sees all rows.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))

    def work(part: pa.Table) -> dict[str, list]:
        found, counts = word_buckets(part["text"].combine_chunks(), buckets)
        sums = np.concatenate([[0], np.cumsum(gain[found])])
        ends = np.cumsum(counts)
        return {"doc_id": part["doc_id"].to_pylist(), "n_features": counts, "weight": sums[ends] - sums[ends - counts]}

    weighed = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id long, n_features long, weight long", work)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = saved(weighed.withColumn("score", F.col("weight") + noise.cast("long")))
    long_enough = F.col("n_features") >= min_words
    drawn = percent * scored.filter(long_enough).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = ranked(scored.filter(long_enough), order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("long")))


_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
RESAMPLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
dw AS (SELECT r, unnest(words) AS w FROM d),
bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) AS x(i))),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
bytes AS (SELECT w, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT) AS b FROM hexed),
bucket AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS} AS k FROM bytes, tab),
s AS (SELECT k, count(*) AS s FROM dw JOIN bucket USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM bw JOIN bucket USING (w) GROUP BY k),
gain AS (SELECT x.k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {BUCKETS}))))::BIGINT AS g FROM range({BUCKETS}) AS x(k) LEFT JOIN s ON s.k = x.k LEFT JOIN t ON t.k = x.k),
weights AS (SELECT r, sum(g)::BIGINT AS weight FROM dw JOIN bucket USING (w) JOIN gain USING (k) GROUP BY r),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)),
ranks AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id ASC NULLS LAST) AS p FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND p <= ({PERCENT} * (SELECT count(*) FROM scored WHERE n_features >= {MIN_WORDS})) // 100 THEN p END AS rank
FROM ranks
"""
