"""Local hash vectors of texts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspan import constants as K

_TOKEN = re.compile(r"[a-z0-9.+_-]+")
#: Rows whose tokens are held at once, and the longest token whose parts are kept.
ROWS_AT_ONCE = 64
CACHED_CHARS = 40


def bucket_of(token: Column, dims: int = K.EMBED_DIMS) -> Column:
    """First eight hex digits of the token's MD5, modulo ``dims``."""
    return (F.conv(F.substring(F.md5(F.encode(token, "UTF-8")), 1, 8), 16, 10).cast("bigint") % dims).cast("int")


def sign_of(token: Column) -> Column:
    """+1 or -1 by the parity of the ninth hex digit."""
    digit = F.conv(F.substring(F.md5(F.encode(token, "UTF-8")), 9, 1), 16, 10).cast("int")
    return F.when(digit % 2 == 0, 1.0).otherwise(-1.0)


def token_counts(lowered: str | None) -> dict[str, int]:
    """What ``terms.embedding_tokens`` makes of a text in lower case, with counts; every distinct token is cut up once."""
    raw = _TOKEN.findall(lowered or "")
    counts = Counter(f"{a}_{b}" for a, b in zip(raw, raw[1:]) if len(a) >= 2 and len(b) >= 2)
    for token, n in Counter(raw).items():
        if len(token) >= 2:
            for part in _parts(token) if len(token) <= CACHED_CHARS else _cut(token):
                counts[part] += n
    return counts


def _cut(token: str) -> tuple[str, ...]:
    """A token, its synonyms and, of a long one, its trigrams."""
    grams = (token[j:j + 3] for j in range(len(token) - 2)) if len(token) >= 5 else ()
    return token, *K.EMBED_SYNONYMS.get(token, ()), *grams


_parts = lru_cache(maxsize=50_000)(_cut)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[dict[str, int]]]]:
    """Few rows at a time with the token counts of their texts, so that a task holds little."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield part, [token_counts(t) for t in part.column("_text").to_pylist()]


def _fields(docs: DataFrame, key: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*key).schema)


def _keyed(part: pa.RecordBatch, key: list[str], sizes: list[int], values: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """The key of each row as often as it has values, then the values."""
    rows = pa.array(np.repeat(np.arange(part.num_rows), sizes))
    return pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in key), *values], [*key, *names])


def _by_key(docs: DataFrame, key: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """(key, _text in lower case) of the keys that have one row, and of those that have more."""
    lowered = docs.select(*key, F.lower(F.col(text)).alias("_text"))
    marks = [f"_key{n}" for n in range(len(key))]
    more = docs.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(
        *(F.col(k).alias(m) for k, m in zip(key, marks)))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(m)) for k, m in zip(key, marks)))
    return lowered.join(more, same, "left_anti"), lowered.join(more, same, "left_semi")


def _counted(texts: DataFrame, key: list[str]) -> DataFrame:
    """(key, token, freq) of each row (key, _text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _slices(batches):
            values = [pa.array([t for c in found for t in c], pa.string()), pa.array([n for c in found for n in c.values()], pa.int64())]
            yield _keyed(part, key, [len(c) for c in found], values, ["token", "freq"])

    return texts.mapInArrow(run, f"{_fields(texts, key)}, token string, freq bigint")


def token_frequencies(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, token, freq).  A text is counted in its row, so no token of a key with one row is exchanged; only the counts of
    rows that share a key are added up."""
    once, more = _by_key(docs, key, text)
    return _counted(once, key).unionByName(_counted(more, key).groupBy(*key, "token").agg(F.sum("freq").alias("freq")))


def _bucket_sums(frequencies: DataFrame, key: list[str], dims: int) -> DataFrame:
    weight = (F.lit(1.0) + F.log(F.lit(1.0) + F.col("freq"))) * sign_of(F.col("token"))
    return (
        frequencies.select(*key, bucket_of(F.col("token"), dims).alias("bucket"), weight.alias("weight"))
        .groupBy(*key, "bucket").agg(F.sum("weight").alias("weight"))
    )


def hash_buckets(docs: DataFrame, key: list[str], text: str = "text", dims: int = K.EMBED_DIMS) -> DataFrame:
    """(key, bucket, weight): signed log-frequency sums, not normalised; of a key with one row they are made in the row."""
    once, more = _by_key(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _slices(batches):
            sums = [_sums(c, dims) for c in found]
            used = [np.unique(buckets) for buckets, _ in sums]
            values = [
                pa.array(np.concatenate([*used, np.empty(0, np.int64)]), pa.int32()),
                pa.array(np.concatenate([*(w[u] for u, (_, w) in zip(used, sums)), np.empty(0)]), pa.float64()),
            ]
            yield _keyed(part, key, [len(u) for u in used], values, ["bucket", "weight"])

    summed = once.mapInArrow(run, f"{_fields(once, key)}, bucket int, weight double")
    rest = _counted(more, key).groupBy(*key, "token").agg(F.sum("freq").alias("freq"))
    return summed.unionByName(_bucket_sums(rest, key, dims))


@lru_cache(maxsize=200_000)
def _place(token: str, dims: int) -> tuple[int, float]:
    """Bucket and sign of a token, as ``bucket_of`` and ``sign_of`` have them."""
    digest = hashlib.md5(token.encode()).hexdigest()
    return int(digest[:8], 16) % dims, -1.0 if int(digest[8], 16) % 2 else 1.0


def _sums(counts: dict[str, int], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token, and the weight of every bucket."""
    places = [_place(token, dims) for token in counts]
    buckets = np.fromiter((b for b, _ in places), np.int64, len(places))
    signs = np.fromiter((s for _, s in places), float, len(places))
    weights = (1 + np.log1p(np.fromiter(counts.values(), float, len(counts)))) * signs
    return buckets, np.bincount(buckets, weights, minlength=dims).astype(float, copy=False)  # of nothing it is whole numbers


def embed_counts(counts: dict[str, int], dims: int = K.EMBED_DIMS) -> np.ndarray:
    """L2-normalised vector of token counts; the same sums as ``hash_buckets``, in the row."""
    if not counts:
        return np.zeros(dims, np.float32)
    _, sums = _sums(counts, dims)
    norm = np.sqrt((sums * sums).sum())
    return (sums / norm if norm > 0 else sums).astype(np.float32)


def embed_tokens(tokens, dims: int = K.EMBED_DIMS) -> np.ndarray:
    """``embed_counts`` of a token list."""
    return embed_counts(Counter(() if tokens is None else tokens), dims)


def hash_embed(docs: DataFrame, key: list[str], text: str = "text", dims: int = K.EMBED_DIMS) -> DataFrame:
    """(key, embedding): L2-normalised vector per row; all zero when it has no token.

    The text sits in one row, so nothing is exchanged.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _slices(batches):
            vectors = np.concatenate([*(embed_counts(c, dims) for c in found), np.empty(0, np.float32)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * dims, pa.int32()), pa.array(vectors, pa.float32()))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in key), lists], [*key, "embedding"])

    source = docs.select(*key, F.lower(F.col(text)).alias("_text"))
    return source.mapInArrow(run, f"{_fields(source, key)}, embedding array<float>")


def sum_vectors(rows: DataFrame, key: list[str], vector: str = "embedding") -> DataFrame:
    """(key, embedding): element-wise sum of the vectors of each group.

    Sums run per (group, dimension) with a map-side combine, so a group of any size
    needs no task to hold it.
    """
    return (
        rows.select(*key, F.posexplode(vector).alias("dim", "x"))
        .groupBy(*key, "dim").agg(F.sum(F.col("x").cast("double")).alias("x"))
        .groupBy(*key)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r["x"].cast("float"))
             .alias("embedding"))
    )
