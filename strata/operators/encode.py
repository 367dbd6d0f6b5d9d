"""Text to vector (VEC1): a pluggable batch encoder.

The default encoder is a deterministic hashed bag of words: lower-case the text, take the
letter/digit/underscore runs as tokens, send each token to bucket
``int(md5(token)[:8], 16) % dim`` and count. It is a per-row map (no shuffle) run through an
Arrow-batched UDF, which is also the slot a real model takes: ``model_encoder`` wraps any
batch ``predict`` function with ``predict_batch_udf``.

The stored vector is the raw count vector. Cosine similarity is scale-free, so this equals
searching unit vectors, and integer counts make every dot product exact, so rankings do not
depend on summation order (BLAS blocking, engine, partitioning).
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: token pattern (letters, digits, underscore: what Python's \w is on str) and dimension
TOKEN_PATTERN = r"\w+"
DEFAULT_DIM = 64

FLUSH_TOKENS = 1 << 16       # tokens held as Python objects at once
_BUCKETS_CAP = 1 << 18       # tokens whose bucket a worker keeps
_FIND = re.compile(TOKEN_PATTERN).finditer


def token_bucket(token: str, dim: int) -> int:
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dim


class _Buckets(dict):
    """token -> bucket, kept across batches in a reused Python worker."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        b = token_bucket(token, self.dim)
        if len(self) < _BUCKETS_CAP:
            self[token] = b
        return b


_KEPT: dict = {}             # dim -> its buckets


@lru_cache(maxsize=1)
def _word_chars() -> np.ndarray:
    """Whether a code point belongs to a token, for every one."""
    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 0  # surrogates are in no text
    chars = np.zeros(len(points), dtype=bool)
    for run in _FIND(points.tobytes().decode("utf-32-le")):
        chars[run.start():run.end()] = True
    return chars


def _long_text(text: str, bucket, dim: int) -> np.ndarray:
    """Counts of a text that is cut FLUSH_TOKENS tokens at a time."""
    counts = np.zeros(dim)
    found = _FIND(text.lower())
    while buckets := [bucket(x.group()) for x in islice(found, FLUSH_TOKENS)]:
        counts += np.bincount(buckets, minlength=dim)
    return counts


def _texts(texts, bucket, dim: int) -> np.ndarray:
    """Counts of several texts (an Arrow array without NULLs), cut in one go: joined by NULs, all other
    characters that belong to no token become spaces, and a token's row is the number of NULs before it."""
    n, sep = len(texts), pa.scalar("\0", texts.type)
    join = lambda x: pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x), sep)[0].as_py()
    joined = join(texts)
    if joined.count("\0") >= n:  # as good a separator within a text
        joined = join(pc.replace_substring(texts, "\0", " "))
    points = np.frombuffer(joined.lower().encode("utf-32-le"), dtype="<u4")
    word = _word_chars()[points]
    first = word.copy()
    first[1:] &= ~word[:-1]
    rows = np.searchsorted(np.flatnonzero(points == 0), np.flatnonzero(first))
    tokens = np.where(word, points, np.uint32(32)).tobytes().decode("utf-32-le").split()
    flat = rows * dim + np.fromiter(map(bucket, tokens), dtype=np.int64, count=len(tokens))
    counts = np.zeros(n * dim)
    for at in range(0, len(flat), FLUSH_TOKENS):
        counts += np.bincount(flat[at:at + FLUSH_TOKENS], minlength=n * dim)
    return counts.reshape(n, dim)


def encode_matrix(texts, dim: int = DEFAULT_DIM):
    """Count matrix (len(texts) x dim) of a batch (an Arrow array or strings) plus its NULL mask. Texts of
    some FLUSH_TOKENS tokens are cut together, a longer one by itself in parts, so what is held does not
    grow with the texts."""
    bucket = _KEPT.setdefault(dim, _Buckets(dim)).__getitem__
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    column = pc.fill_null(column, "")
    m = np.zeros((len(column), dim))
    if not len(column):
        return m, nulls
    ends = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64) + 1)
    at = 0
    while at < len(column):  # at most 2 * FLUSH_TOKENS bytes with their separators, or one text
        before = ends[at - 1] if at else 0
        end = int(np.searchsorted(ends, before + 2 * FLUSH_TOKENS, side="right"))
        if end <= at:
            end = at + 1
            m[at] = _long_text(column[at].as_py(), bucket, dim)
        else:
            m[at:end] = _texts(column.slice(at, end - at), bucket, dim)
        at = end
    return m, nulls


def hashed_bow(text_col, dim: int = DEFAULT_DIM) -> Column:
    """Column expression: ``array<double>`` term-count vector of ``text_col``.

    An Arrow UDF: the batch arrives as an Arrow string array and leaves as one list array
    built on the count matrix's buffer, with no per-row Python objects on the way out."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def _encode(s: pa.Array) -> pa.Array:
        m, nulls = encode_matrix(s, dim)
        offsets = pa.array(np.arange(0, (len(m) + 1) * dim, dim, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(m.ravel()), mask=pa.array(nulls))

    return _encode(F.col(text_col) if isinstance(text_col, str) else text_col)


def model_encoder(make_predict_fn, dim: int, batch_size: int = 64):
    """Wrap a real batch model (``make_predict_fn() -> fn(np.ndarray[str]) -> np.ndarray``)
    as a Column function with the same contract as ``hashed_bow``: ``array<double>`` of length ``dim``,
    NULL for a NULL text. The model is made once a worker and sees ``batch_size`` texts at a time, never
    a NULL; a vector of another length fails the task."""
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)

    def encode_column(text: Column) -> Column:
        vec = predict(F.coalesce(text, F.lit("")))
        right = F.when(F.size(vec) == dim, vec).otherwise(F.raise_error(F.lit(f"the model's vectors are not of length {dim}")))
        return F.when(text.isNotNull(), right)
    return encode_column


def encode(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = DEFAULT_DIM,
           encoder=None) -> DataFrame:
    """Add ``out_col`` with the vector of ``text_col`` (default: hashed bag of words)."""
    col = encoder(F.col(text_col)) if encoder is not None else hashed_bow(text_col, dim)
    return df.withColumn(out_col, col)


def sparse_terms(df: DataFrame, id_col: str, vec_col: str = "embedding") -> DataFrame:
    """Non-zero entries of a count vector as rows (id, bucket, count, weight) where weight is
    the entry of the unit vector.

    The unit vector is built once per row and zipped with the counts before exploding, so
    the norm is not recomputed per entry. ``posexplode_outer`` + a count filter (rather than
    ``posexplode``) keeps Catalyst from inferring a size filter on the encoder's output that
    it would push below an exchange, evaluating the encoder twice."""
    from ..functions.vectors import l2_normalize
    pairs = F.arrays_zip(F.col(vec_col).alias("c"), l2_normalize(vec_col).alias("w"))
    x = df.select(id_col, F.posexplode_outer(pairs).alias("bucket", "e"))
    return (x.where(F.col("e.c") > 0)
             .select(id_col, F.col("bucket").cast("int").alias("bucket"), F.col("e.c").cast("long").alias("count"),
                     F.col("e.w").alias("weight")))
