"""Nearest neighbours by a block matrix join.

Vectors and queries are dealt to blocks by a hash of their id; each pair of a
query block and a vector tile is one task's work.  Blocks are as large as SIDE_BYTES
of vectors allow, so tiles are near-square and each side is copied as seldom as
the memory of a task lets it be.  In a tile the unit vectors are quantised to int8 and multiplied as a matrix.  The quantisation error of each
vector is known, so every product has a bound: a pair survives unless its upper
bound is below the k-th best lower bound of its query.  Survivors are computed
again from the original vectors in double precision, and a heap keeps the k best
of the tile; the heaps of all tiles of a query are merged by a ranked top k.
Vectors are first brought to a common magnitude by a power of two, which changes
no bit of a cosine and keeps squares of very large or small components finite.

No pair that belongs to the result can be lost, so recall is 1.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part; rows that repeat an id count once, with the smallest
vector; a query is never its own neighbour; vectors of another dimension than
the query's are no candidates; ties go to the smaller id; a query without
candidates has no rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.runtime import ship, stash

#: Bytes of vectors on either side of a tile, and tiles that a small table is cut into all the same.
SIDE_BYTES, LEAST_TILES = 32 << 20, 12
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that take part, as bytes of doubles."""
    for batch in batches:
        batch = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
        lists = batch.column(1)
        size = np.asarray(pc.list_value_length(lists), dtype=np.int64)
        flat = pc.fill_null(pc.cast(lists.flatten(), pa.float64()), math.nan).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        good = (np.bincount(row, ~np.isfinite(flat), len(size)) == 0) & (np.bincount(row, flat != 0, len(size)) > 0)
        ends = np.cumsum(size)
        raw = [flat[e - n : e].tobytes() for e, n, g in zip(ends, size, good, strict=True) if g]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(raw, pa.binary())], names=["vec_id", "vec"])


def _summed(x: np.ndarray) -> np.ndarray:
    """Sums of rows, from the first component to the last, so that any engine which adds in order gets the same bits."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _unit(raw: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, norms, int8 codes, their scale, and the length of the quantisation error of the unit vector."""
    x = np.frombuffer(b"".join(raw.to_pylist())).reshape(len(raw), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    norm = np.sqrt(_summed(x * x))
    unit = x / norm[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - code * scale[:, None]) ** 2).sum(axis=1)) + 1e-9
    return x, norm, code, scale, error


def _tile(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _HITS.empty_table()
        qid, cid = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        q, q_norm, q_code, q_scale, q_error = _unit(left.column("vec"))
        c, c_norm, c_code, c_scale, c_error = _unit(right.column("vec"))
        # Sums of int8 products stay exact in single precision up to 1040 dimensions; beyond, double precision holds them.
        kind = np.float32 if q.shape[1] <= 1040 else np.float64
        c_code = c_code.astype(kind).T
        out: list[tuple[int, int, float]] = []
        for a in range(0, len(qid), 256):
            z = min(a + 256, len(qid))
            near = (q_code[a:z].astype(kind) @ c_code) * (q_scale[a:z, None] * c_scale[None, :])
            slack = q_error[a:z, None] + (1 + q_error[a:z, None]) * c_error[None, :]
            near[qid[a:z, None] == cid[None, :]] = -np.inf
            low = near - slack
            n = min(k, len(cid))
            least = np.partition(low, len(cid) - n, axis=1)[:, len(cid) - n]
            i, j = np.nonzero((near + slack >= least[:, None]) & (near > -np.inf))
            exact = np.concatenate([_summed(q[a + i[s : s + 16384]] * c[j[s : s + 16384]]) for s in range(0, max(len(i), 1), 16384)])
            exact = exact / (q_norm[a + i] * c_norm[j])
            ends = np.searchsorted(i, np.arange(z - a + 1))
            for row in range(z - a):
                s = slice(ends[row], ends[row + 1])
                best = heapq.nsmallest(k, zip((-exact[s]).tolist(), cid[j[s]].tolist(), strict=True))
                out.extend((int(qid[a + row]), vec, -score) for score, vec in best)
        return pa.Table.from_arrays([pa.array([x[n] for x in out], t) for n, t in enumerate(_HITS.types)], schema=_HITS)

    return lambda key, left, right: run(left, right)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (the cosine) of each query's k nearest."""
    ship(vectors.sparkSession)

    def sound(df: DataFrame, name: str) -> DataFrame:
        kept = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).mapInArrow(_sound, "vec_id long, vec binary")
        return stash(kept.groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("dim", F.octet_length("vec")), name)

    found, asked = sound(vectors, "vectors"), sound(queries, "queries")
    size = lambda df: df.agg(F.sum("dim")).first()[0] or 0
    tiles, blocks = max(LEAST_TILES, math.ceil(size(found) / SIDE_BYTES)), max(1, math.ceil(size(asked) / SIDE_BYTES))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", part(blocks)).withColumn("tile", every(tiles))
    right = found.withColumn("tile", part(tiles)).withColumn("block", every(blocks))
    keys = ["dim", "block", "tile"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
