"""Near-duplicate vectors by cross-polytope hashing.

A table hashes a vector by a few fast pseudo-random rotations (three rounds of random signs and a
Hadamard transform); each gives the signed axis nearest to the rotated vector, and these axes together name
the bucket. Multiprobe: a vector also stands in the buckets with one axis replaced by its second
nearest. Vectors that share a bucket, one of them with its first choice, are compared in double
precision. A pair can meet in several buckets: it counts in the first table (there in the smaller bucket)
where it meets, told from both vectors' bucket lists, so pairs need not be listed to be counted once.
What leaves a bucket is a link count for each vector and a forest of the links.

How full buckets are must not follow the table's size: the number of rotations grows with the number of vectors, so
that a vector meets some 5 others at most that aren't near it, and the number of tables with the rotations and the width,
so that the recall stays (see plan()). Buckets are first counted by id alone; vectors are sent only to those where two meet.

Recall depends on the cosine, not on the data's size; tests/llm measures it against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.buckets import compare_buckets, ranges
from parley.llm.common import staged, table, with_columns
from parley.llm.components import connected_components

NONE = np.int64(2**63 - 1)
MOST_TABLES = 63
#: rows of a small bucket, of which many are compared at once
TOGETHER = 16


class Plan(NamedTuple):
    rotations: int
    tables: int

    @property
    def probes(self) -> int:
        """Buckets of a vector in each table: its first choice, and one for each axis that is replaced."""
        return self.rotations + 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        pair = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def wide(d: int) -> int:
    """The power of two that vectors of width d are padded to: 16 at least, as in fewer dimensions signs and
    Hadamard transforms give few different rotations."""
    return 1 << max(4, (d - 1).bit_length())


def nearest_axes(x: np.ndarray, rotations: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and rotation the nearest signed axis and the second nearest."""
    n, d = x.shape
    padded = np.zeros((n, wide(d)))
    padded[:, :d] = x
    first, second = np.empty((n, rotations), np.int64), np.empty((n, rotations), np.int64)
    every = np.arange(n)
    for r in range(rotations):
        y = padded
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], padded.shape[1]))
        size = np.abs(y)
        for out in (first, second):
            best = size.argmax(axis=1)
            out[:, r] = 2 * best + (y[every, best] < 0)
            size[every, best] = -1
    return first, second


@lru_cache(maxsize=256)
def plan(n: int, d: int, cosine: float = 0.95, recall: float = 0.98, strangers: float = 5, seed: int = 11) -> Plan:
    """Rotations and tables for n vectors of width d.

    The chance that a pair at exactly that cosine meets in one table is taken from 1000 such pairs, drawn with
    a fixed seed; so many tables are taken that the pair is found with the chance `recall` (at the most 63). Rotations: the
    fewest with which a vector meets at most about `strangers` others that point anywhere.
    Under width 16 tables are no independent draws, and more rotations lose pairs that tables can't make up for: there the
    tables are those with which so many of 600 pairs are found in truth, and rotations the most that reach that."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2, 1000, d))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.sqrt(np.maximum((y * y).sum(axis=1), 1e-300))[:, None]
    pair = x, cosine * x + np.sqrt(1 - cosine**2) * y
    if d < 16:
        return _plan_of_few_dimensions(n, (pair[0][:600], pair[1][:600]), recall, strangers, seed)
    (a, a2), (b, b2) = (nearest_axes(v, 5, np.random.default_rng(2)) for v in pair)
    for k in range(2, 6):
        equal, other = a[:, :k] == b[:, :k], (a2[:, :k] == b[:, :k]) | (a[:, :k] == b2[:, :k])
        misses = k - equal.sum(axis=1)
        chance = ((misses == 0) | ((misses == 1) & (~equal & other).any(axis=1))).mean()
        tables = min(MOST_TABLES, 1 if chance > recall else int(np.ceil(np.log(1 - recall) / np.log(1 - max(chance, 0.01)))))
        if tables * (k + 1) * n <= strangers * float(2 * wide(d)) ** k:
            break
    return Plan(k, tables)


def _plan_of_few_dimensions(n: int, pair: tuple[np.ndarray, np.ndarray], recall: float, strangers: float, seed: int) -> Plan:
    best = Plan(1, MOST_TABLES)
    for k in range(1, 6):
        a, b = (cross_polytope(v, Plan(k, MOST_TABLES), seed) for v in pair)
        met = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
        found = np.logical_or.accumulate(met, axis=1).mean(axis=0)
        if found[-1] < recall:
            break
        best = Plan(k, int(np.argmax(found >= recall)) + 1)
        # of vectors that point anywhere those that share a bucket by chance
        if n * (a[:-1, : best.tables, :1] == b[1:, : best.tables]).any(axis=(1, 2)).mean() <= strangers:
            break
    return best


def cross_polytope(x: np.ndarray, how: Plan, seed: int) -> np.ndarray:
    """Of each row the buckets, by table: first choice, first axis replaced, second axis replaced and so on."""
    n, d = x.shape
    rng = np.random.default_rng(seed)
    out = np.empty((n, how.tables, how.probes), np.int64)
    base = 2 * wide(d)
    weight = base ** np.arange(how.rotations, dtype=np.int64)
    for t in range(how.tables):
        first, second = nearest_axes(x, how.rotations, rng)
        code = first @ weight
        out[:, t, 0] = code
        out[:, t, 1:] = code[:, None] + (second - first) * weight
        out[:, t] = out[:, t] * (MOST_TABLES + 1) + t
    return out


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles with a largest component of one: neither very large nor very small ones lose their squares."""
    x = x.astype(np.float64)
    return x / np.abs(x).max(axis=1)[:, None]


def coded(n: int, cosine: float, recall: float, seed: int):
    """Adds codes (the buckets that a vector stands in) and probes (how many of them in each table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                own = batch.take(pa.array(np.flatnonzero(sizes == d)))
                how = plan(n, d, cosine, recall, seed=seed)
                x = scaled(matrix(own.column("embedding"), own.num_rows))
                buckets = np.concatenate([cross_polytope(x[at : at + 2000], how, seed) for at in range(0, len(x), 2000)])
                codes = pa.FixedSizeListArray.from_arrays(pa.array(buckets.reshape(-1)), how.tables * how.probes).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, codes, pa.array(np.full(own.num_rows, how.probes, np.int32))], [*own.schema.names, "codes", "probes"])

    return run


def linked(cosine: float):
    def compare(bucket: pa.RecordBatch, side: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        # vectors of another width may have come to a bucket of the same number
        sizes = bucket.column("embedding").value_lengths().to_numpy()
        for d in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == d)
            whole = len(own) == len(sizes)
            yield from of_one_width(bucket if whole else bucket.take(pa.array(own)), side if side is None or whole else side[own])

    def candidates(x: np.ndarray, here: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of a first choice and of another row of its bucket with at least that cosine."""
        begin = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
        size = np.diff(np.append(begin, len(x)))
        if len(begin) == 1:
            for at in range(0, len(x), 200):
                h = np.flatnonzero(home[at : at + 200]) + at
                i, j = np.nonzero(x[h] @ x.T >= cosine)
                yield h[i], j
            return
        for at in range(0, len(x), 5000):  # many small buckets: of each row the pairs with its bucket's rows
            own = np.flatnonzero(home[at : at + 5000]) + at
            which = np.searchsorted(begin, own, side="right") - 1
            i, j = np.repeat(own, size[which]), ranges(begin[which], size[which])
            near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            yield i[near], j[near]

    def of_one_width(bucket: pa.RecordBatch, side: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        home = bucket.column("home").to_numpy(zero_copy_only=False)
        n = bucket.num_rows
        if n < 2 or not home.any():
            return
        x = scaled(matrix(bucket.column("embedding"), n))
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        codes = matrix(bucket.column("codes"), n).reshape(n, -1, bucket.column("probes")[0].as_py())
        here = bucket.column("bucket").to_numpy()
        copies, rep = bucket.column("copies").to_numpy(), bucket.column("rep").to_numpy()
        links, root = np.zeros(n, np.int64), np.arange(n)
        for i, j in candidates(x, here, home):
            keep = (i != j) & (~home[j] | (i < j))
            if side is not None and side.any():
                keep &= side[i] != side[j]
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            # i's first choice among j's buckets, and the other way round, in each table; only the first table of these counts
            ij = (codes[i, :, :1] == codes[j]).any(axis=2)
            ji = (codes[j, :, :1] == codes[i]).any(axis=2)
            t, every = (ij | ji).argmax(axis=1), np.arange(len(i))
            first = np.minimum(np.where(ij[every, t], codes[i, t, 0], NONE), np.where(ji[every, t], codes[j, t, 0], NONE))
            keep = first == here[i]
            i, j = i[keep], j[keep]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            while len(i):
                a, b = root[i], root[j]
                if (a == b).all():
                    break
                low = np.minimum(a, b)
                np.minimum.at(root, a, low)
                np.minimum.at(root, b, low)
                while not (root[root] == root).all():
                    root = root[root]
        own = np.flatnonzero(links)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[root[own]]), pa.array(links[own])], ["a", "b", "n"])

    return compare


def near_vectors(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.98, seed: int = 11, block: int = 1000, expected: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id: bigint, embedding: array of float or double).

    Equal vectors are one class from the start and all linked. Vectors that are null, empty, zero, or hold
    null or non-finite components link with nothing, nor do vectors of different lengths. A class whose ids are
    all null is compared with no other. Repeated rows count as other vectors; other columns are ignored; an empty table gives an empty one.
    recall: the share of pairs at exactly that cosine to be found. expected: the number of vectors to plan for, if not that of the table."""
    every = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.coalesce((F.size("embedding") > 0) & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    classes = every.where(fine).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = staged(classes, "vector-classes")
    held = classes.where("rep is not null")
    held = staged(held.mapInArrow(coded(expected or held.count(), cosine, recall, seed), with_columns(held, "codes array<bigint>, probes int")), "vector-codes")
    rows = held.select("rep", "probes", F.posexplode("codes").alias("at", "bucket")).select("bucket", "rep", (F.col("at") % F.col("probes") == 0).alias("home"))
    live = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.max("home").alias("homes")).where("count > 1 and homes").drop("homes")
    live = staged(live, "live-buckets")
    placed = rows.join(live.select("bucket"), "bucket").join(held, "rep").select("bucket", "home", *held.columns)
    met = staged(compare_buckets(placed, "bucket", "rep", block, linked(cosine), "a bigint, b bigint, n bigint", live, together=TOGETHER), "vector-links")
    links = met.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    joined = connected_components(met.select("a", "b")).withColumnRenamed("node", "rep")
    known = classes.join(links, "rep", "left").join(joined, "rep", "left")
    known = staged(known.select("embedding", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-components")
    out = every.join(known, "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
