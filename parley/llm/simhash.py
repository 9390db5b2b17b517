"""SimHash near-dedup by anchor-point covering.

The 64 fingerprint bits are m blocks, and anchors are made for every choice of k of them. Two fingerprints with
at most 4 differing bits agree on m - 4 blocks at least, and differ in at most e = floor(4 k / m) bits of some k blocks
together: that (0 where k <= m - 4) is the threshold left there. The anchors of k joined blocks are the words of a covering code: the perfect Hamming code on their lowest 15
bits, every value of the others. Its covering radius is 1, so a fingerprint's nearest anchor (its home) is at most
1 bit away, and at most 1 + e bits from any fingerprint that differs by e bits. Replicated to all anchors
within 1 + e bits, a fingerprint meets the home rows of all its partners; rows of an anchor are compared in full.

How many rows an anchor has grows with the table if the anchors don't, so m and k follow the number of distinct
fingerprints (see plan_for): up to some 200,000 three single blocks of 21 bits with e = 1 (45 replicas), then 2 of 6,
3 of 7, 4 of 8 blocks and so on, where e is 0 and the home is the only anchor within 1 bit. Each plan finds every
link: it changes what is compared, not what is found.

Equal fingerprints are one row from the start. What an anchor gives out is a spanning forest of its
links, not all pairs; components are joined over these edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from parley.llm.buckets import compare_buckets, grouped
from parley.llm.common import slices, staged, table, texts, tidy, with_columns
from parley.llm.components import connected_components

#: the most differing bits of a link
BITS = 4


class Plan(NamedTuple):
    """Anchors for every choice of `joined` of the 64 bits' `blocks`."""

    blocks: int
    joined: int

    @property
    def budget(self) -> int:
        return 0 if self.joined <= self.blocks - BITS else BITS * self.joined // self.blocks

    @property
    def replicas(self) -> float:
        """Anchors of a fingerprint, on average."""
        free = 64 * self.joined / self.blocks - 15
        within = 15 / 16 * (8 + free) + (1 + free + free * (free - 1) / 2) / 16 if self.budget else 1
        return comb(self.blocks, self.joined) * within

    def compared(self, n: int) -> float:
        """How many of n random fingerprints one is compared with."""
        return self.replicas * n / 2 ** (64 * self.joined / self.blocks - 4)


PLANS = [Plan(3, 1), *(Plan(m, m - BITS) for m in range(6, 13))]


def plan_for(n: int, most: float = 50) -> Plan:
    """The plan with the fewest blocks that compares a fingerprint with at most about `most` others of n random ones."""
    return next((p for p in PLANS if p.compared(n) <= most), PLANS[-1])


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """A bit is set where over half the shingles' XXH64 have it; without words 0.

    bytes.lower() changes A-Z alone and bytes.split() cuts at space and 0x09-0x0D alone."""
    own = text.encode().lower().split()
    if not own:
        return 0
    k = min(words, len(own))
    joined = b" ".join(own)
    length = np.fromiter(map(len, own), np.int64, len(own))
    end = np.cumsum(length + 1) - 1
    begin = (end - length)[: len(own) - k + 1].tolist()
    end = end[k - 1 :].tolist()
    count, n = np.zeros(64, np.int64), len(begin)
    for at in range(0, n, 32_640):
        part = zip(begin[at : at + 32_640], end[at : at + 32_640], strict=True)
        hashes = np.frombuffer(b"".join([xxh64_digest(joined[a:b], seed) for a, b in part]), np.uint8).reshape(-1, 8)
        lanes = np.unpackbits(hashes, axis=1).view(np.uint64)  # eight bits' counts to a word
        for i in range(0, len(lanes), 255):
            count += lanes[i : i + 255].sum(axis=0).view(np.uint8)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def fingerprinted(rows: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """rows with fp (the fingerprint's bits as a signed bigint) in place of text, which isn't null."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = np.array([fingerprint(t, words, seed) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(fp.view(np.int64))], [*names, "fp"])

    return rows.mapInArrow(tidy(run), with_columns(rows.select(names), "fp bigint"))


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp of every row."""
    return fingerprinted(texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")), words, seed)


def _hamming() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each 15-bit word its syndrome; of each syndrome the one flip, and the seven double flips, that reach a code word."""
    words = np.arange(1 << 15)
    syndrome = np.zeros(1 << 15, np.int64)
    for bit in range(15):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    single = np.array([0] + [1 << (s - 1) for s in range(1, 16)])
    double = np.array([[0] * 7] + [[1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 16) if i != s and i < i ^ s] for s in range(1, 16)])
    return syndrome, single, double


SYNDROME, SINGLE, DOUBLE = _hamming()


def anchors(fp: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of each fingerprint: (anchor, place in fp, whether it is the fingerprint's home)."""
    out: list[tuple[np.ndarray, np.ndarray, bool]] = []
    every = np.arange(len(fp))
    borders = [64 * i // plan.blocks for i in range(plan.blocks + 1)]
    blocks = [fp.view(np.uint64) >> np.uint64(a) & np.uint64((1 << b - a) - 1) for a, b in zip(borders, borders[1:], strict=False)]
    for choice, own in enumerate(combinations(range(plan.blocks), plan.joined)):
        value, bits = np.zeros(len(fp), np.uint64), 0
        for i in own:
            value |= blocks[i] << np.uint64(bits)
            bits += borders[i + 1] - borders[i]
        word, free = (value & np.uint64(0x7FFF)).astype(np.int64), (value >> np.uint64(15)).astype(np.int64)
        syndrome = SYNDROME[word]
        home = word ^ SINGLE[syndrome]
        key = lambda w, f, choice=choice: choice << 44 | f << 15 | w
        out.append((key(home, free), every, True))
        if not plan.budget:
            continue
        off = np.flatnonzero(syndrome)
        for j in range(7):
            out.append((key(word[off] ^ DOUBLE[syndrome[off], j], free[off]), off, False))
        on = np.flatnonzero(syndrome == 0)
        for i in range(bits - 15):
            out.append((key(home, free ^ 1 << i), every, False))
            for j in range(i):
                out.append((key(home[on], free[on] ^ (1 << i | 1 << j)), on, False))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), np.concatenate([np.full(len(x[1]), x[2]) for x in out])


def replicate(plan: Plan):
    """A row for each anchor of a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                fp = part.column("fp").to_numpy()
                anchor, row, home = anchors(fp, plan)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row]), part.column("rep").take(pa.array(row)), pa.array(home)], ["anchor", "fp", "rep", "home"])

    return run


def forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges (places in fp) of a spanning forest of the links among fp."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(fp))
    while len(left):
        found, left = [int(left[0])], left[1:]
        while found and len(left):
            i = found.pop()
            near = np.bitwise_count(fp[left] ^ fp[i]) <= bits
            new = left[near].tolist()
            out += [(i, j) for j in new]
            found += new
            left = left[~near]
    return out


def linked(bits: int):
    """compare() for compare_buckets: links between home rows and all rows of an anchor."""

    def compare(bucket: pa.RecordBatch, side: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        home = bucket.column("home").to_numpy(zero_copy_only=False)
        h = np.flatnonzero(home)
        if not len(h):
            return
        fp = bucket.column("fp").to_numpy().view(np.uint64)
        a, b = [], []
        for at in range(0, len(h), max(1, 2_000_000 // len(fp))):
            own = h[at : at + max(1, 2_000_000 // len(fp))]
            x, y = np.nonzero(np.bitwise_count(fp[own][:, None] ^ fp[None, :]) <= bits)
            x = own[x]
            keep = fp[x] != fp[y]
            a.append(x[keep])
            b.append(y[keep])
            if sum(map(len, a)) > 8 * len(fp):  # many links: a spanning forest says as much
                edges = forest(fp, bits)
                a, b = [np.array([e[0] for e in edges])], [np.array([e[1] for e in edges])]
                break
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            rep = bucket.column("rep").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    return compare


def components(reps: DataFrame, bits: int, block: int, plan: Plan | None = None) -> DataFrame:
    """node and component of the linked nodes of reps: fp (distinct) and rep, its node."""
    if bits > BITS:
        raise ValueError(f"the anchors cover {BITS} differing bits at most")
    replicas = reps.mapInArrow(tidy(replicate(plan or plan_for(reps.count()))), "anchor bigint, fp bigint, rep bigint, home boolean")
    return connected_components(compare_buckets(replicas, "anchor", "fp", block, linked(bits), "a bigint, b bigint"))


def near_groups(docs: DataFrame, digest: Column, bits: int = BITS, block: int = 20_000) -> DataFrame:
    """doc_id, text_sha256 (digest) and kept of every row that has a near copy or a repeat.

    Here the fingerprints are the nodes, not the ids: null and repeated ids link like any other. Of each group the rows
    with the smallest doc_id are kept, null last, and of these the ones with the smallest digest."""
    rows = docs.select("doc_id", digest.alias("text_sha256"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    each = staged(fingerprinted(rows), "row-fingerprints")
    reps = staged(each.select("fp").distinct().withColumn("rep", F.col("fp")), "fingerprint-reps")
    joined = staged(components(reps, bits, block).withColumnRenamed("node", "fp"), "fingerprint-groups")
    each = each.join(joined, "fp", "left").select("doc_id", "text_sha256", F.coalesce("component", "fp").alias("group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256")
    firsts = each.groupBy("group").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return each.join(staged(firsts, "group-firsts"), "group").select("doc_id", "text_sha256", order.eqNullSafe(F.col("first")).alias("kept"))


def near_duplicates(docs: DataFrame, bits: int = BITS, words: int = 4, seed: int = 42, block: int = 20_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs.

    component_id is the smallest doc_id that links (at most `bits` differing bits, 4 at the most)
    reach, the row itself included; the row with doc_id = component_id stands for its group. Needs
    doc_id and text. Null and empty texts, and those without words, have fingerprint zero and are
    linked like any other. Rows with a null doc_id get the component of their fingerprint (null if no row has an id).
    Repeated rows each get a row; an empty table gives an empty one."""
    each = staged(fingerprints(docs, words, seed), "fingerprints")
    reps = each.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    reps = staged(reps, "fingerprint-reps")
    joined = components(reps, bits, block)
    named = reps.join(joined, reps.rep == joined.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = staged(named, "fingerprint-components")
    out = each.join(named, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
