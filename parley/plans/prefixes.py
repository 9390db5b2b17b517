"""Prompt prefixes as a hash chain: a row a turn instead of a payload that repeats all turns before it.

The digest of a prefix is that of the one before, times a base, plus the hash of its last turn, modulo a prime; two such numbers with bases of
their own, 122 bits, are its 32 hexadecimal digits. The chain begins with the hash of the system prompt. As a run of turns is a factor and a summand, runs are joined in any grouping, and a
conversation of any length is spread over tasks (operators.segments).

A prefix that several conversations share is stored once, by its digest, with the digest before it and its last turn; its payload is
put together on demand from the conversation that has it first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.segments import checkpointed, fold
from parley.plans.prompt import role

#: modulus and bases of the two halves of a digest (fixed values)
PRIME = 2**61 - 1
BASES = (1_000_000_007 * 1_048_583, 998_244_353 * 1_572_869)
CHAIN = "conv_id bigint, pos bigint, author string, n_turns bigint, digest string, parent string"


def halves(sha256: str) -> list[int]:
    """Two numbers under 2^60 from a hexadecimal SHA-256."""
    return [int(sha256[:15], 16), int(sha256[15:30], 16)]


def digits(state: list[int]) -> str:
    return "".join(f"{x:016x}" for x in state)


class Chain:
    """Summaries: turns, then for each half the factor and the summand of a run of turns."""

    def __init__(self, start: str):
        self.start = halves(start)

    def nothing(self) -> list:
        return [0, [1, 0], [1, 0]]

    def add(self, summary: list, run: pa.RecordBatch) -> list:
        n, *both = summary
        for h in run.column("hash").to_pylist():
            both = [[f * b % PRIME, (s * b + x) % PRIME] for (f, s), b, x in zip(both, BASES, halves(h), strict=True)]
        return [n + run.num_rows, *both]

    def join(self, first: list, then: list) -> list:
        return [first[0] + then[0], *([f1 * f2 % PRIME, (s1 * f2 + s2) % PRIME] for (f1, s1), (f2, s2) in zip(first[1:], then[1:], strict=True))]

    def walk(self, before: list, runs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, *both = before
        state = [(x * f + s) % PRIME for x, (f, s) in zip(self.start, both, strict=True)]
        for run in runs:
            digests, parents = [], []
            for h in run.column("hash").to_pylist():
                parents.append(digits(state))
                state = [(x * b + y) % PRIME for x, b, y in zip(state, BASES, halves(h), strict=True)]
                digests.append(digits(state))
            turns = pa.array(range(n + 1, n + 1 + run.num_rows), pa.int64())
            n += run.num_rows
            yield pa.RecordBatch.from_arrays([*(run.column(c) for c in ("conv_id", "pos", "author")), turns, pa.array(digests), pa.array(parents)], [c.split()[0] for c in CHAIN.split(", ")])


def chain(messages: DataFrame, system: str) -> DataFrame:
    """CHAIN: of each message the digest of the prefix that ends with it and of the one before; a checkpointed table."""
    import hashlib

    turn = F.sha2(F.concat_ws("\n", role(), "text").cast("binary"), 256)
    rows = messages.select("conv_id", "pos", "author", turn.alias("hash"))
    return checkpointed(fold(rows, "conv_id", ["pos"], Chain(hashlib.sha256(system.encode()).hexdigest()), CHAIN))


def shared(links: DataFrame) -> DataFrame:
    """A row for each distinct prefix: digest, parent, n_turns, n_convs, and the conversation and place that have it first."""
    first = F.min(F.struct("conv_id", "pos"))
    stored = links.groupBy("digest").agg(F.first("parent").alias("parent"), F.first("n_turns").alias("n_turns"), F.count(F.lit(1)).alias("n_convs"), first.alias("at"))
    return stored.select("digest", "parent", "n_turns", "n_convs", F.col("at.conv_id").alias("conv_id"), F.col("at.pos").alias("pos"))


def store(messages: DataFrame, links: DataFrame) -> DataFrame:
    """The distinct prefixes with their last turns: digest, parent, n_turns, role, content. Each text stands once for all that share its prefix."""
    kept = shared(links).select("digest", "parent", "n_turns", "conv_id", "pos")
    return kept.join(messages.select("conv_id", "pos", role().alias("role"), F.col("text").alias("content")), ["conv_id", "pos"]).select("digest", "parent", "n_turns", "role", "content")


def payloads(messages: DataFrame, links: DataFrame, wanted: DataFrame, model: str, system: str) -> DataFrame:
    """digest and payload of each distinct digest in wanted: the system prompt and the turns up to the prefix's end, from the conversation that has
    it first. A payload is as long as its prefix; each wanted one is made once, however many conversations share it."""
    ends = shared(links).join(wanted.select("digest").distinct(), "digest", "left_semi").select("digest", "conv_id", F.col("pos").alias("end"))
    turns = messages.select("conv_id", F.struct("pos", F.struct(role().alias("role"), F.col("text").alias("content")).alias("m")).alias("row"), "pos")
    rows = ends.join(turns, "conv_id").where("pos <= end").groupBy("digest").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    request = F.struct(F.lit(model).alias("model"), F.concat(first, F.col("rows.m")).alias("messages"), F.lit(False).alias("stream"))
    return rows.select("digest", F.to_json(request).alias("payload"))
