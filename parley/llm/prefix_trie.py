"""The prefix trie of conversations, by prefix doubling.

Distinct turns get dense names. A block of 2^(k+1) turns, at a multiple of its length, gets a name from the names of its two
halves: a round for each k, over half as many rows as the one before. The prefix of d turns is made of the blocks of d's binary digits: prefixes whose
length has k as its lowest digit are named from the prefix without that digit and the block after it, from high digits to low. Two
prefixes of one length have one name just if they are equal, so a node is a (depth, name).

Each round names pairs: their distinct values are counted (combined before the shuffle), numbered, and joined back, the
hot ones by a broadcast of 1000 rows at most (scans.looked_up). No key stands for a conversation's rows or a node's members as a whole:
turns are numbered and summed along by ranges (scans.running), a node's members are only counted. Sums over subtrees need no walk:
a node belongs to its smallest member, so a subtree's sum is a sum of what its members own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import staged, table
from parley.llm.scans import looked_up, running

WORD = r"[^\x20\x09-\x0D]+"
TURNS = "conv_id bigint, pos bigint, role string, text string"
#: ids of a node's ending members that stand in one row before they are hashed
IDS_A_ROW = 4096


def _turn(role: Column, text: Column) -> list[Column]:
    """What the trie needs of a turn: a digest that tells turns apart, and the words of its text."""
    length = F.length(role).cast("string")
    return [F.unhex(F.sha2(F.concat(length, F.lit(":"), role, text).cast("binary"), 256)).alias("turn"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words")]


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn (digest) and words of every turn of conversations (conv_id, turn, role, text), by turn, null first.
    Null role or text is the empty one; turns of one number stand by role, then by a text's first 32 characters, then by its digest. Rows without conv_id belong to no conversation and are left out."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("number"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where("conv_id is not null").select("conv_id", "number", "role", F.substring("text", 1, 32).alias("head"), *_turn(F.col("role"), F.col("text")))
    rows = rows.withColumns({"one": F.lit(1).cast("bigint"), "salt": F.monotonically_increasing_id()})
    at = running(rows, "conv_id", ["number", "role", "head", "turn"], "one", "numbered-turns", ["salt"])
    return at.select("conv_id", (F.col("running") - 1).alias("pos"), "turn", "words")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Numbered turns in which each conversation c begins with the first h turns of conversation c - c % every (all of them if it has fewer,
    none if it isn't there), h = crc32(decimal c) % most, and goes on with its own turns after its first h; and
    conv_id and n_turns of every conversation, also of those left without a turn."""
    turns = staged(turns, "own-turns")
    conversations = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n_own"))
    c = F.col("conv_id")
    head = F.crc32(c.cast("string").cast("binary")) % most
    # at most most - 1 turns of a conversation
    firsts = turns.where((c % every == 0) & (F.col("pos") < most - 1)).groupBy(c.alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "words"))).alias("firsts"))
    plans = conversations.withColumns({"h": head, "base": c - c % every}).join(firsts, "base", "left")
    plans = plans.withColumn("heads", F.coalesce(F.expr("slice(firsts, 1, cast(h as int))"), F.expr("cast(array() as array<struct<pos: bigint, turn: binary, words: bigint>>)")))
    plans = staged(plans.select("conv_id", "h", "n_own", "heads", F.size("heads").cast("bigint").alias("n_heads")), "rebuilding")
    own = turns.where(F.col("pos") >= head)
    own = looked_up(own, plans.select("conv_id", "n_own", (F.col("n_heads") - F.col("h")).alias("shift")), ["conv_id"], "n_own", turns.count())
    own = own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "turn", "words")
    heads = plans.select("conv_id", F.explode("heads").alias("t")).select("conv_id", "t.pos", "t.turn", "t.words")
    lengths = plans.select("conv_id", (F.col("n_heads") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns"))
    return staged(heads.unionByName(own), "rebuilt-turns"), staged(lengths, "rebuilt-lengths")


def named(rows: DataFrame, keys: list[str], label: str, total: int | None = None) -> DataFrame:
    """rows (a written table) with the keys replaced by name: a dense number, from 0, of their distinct values."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_id", F.monotonically_increasing_id())
    groups = staged(groups, f"{label}-names")  # once written, a name doesn't change with a task that runs again
    part = F.shiftright("_id", 33)
    counts = groups.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each part
    starts, at = [], 0
    for r in counts:
        starts.append((r["part"], at))
        at += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    dense = groups.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*keys, "_n", (F.col("_start") + F.col("_id") - F.shiftleft("_part", 33)).alias("name"))
    return looked_up(rows, dense, keys, "_n", total or rows.count()).drop(*keys)


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """conv_id, depth (from 1) and name of every prefix of every conversation of turns (a written table: conv_id, pos, turn)."""
    blocks = [staged(named(turns.select("conv_id", "pos", "turn"), ["turn"], "turn").select("conv_id", F.col("pos").alias("j"), "name"), "blocks")]
    while 2 ** len(blocks) <= longest:
        half = F.col("j") % 2 == 0
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(F.max(F.when(half, F.col("name"))).alias("a"), F.max(F.when(~half, F.col("name"))).alias("b"))
        pairs = staged(pairs.where("a is not null and b is not null"), "block-pairs")
        blocks.append(staged(named(pairs, ["a", "b"], "block"), "blocks"))
    found: list[DataFrame] = []
    for k in range(len(blocks) - 1, -1, -1):
        size, own = 2**k, blocks[k].where("j % 2 = 0")
        first = own.where("j = 0").select("conv_id", F.lit(size).cast("bigint").alias("depth"), "name")
        if found:
            before = _all(found).select("conv_id", F.col("depth").alias("start"), F.col("name").alias("a"))
            after = own.where("j > 0").select("conv_id", (F.col("j") * size).alias("start"), F.col("name").alias("b"))
            pairs = staged(before.join(after, ["conv_id", "start"]), "prefix-pairs")
            more = named(pairs, ["a", "b"], "prefix").select("conv_id", (F.col("start") + size).alias("depth"), "name")
            first = first.unionByName(more)
        found.append(staged(first, "prefixes"))
    return staged(_all(found), "all-prefixes")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _ends(ending: DataFrame) -> DataFrame:
    """depth, name and ends_sha256 of the nodes at which conversations (conv_id, depth, name) end. Their ids are joined to long strings
    by ranges first, so that the task that hashes a node's reads a row for 4096 of them; it holds no more than one."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        ids: list[int] = []
        out: list[tuple] = []

        def close() -> None:
            if ids:
                out.append((*held, ids[0], ",".join(map(str, ids))))
                ids.clear()

        for batch in batches:
            for depth, name, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "name", "conv_id")), strict=True):
                if (depth, name) != held or len(ids) == IDS_A_ROW:
                    close()
                    held = depth, name
                ids.append(conv)
            yield rows(out, ["depth", "name", "first", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])
            out.clear()
        close()
        yield rows(out, ["depth", "name", "first", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, out = None, None, []
        for batch in batches:
            for depth, name, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "name", "ids")), strict=True):
                if (depth, name) == held:
                    digest.update(b",")
                else:
                    if held:
                        out.append((*held, digest.hexdigest()))
                    held, digest = (depth, name), hashlib.sha256()
                digest.update(ids.encode())
        if held:
            out.append((*held, digest.hexdigest()))
        yield rows(out, ["depth", "name", "ends_sha256"], [pa.int64(), pa.int64(), pa.string()])

    def rows(out: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    by_id = ending.repartitionByRange("depth", "name", "conv_id").sortWithinPartitions("depth", "name", "conv_id")
    joined = staged(by_id.mapInArrow(strings, "depth bigint, name bigint, first bigint, ids string"), "ending-ids")
    return joined.repartition("depth", "name").sortWithinPartitions("depth", "name", "first").mapInArrow(digests, "depth bigint, name bigint, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node of the trie of conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    turns: conv_id, pos (0, 1, ...), turn (binary: equal just for equal turns) and words; lengths: conv_id and n_turns of every conversation, each once.
    A conversation is a member of all its prefixes' nodes, of the root (depth 0) in any case; no conversation, no node. saved_tokens sums
    (n_convs - 1) x words of the last turn over a node's subtree; ends_sha256 is of the ascending, comma-joined ids of the members that end at the node."""
    spark = turns.sparkSession
    turns, lengths = staged(turns.select("conv_id", "pos", "turn", "words"), "trie-turns"), staged(lengths.select("conv_id", "n_turns"), "trie-lengths")
    n_convs, smallest, longest = lengths.agg(F.count(F.lit(1)), F.min("conv_id"), F.max("n_turns")).first()
    if not n_convs:
        return spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    held = prefixes(turns, longest)
    node = ["depth", "name"]
    nodes = staged(held.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")), "nodes")
    # of each node the words of its last turn, and its parent: both by its smallest member's row
    above = held.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    last = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "words")
    nodes = nodes.join(last, ["conv_id", "depth"]).join(above, ["conv_id", "depth"], "left")
    nodes = staged(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words")).drop("words"), "nodes-and-parents")
    kids = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(nodes.join(kids, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes-and-children")
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), "n_children", F.col("conv_id").alias("parent_conv_id"))
    top = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(smallest).cast("bigint"))
    lower = looked_up(nodes.where("depth > 1"), parents, ["depth", "parent"], "n_children", nodes.count())
    nodes = top.unionByName(lower.select(*top.columns)).drop("parent")
    # what a node's smallest member owns from there down, and in all; a member that is no node's smallest owns nothing
    down = running(nodes.withColumn("up", -F.col("depth")), "conv_id", ["up"], "own", "owned-below")
    owned = down.groupBy("conv_id").agg(F.max("running").alias("total"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("bigint").alias("leaf"))
    owned = staged(owned.join(lengths, "conv_id"), "owned")
    sums = looked_up(held, owned, ["conv_id"], "n_turns", held.count()).groupBy(*node).agg(F.sum("total").alias("total"), F.sum("leaf").alias("n_leaves"))
    found = down.join(sums, node).join(owned.select("conv_id", F.col("total").alias("all")), "conv_id")
    found = found.withColumn("saved_tokens", F.col("total") - F.col("all") + F.col("running"))
    ending = lengths.withColumnRenamed("n_turns", "depth").where("depth > 0").join(held, ["conv_id", "depth"])
    found = found.join(_ends(ending), node, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    # the root: sums over the nodes below it
    root = nodes.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"), F.coalesce(F.sum("own"), F.lit(0)).alias("saved_tokens"))
    none = F.lit(0).cast("bigint")
    turnless = _ends(lengths.where("n_turns = 0").select("conv_id", none.alias("depth"), none.alias("name"))).first()
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves"))
    root = root.select(
        F.lit(smallest).cast("bigint").alias("conv_id"), none.alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(n_convs).cast("bigint").alias("n_convs"),
        "n_children", leaves.cast("bigint").alias("n_leaves"), "saved_tokens", F.lit(turnless and turnless["ends_sha256"]).cast("string").alias("ends_sha256"),
    )
    return found.unionByName(root).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(numbered(table(spark, sf_dir, "conversations"))))


_CRC = """list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"""
SQL = f"""
WITH o AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, xor({_CRC}, 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, b.pos, b.role, b.text FROM c JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20 AND b.pos < c.h UNION ALL SELECT c.conv_id, o.pos + 10, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h),
p AS MATERIALIZED (SELECT conv_id, row_number() OVER w AS depth, text, list(struct_pack(role := role, text := text)) OVER (w ROWS UNBOUNDED PRECEDING) AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
q AS (SELECT c.conv_id, coalesce(n, 0) AS n FROM c LEFT JOIN (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id) USING (conv_id)),
a AS MATERIALIZED (SELECT conv_id, depth, text, sha256(key::VARCHAR || depth) AS key FROM p UNION ALL SELECT conv_id, 0, '', 'root' FROM c),
n AS MATERIALIZED (SELECT key, depth, min(a.conv_id) AS conv_id, count(*) AS n_convs, any_value(text) AS text, sha256(coalesce(string_agg(a.conv_id::VARCHAR, ',' ORDER BY a.conv_id) FILTER (q.n = depth), '')) AS ends_sha256 FROM a JOIN q USING (conv_id) GROUP BY key, depth),
u AS (SELECT n.*, up.key AS parent, up_n.conv_id AS parent_conv_id FROM n LEFT JOIN a up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1 LEFT JOIN n up_n ON up_n.key = up.key),
k AS (SELECT parent AS key, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY parent),
v AS (SELECT u.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS own FROM u LEFT JOIN k USING (key)),
s AS (SELECT a.key, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM v JOIN a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.key)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM v JOIN s USING (key)
"""
