"""Line dedup, the prefix trie and whitening against brute force."""

import hashlib
import random
import re
import zlib
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from parley.llm import line_dedup, prefix_trie, scans, whitening

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sql_rows(sql, names):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return sorted((tuple(r) for r in db.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()), key=repr)


# --- lines


def lines_by_hand(docs, min_chars=20, min_docs=3):
    key = lambda line: line.strip(WHITE).encode().lower()
    holders = {}
    for doc_id, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k.decode()) >= min_chars:
                holders.setdefault(k, []).append(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(h := holders.get(key(x), [])) < min_docs or max(h, key=lambda i: (i is not None, i or 0)) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


SHARED, WIDE = "a line that many documents share", "ünïcödé-ünïcödé-ünïcödé"
DOCS = [
    (1, SHARED), (2, f"own\n  {SHARED.upper()}\t\r\nown"), (3, f"{SHARED}\n{SHARED}"), (4, None), (5, ""), (6, "\n\n"), (7, "x" * 20), (8, "X" * 20), (9, "x" * 20 + " "), (10, "y" * 19), (11, "y" * 19), (12, "y" * 19),
    (13, WIDE), (14, WIDE), (15, WIDE), (16, WIDE.replace("ü", "Ü")), (17, "é" * 12), (18, "é" * 12), (19, "é" * 12), (20, "\xa0" + SHARED), (21, "once\n" * 5000), (None, SHARED), (None, "of a row without an id\n" * 2), (None, "of a row without an id"), (None, "of a row without an id"),
    (22, "twice, of one id itself"), (22, "twice, of one id itself"), (0, "twice, of one id itself"), (-5, "lines of two only, so they stay"), (-6, "lines of two only, so they stay"), (23, f"{SHARED}\x85"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "k", 1, 1) for i, t in DOCS], "doc_id bigint, text string, h1 bigint, shard string, n_lines int, keep_id int").repartition(3).cache()


@pytest.mark.parametrize("shard_keys, cache", [(1 << 18, 1 << 28), (1, 0), (2, 100)])
def test_lines(docs, shard_keys, cache):
    """One shard and many, with caches that hold all or one of them."""
    assert rows(line_dedup.drop_shared_lines(docs, shard_keys=shard_keys, cache_bytes=cache)) == lines_by_hand(DOCS)
    assert rows(line_dedup.drop_shared_lines(docs, 1, 2, shard_keys, cache)) == lines_by_hand(DOCS, 1, 2)


def test_no_lines(spark, docs):
    assert rows(line_dedup.drop_shared_lines(docs.limit(0))) == []
    assert rows(line_dedup.drop_shared_lines(docs.where("doc_id = 4"))) == [(4, 1, 0, "")]


def test_lines_query(spark):
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    found = rows(line_dedup.query(spark, SF).select(names))
    assert found == sql_rows(line_dedup.SQL, names) and sum(r[2] for r in found) > 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000, 100_000])
def test_perfect_hash(n):
    """Every key has a slot of its own; a built one read back from its bits tells the same."""
    draw = np.random.default_rng(n)
    first, second = draw.integers(0, 2**64, (2, n), dtype=np.uint64)
    if n > 100:
        first[1] = first[0]  # told by the second halves alone
    built = line_dedup.PerfectHash.build(first, second)
    again = line_dedup.PerfectHash(built.words, np.frombuffer(built.bits.tobytes(), "<u8"), built.rest)
    assert sorted(again.slots(first, second).tolist()) == list(range(n))
    assert len(built.rest) <= 2 and (n < 5000 or 64 * sum(built.words) < 4 * n)
    other = draw.integers(0, 2**64, (2, 50), dtype=np.uint64)
    assert (again.slots(*other) < max(n, 1)).all()


# --- running sums and hot keys


def test_running_over_ranges(spark):
    """Groups that spread over many ranges, ranges of many groups, ties."""
    draw = random.Random(1)
    data = [(5, i % 700, draw.randrange(9)) for i in range(3000)] + [(g, 0, draw.randrange(9)) for g in range(6, 60)] + [(-1, i, 1) for i in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(data, "g bigint, o bigint, v bigint").repartition(3)
        found = scans.running(df.selectExpr("*", "monotonically_increasing_id() as salt"), "g", ["o", "v"], "v", "t", ["salt"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, total = [], {}
    for g, o, v in sorted(data):
        total[g] = total.get(g, 0) + v
        want.append((g, o, v, total[g]))
    assert sorted((r["g"], r["o"], r["v"], r["running"]) for r in found) == sorted(want)


def test_looked_up(spark):
    data = spark.createDataFrame([(1 if i < 900 else i, i) for i in range(3000)], "k bigint, v bigint")
    known = data.groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "n").selectExpr("k", "n", "k * 2 as twice").where("k <> 2000")
    assert rows(scans.looked_up(data, known, ["k"], "n", 3000)) == sorted(((k, i, 2 * k) for i in range(3000) for k in [1 if i < 900 else i] if k != 2000), key=repr)


# --- the trie


def trie_by_hand(turns, every=20, most=4):
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    own = {c: [t[2:] for t in sorted(v, key=lambda t: (*t[:3], t[3][:32], digest(*t[2:])))] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h, base = zlib.crc32(str(c).encode()) % most, c - (abs(c) % every) * (1 if c > 0 else -1)
        built[c] = own.get(base, [])[:h] + mine[h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children, leaves, saved = ({k: 0 for k in members} for _ in range(3))
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, held in members.items():
        own_tokens = (len(held) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own_tokens
            leaves[k[:d]] += not children[k]
    out = []
    for k, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(built[c]) == len(k))
        out.append((min(held), len(k), min(members[k[:-1]]) if k else None, len(held), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def random_turns(seed):
    draw = random.Random(seed)
    out = [(None, 1, "user", "x")] * 3
    for c in [*range(-30, 70), 2**40]:
        if draw.random() < 0.8:
            for i in range(draw.choice([1, 1, 2, 3, 5, 11])):
                out.append((c, draw.choice([None, i, i, i]), draw.choice(["user", "assistant", None, ""]), draw.choice(["a b", "hi\x0bho  x", None, "", "w" * 40 + "1", "w" * 40 + "2"])))
    draw.shuffle(out)
    return out


CONVERSATIONS = {
    "random": random_turns(3),
    "none": [],
    "one turn": [(40, 0, "u", "x")],
    "turnless": [(c, 0, "u", "x") for c in range(21, 27)],
    "copies": [(c, i, "u", str(i)) for c in (20, *range(41, 60)) for i in range(5)] + [(c, i, "u", "same") for c in range(100, 110) for i in range(3)],
}


@pytest.mark.parametrize("name", CONVERSATIONS)
def test_trie(spark, name, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_A_ROW", 3)
    data = spark.createDataFrame([(*t, 1, "x") for t in CONVERSATIONS[name]], "conv_id bigint, turn bigint, role string, text string, pos int, words string")
    assert rows(prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(data))).select(NODE)) == trie_by_hand(CONVERSATIONS[name])


def test_trie_query(spark):
    assert rows(prefix_trie.query(spark, SF).select(NODE)) == sql_rows(prefix_trie.SQL, NODE)


# --- whitening


def by_hand(vectors, k=4):
    good = [(i, [float(c) for c in v]) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    x = np.zeros((len(good), width), np.int64)
    for row, (_, v) in zip(x, good, strict=True):
        row[: len(v)] = np.floor(np.array(v) * 256)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return [i for i, _ in good], n, ((n * x - s) ** 2).sum(axis=1).tolist(), (n * x - s) / n @ v, e, np.trace(centred.T @ centred / n)


def check_whitened(spark, vectors, kind, components=4):
    data = spark.createDataFrame([(i, v, 1.5, "y") for i, v in vectors], f"vec_id bigint, embedding array<{kind}>, whitened double, x string").repartition(3)
    how = whitening.fit(data, components)
    ids, n, deviation, projected, e, trace = by_hand(vectors, components)
    there = e > 1e-9
    found = whitening.whitened(data, how).collect()
    assert how.n == n and how.identity_error < 1e-9 and len(found) == len(ids) * there.sum()
    np.testing.assert_allclose(how.eigenvalues, e[there], rtol=1e-12)
    assert sorted(((r["vec_id"], r["component"], r["deviation"]) for r in found), key=repr) == sorted(((i, k + 1, Decimal(d)) for i, d in zip(ids, deviation, strict=True) for k in range(there.sum())), key=repr)
    for r in found:
        assert abs(r["explained"] - e[r["component"] - 1] / trace) < 1e-12
    if len(set(ids)) == len(ids):
        own = np.zeros((len(ids), there.sum()))
        for r in found:
            own[ids.index(r["vec_id"]), r["component"] - 1] = r["whitened"]
        want = projected[:, there] / np.sqrt(e[there])
        np.testing.assert_allclose(own * np.sign((own * want).sum(axis=0)), want, atol=1e-9)


def random_vectors(seed, n=120, width=11):
    draw = np.random.default_rng(seed)
    out = [(i, (draw.normal(size=width) * np.arange(1, width + 1) / 8).astype(np.float32).tolist()) for i in range(n)]
    return out + [(n + i, out[3][1]) for i in range(40)]


@pytest.mark.parametrize("width", [1, 2, 5, 11])
def test_whitening(spark, width):
    check_whitened(spark, random_vectors(width, width=width), "float")


def test_whitening_hard_rows(spark):
    """Nulls, infinities, shorter and empty vectors, repeated ids, a component too few for the rank."""
    bad = [(1000, None), (1001, [1.0, None, 2.0]), (1002, [float("nan")] * 11), (1003, [float("inf")] + [0.0] * 10), (None, [0.5] * 11), (1, [0.25, 0.5]), (1004, []), (1004, [])]
    check_whitened(spark, random_vectors(7) + bad, "double")
    check_whitened(spark, [(i, [i / 4, -i / 2, 1.0]) for i in range(30)], "double")  # rank one


def test_whitening_of_nothing(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.fit(spark.createDataFrame([(1, None)], schema)) is None
    for data in ([], [(1, None)], [(1, [])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]):  # the last: one distinct vector, no variance
        df = spark.createDataFrame(data, schema)
        assert rows(whitening.whitened(df, whitening.fit(df))) == []


def test_whitening_query(spark):
    found = whitening.query(spark, SF).collect()
    data = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, n, deviation, projected, e, trace = by_hand(data)
    assert len(found) == 4 * len(ids) and {r["n"] for r in found} == {n} and {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-12
    assert {(r["vec_id"], r["deviation"]) for r in found} == set(zip(ids, deviation, strict=True))
    np.testing.assert_allclose(sorted({r["explained"] for r in found})[::-1], e / trace, rtol=1e-10)


def matrices():
    draw = np.random.default_rng(0)
    turn, _ = np.linalg.qr(draw.normal(size=(300, 300)))
    yield "decaying", turn * 0.97 ** np.arange(300) @ turn.T, {"largest": 48}
    yield "many equal", turn * np.repeat([5.0, 4, 3, 2, 1, 0.5], 50) @ turn.T, {"largest": 64}
    yield "more equal ones than a block", turn * np.append([5.0] * 12, np.linspace(4.9, 0, 288)) @ turn.T, {"largest": 64}
    yield "identity", np.eye(50), {}
    yield "zero", np.zeros((20, 20)), {}
    low = draw.normal(size=(100, 3))
    yield "low rank", low @ low.T, {}
    for d in (1, 2, 3, 9):
        own = draw.normal(size=(d, d))
        yield f"width {d}", own @ own.T, {}


@pytest.mark.parametrize("name, matrix, options", list(matrices()), ids=lambda x: x if isinstance(x, str) else "")
def test_lanczos(name, matrix, options):
    """Eigenvalues and residuals to rounding, orthonormal vectors; with restarts, breakdowns and repeated eigenvalues."""
    values, vectors = whitening.block_lanczos(lambda q: matrix @ q, len(matrix), 4, **options)
    want = np.linalg.eigvalsh(matrix)[::-1][:4]
    np.testing.assert_allclose(values, want, atol=1e-12 * max(1, want[0]))
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-10 and np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-13


def test_deviations_of_large_numbers():
    """Beyond what 64 bits hold, still exact."""
    x = np.array([[2**40, -(2**41)], [3, 5]], np.int64)
    sums = np.array([2**50, -7], object)
    n = 10**9
    assert whitening.deviations(x, n, sums) == [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
