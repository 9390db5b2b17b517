"""Each stage of the pipeline, and the whole run, against brute force: on the smallest tables with hard rows among them."""

import json
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import language_id, toxicity
from parley.llm.chunks import load_tokenizer
from parley.llm.ngrams import MIX, STEP

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"wörd{i % 97} and then {i % 89} more" for i in range(1500))
#: null and empty texts, null and repeated ids with equal and with other texts, ties, a very long text, nothing but signs
HARD = [
    (None, "A null id, and a text of its own.", "en"), (None, "a NULL id, and a text of its own.", None), (None, None, None), (None, "", "en"), (5000, None, "en"), (5001, "", None), (5002, " \n\t ", "de"), (5003, "123 ... !!", "en"),
    (5004, "One id with two texts: this is the first of them.", "en"), (5004, "One id with two texts: here is quite another one.", "en"), (5004, "One id with two texts: this is the first of them.", "en"),
    (5005, "ONE id with two texts: this is the first of them.", "en"), (5006, LONG, "en"), (5007, LONG + " end", "en"), (5008, LONG.upper(), "en"), (5009, "You worthless pathetic idiot, what trash you are, you stupid moron.", "en"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables: the smallest documents and the hard rows, the labels that these have."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hard = spark.createDataFrame([(i, t, lang, "hard", len(t or "")) for i, t, lang in HARD], docs.schema)
    path = str(tmp_path_factory.mktemp("tables"))
    docs.unionByName(hard).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.createDataFrame([(5004, 1, 0), (5004, 1, None), (None, 1, 1), (5009, 0, 1)], "doc_id bigint, quality int, toxic int")).write.parquet(f"{path}/labels.parquet")
    return path


def plain_buckets(text, sizes, bits, letters):
    """Hash buckets of a text's byte n-grams, one after the other."""
    keep = str.isalpha if letters else str.isalnum
    data = " ".join(["", "".join(c if ord(c) >= 128 or keep(c) else " " for c in text.lower()), ""]).encode()
    step, mix, word, out = int(STEP), int(MIX), 2**32, []
    for n in sizes:
        for i in range(len(data) - n + 1):
            h = 0
            for c in data[i : i + n]:
                h = (h * step + c) % word
            out.append((h * mix + n) * mix % word >> 32 - bits)
    return out


def toxic_score(text, model):
    weights, bias = model
    return 1 / (1 + math.exp(-bias - sum(float(weights[b]) for b in set(plain_buckets(text or "", range(4, 9), 20, False)))))


def language(text, model):
    """Language, score and whether it is accepted, of a text with a letter."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, False
    b = plain_buckets(text, range(2, 5), 15, True)
    mean = [sum(float(model.logits[x, k]) for x in b) / len(b) + model.bias[k] for k in range(len(model.languages))]
    e = [math.exp((z - max(mean)) / model.temperature) for z in mean]
    k = max(range(len(e)), key=e.__getitem__)
    return model.languages[k], e[k] / sum(e), e[k] / sum(e) >= model.reject_below


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def without_toxic(rows, model):
    return [r for r in rows if toxic_score(r["text"], model) < 0.3]


def with_language(rows, model):
    return [r for r in rows if language(r["text"], model)[2]]


def without_copies(rows):
    """Of equal texts the row with the largest id, ids before none; of rows that are equal in both, the first by its other columns."""
    best = {}
    for r in sorted(rows, key=lambda r: (json.dumps({c: v for c, v in r.asDict().items() if c != "text"}, separators=(",", ":"), ensure_ascii=False), r["text"] or "")):
        t = lower(r["text"])
        if t not in best or (r["doc_id"] is not None, r["doc_id"] or 0) > (best[t]["doc_id"] is not None, best[t]["doc_id"] or 0):
            best[t] = r
    return list(best.values())


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def near_groups(rows):
    """Which group each row is in: fingerprints with 4 differing bits or fewer are linked."""
    fp = [fingerprint(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 4 and group[a] != group[b]:
                old = group[a]
                group = [group[b] if g == old else g for g in group]
    return group


def key(r):
    return r["doc_id"], lower(r["text"])


def held(rows):
    return Counter(map(key, rows))


def pieces(rows):
    """(doc_id, piece, start, length, crc) of all rows."""
    library, out = load_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in rows:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) - (-(-len(ids) // 2048) - 1) * 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        out.update((r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    return out


def packed(rows):
    """The pieces, after a look at their places: gapless, and no sequence over 2048."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    return Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    toxic, lang = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet")), language_id.learn(docs)
    kept = corpus_pipeline.drop_toxic(spark, docs, folder).collect()
    assert held(kept) == held(without_toxic(rows, toxic)) and 0 < len(kept) < len(rows)
    kept = corpus_pipeline.drop_unidentified(spark, docs, folder).collect()
    assert held(kept) == held(with_language(rows, lang)) and 0 < len(kept) < len(rows)
    kept = corpus_pipeline.drop_copies(spark, docs, folder).collect()
    assert held(kept) == held(without_copies(rows))
    near = corpus_pipeline.drop_near_copies(spark, docs, folder).collect()
    group = dict(zip(map(key, rows), near_groups(rows), strict=True))
    # one row of each group: the one with the smallest id, ids before none
    assert sorted(group[key(r)] for r in near) == sorted(set(group.values()))
    for r in near:
        ids = [x["doc_id"] for x in rows if group[key(x)] == group[key(r)] and x["doc_id"] is not None]
        assert r["doc_id"] == min(ids, default=None)
    assert packed(corpus_pipeline.pack(spark, docs, folder).collect()) == pieces(rows)


def test_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = without_toxic(docs.collect(), toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    left = spark.createDataFrame(rows, docs.schema)
    rows = without_copies(with_language(rows, language_id.learn(left)))
    first = {}
    for r, g in zip(rows, near_groups(rows), strict=True):
        if g not in first or (r["doc_id"] is None, r["doc_id"] or 0) < (first[g]["doc_id"] is None, first[g]["doc_id"] or 0):
            first[g] = r
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert packed(out.collect()) == pieces(first.values())


def test_stages_of_nothing(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == []


def test_scores_equal_a_plain_computation(spark, folder):
    """op2 and op7: every score and prediction, from the fitted model by loops over n-grams."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn(docs, labels)
    plain = Counter((r["doc_id"], round(toxic_score(r["text"], model), 6)) for r in docs.collect())
    found = toxicity.toxic_scores(docs, labels).collect()
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in found) == plain and all(r["predicted"] == (r["score"] >= 0.3) for r in found)
    known = language_id.learn(docs)
    wanted = Counter((r["doc_id"], p, round(s, 5), ok) for r in docs.collect() for p, s, ok in [language(r["text"], known)])
    found = language_id.languages(docs).collect()
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 5), r["accepted"]) for r in found) == wanted
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)


def test_toxic_sample_is_bounded(spark, monkeypatch):
    seen = []
    real = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows: seen.append(rows) or real(rows[:50]))
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2)
    said = [(one, f"one id {i}") for i in range(6000)] + [(None, f"null id {i}") for i in range(3000)] + [(one, "same text")] * 3000
    df = spark.createDataFrame(said, "doc_id bigint, text string").repartition(4)
    toxicity.learn(df, spark.createDataFrame([(one, 1), (one, 0), (None, 1)], "doc_id bigint, toxic int"), max_rows=400)
    assert 100 < len(seen[-1]) < 800 and all(label == 1 and "null" not in text for text, label in seen[-1]) and sum(t == "same text" for t, _ in seen[-1]) <= 1


def test_copies_with_null_and_repeated_ids(spark):
    far = ["alpha beta gamma delta epsilon", "one two three four five six seven", "red green blue black white grey pink"]
    said = [(5, "A", 1), (6, "A", 2), (5, "B", 3), (None, "b", 4), (None, "C", 5), (None, "c", 6), (None, "D", 7), (7, "E", 8), (7, "e", 9), (7, "E", 8), (8, None, 10), (None, "", 11)]
    docs = spark.createDataFrame(said, "doc_id bigint, text string, sha256 int").repartition(3)
    kept = corpus_pipeline.drop_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()), key=repr) == sorted([(6, "a"), (5, "b"), (None, "c"), (None, "d"), (7, "e"), (8, "")], key=repr)
    # near copies (of fingerprint, case apart): a null id goes before an id, an id keeps its other texts
    said = [(5, far[0]), (3, far[0].upper()), (5, far[1]), (None, far[1]), (None, far[2]), (None, far[2].title()), (5, far[1])]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(said, "doc_id bigint, text string").repartition(3), SF)
    assert sorted(((r["doc_id"], r["text"].lower()) for r in kept.collect()), key=repr) == sorted([(3, far[0]), (5, far[1]), (None, far[2])], key=repr)


def test_nothing_learned(spark, tmp_path):
    said = [(i, f"some clean words {i}", None) for i in range(8)] + [(None, "no id", None), (8, "", None), (9, None, None), (10, "12 !", None)]
    docs = spark.createDataFrame(said, "doc_id bigint, text string, lang string")
    apart = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    for case, labels in enumerate(([], [(1000, 0, 1)], [(apart, 0, 1)], [(0, 0, 1), (1, 0, 1)])):
        table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
        table.write.parquet(f"{tmp_path}/{case}/labels.parquet")
        assert sorted(map(tuple, corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/{case}").collect()), key=repr) == sorted(said, key=repr)
        assert {r["predicted"] for r in toxicity.toxic_scores(docs, table).collect()} == {0}
    assert sorted(map(tuple, corpus_pipeline.drop_unidentified(spark, docs, SF).collect()), key=repr) == sorted(said[:9], key=repr)
    assert {(r["doc_id"], r["accepted"]) for r in language_id.languages(docs).collect()} == {(i, i not in (8, 9, 10)) for i, _, _ in said}


def test_clashing_columns(spark):
    names = ["toxic_score", "TOXIC_predicted", "_toxic_predicted", "_text", "lang_pred", "lang_score", "Lang_Accepted", "sha256", "text_sha256", "kept", "n", "i", "s", "fp", "group", "component", "h", "norm", "salt"]
    plain = spark.read.parquet(f"{SF}/documents.parquet").cache()
    docs = plain.select("*", *(F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns
        ids = sorted(r["doc_id"] for r in found.where(" and ".join(f"`{c}` = concat('{c} ', doc_id)" for c in names)).select("doc_id").collect())
        assert ids and ids == sorted(r["doc_id"] for r in stage(spark, plain, SF).select("doc_id").collect())
