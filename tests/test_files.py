"""The history data source: reads what read_exports reads, streams new files, writes documents as their rows come."""

import os
import resource
import time

import pytest

from parley.sources import files, history

SCHEMA = "conv_id bigint, pos bigint, id string, author string, text string, is_favorite boolean"
ROWS = [(1, 0, "a", "USER", 'hi\n  "q" \\ \x1f', True), (1, 1, "b", "ASSISTANT", "", False), (-2, 0, "a", "USER", "é日本", False), *((c, p, f"{c}-{p}", "ASSISTANT", "x" * c, p % 2 == 0) for c in range(3, 30) for p in range(c % 4 + 1))]
DOCUMENTS = {
    "blank": " \n", "broken": '{"version": 1, "messages": [{"id"', "lacks a field": '{"version": 1, "messages": [{"id": "a", "author": "USER", "text": "t"}]}', "null": '{"version": 1, "messages": [{"id": "a", "author": null, "text": "t", "isFavorite": true}]}',
    "more keys": '{"version": 2, "more": {}, "messages": [{"id": "a", "author": "assistant", "text": "t", "isFavorite": true, "x": 1}, {"id": "b", "author": "ASSISTANT", "text": "", "isFavorite": false}]}', "text after it": '{"version": 1, "messages": []} {}',
    "none": '{"version": 1, "messages": []}', "no version": '{"messages": []}', "a flag as version": '{"version": true, "messages": [{"id": "a", "author": "USER", "text": "t", "isFavorite": true}]}', "a number as id": '{"version": 1, "messages": [{"id": 1, "author": "USER", "text": "t", "isFavorite": true}]}', "not an object": "[1]",
}


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(files.HistorySource)
    return lambda path, **options: spark.read.format("history").options(**options).load(str(path))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_reads_what_read_exports_reads(spark, source, tmp_path):
    folder = tmp_path / "out"
    history.export(spark.createDataFrame(ROWS, SCHEMA), str(folder))
    assert rows(source(folder)) == rows(history.read_exports(spark, str(folder))) == sorted(ROWS)
    assert source(folder, split_bytes=300).rdd.getNumPartitions() > 5 and rows(source(folder, split_bytes=300)) == sorted(ROWS)
    assert rows(source(tmp_path / "none")) == []
    with pytest.raises(Exception, match="no history"):
        source(tmp_path / "none", strict=True).collect()


@pytest.mark.parametrize("name", DOCUMENTS)
def test_decode_policy(spark, source, tmp_path, name):
    """The same as that of read_exports, loading and strict."""
    (tmp_path / "conv_id=7").mkdir()
    (tmp_path / "conv_id=7" / "part.txt").write_text(DOCUMENTS[name])
    want = rows(history.read_exports(spark, str(tmp_path)))
    assert rows(source(tmp_path)) == want and bool(want) == (name == "more keys")
    if name in ("more keys", "none"):
        assert rows(source(tmp_path, strict=True)) == want
    else:
        with pytest.raises(Exception, match="not a history"):
            source(tmp_path, strict=True).collect()


def test_stream_of_new_files(spark, source, tmp_path):
    """Each run gives the files that have come or changed since the last one, once."""
    folder, seen = tmp_path / "in", []
    folder.mkdir()

    def put(conv_id, text):
        (folder / f"{conv_id}.json").write_text('{"version": 1, "messages": [{"id": "a", "author": "USER", "text": "%s", "isFavorite": true}]}' % text)

    def run():
        seen.clear()
        stream = spark.readStream.format("history").load(str(folder))
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: seen.extend((r["conv_id"], r["text"]) for r in df.collect())).trigger(once=True).start()
        query.awaitTermination(120)
        query.stop()
        return sorted(seen)

    put(1, "one")
    put(2, "two")
    (folder / "3.json").write_text("broken")
    assert run() == [(1, "one"), (2, "two")]
    time.sleep(0.02)
    put(4, "four")
    put(2, "changed")
    assert run() == [(2, "changed"), (4, "four")]
    assert run() == []


def test_write(spark, source, tmp_path):
    """What is written is read back; an overwrite replaces all, an append adds; a file a conversation; readable as an export."""
    path = tmp_path / "store"
    m = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    files.write_histories(m, str(path))
    assert rows(source(path)) == sorted(ROWS)
    names = [f for _, _, found in os.walk(path) for f in found if f.endswith(".json")]
    assert sorted(names) == sorted(f"{c}.json" for c in {r[0] for r in ROWS})
    one = next(p for _, p, _ in files.listed(str(path)) if p.endswith("/1.json"))
    assert open(one).read().split("\\u001")[0] == history.encode(m.where("conv_id = 1")).first()["json"].split("\\u001")[0]
    assert rows(history.read_history(spark, one, 1, strict=True)) == sorted(r for r in ROWS if r[0] == 1)
    files.write_histories(m.where("conv_id = 1"), str(path))
    assert rows(source(path)) == sorted(r for r in ROWS if r[0] == 1) and len(os.listdir(path)) <= 3
    files.write_histories(m.where("conv_id > 20"), str(path), "append")
    assert rows(source(path)) == sorted(r for r in ROWS if r[0] == 1 or r[0] > 20)
    files.write_histories(m.limit(0), str(path))
    assert rows(source(path)) == []


def test_an_aborted_write_leaves_the_old_files(spark, source, tmp_path):
    path = tmp_path / "store"
    m = spark.createDataFrame(ROWS, SCHEMA)
    files.write_histories(m, str(path))
    bad = m.selectExpr("conv_id", "pos", "id", "author", "if(conv_id = 20, raise_error('stop'), 'new') as text", "is_favorite")
    with pytest.raises(Exception, match="stop"):
        files.write_histories(bad, str(path))
    assert rows(source(path)) == sorted(ROWS)
    assert len([d for d in os.listdir(path) if d.startswith(files.GENERATION)]) == 1
    with pytest.raises(Exception, match="don't come together"):
        spark.createDataFrame([r for r in ROWS[:2]] + [ROWS[2], (1, 5, "z", "USER", "apart", False)], SCHEMA).coalesce(1).write.format("history").mode("overwrite").save(str(path))
    assert rows(source(path)) == sorted(ROWS)


def test_a_long_document_is_written_as_its_rows_come(tmp_path):
    """A million rows through one task's writer: it holds a batch of them."""
    import pyarrow as pa

    def batches():
        for at in range(0, 1_000_000, 10_000):
            n = range(at, at + 10_000)
            yield pa.RecordBatch.from_pydict({"conv_id": [1] * 10_000, "pos": list(n), "id": [str(i) for i in n], "author": ["USER"] * 10_000, "text": ["some text of a message " * 4] * 10_000, "is_favorite": [False] * 10_000})

    writer = files.HistoryWriter(str(tmp_path), ["conv_id", "pos", "id", "author", "text", "is_favorite"], True)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    done = writer.write(batches())
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    writer.commit([done])
    size = sum(s for _, _, s in files.listed(str(tmp_path)))
    assert size > 150 << 20 and grown < 100
