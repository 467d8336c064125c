"""Passages, pages and streams."""

import shutil

from pyspark.sql import functions as F

from millrace.operators.passages import PASSAGE, chunk_documents, packed, page_extract, read_page
from millrace.streaming.events import first_within, read_events, session_counts, window_counts

DATA = "/root/testdata/sf0.001"


def test_passages_hold_the_whole_text():
    assert list(packed(None)) == list(packed(" \n")) == []
    assert list(packed("One. Two! Three?", 9)) == ["One. Two!", "Three?"]
    assert list(packed("abcdefgh. Ij.", 4)) == ["abcd", "efgh", ".", "Ij."]
    text = "A first sentence. " * 300 + "x" * 2000
    assert max(map(len, packed(text))) <= PASSAGE
    assert "".join("".join(packed(text)).split()) == "".join(text.split())


def test_chunks_hold_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = {}
    for r in sorted(chunk_documents(spark, DATA).collect(), key=lambda r: (r.doc_id, r.chunk_id)):
        found.setdefault(r.doc_id, []).append(r.text)
    squeezed = lambda t: "".join((t or "").split())
    assert all(squeezed("".join(found.get(i, []))) == squeezed(t) for i, t in docs.items())


def test_chunks_of_documents_without_text(spark, tmp_path):
    """Null and blank texts have no passage, alone in their file or among others; ids beside a null one stay whole; a sentence of any length."""
    rows = [(1, None), (2, ""), (3, " \n"), (9007199254740993, "One. Two."), (None, "x" * 2_000_000 + " . y")]
    folder = tmp_path / "documents.parquet"
    for part, own in enumerate((rows[:2], rows)):
        spark.createDataFrame(own, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(folder))
        found = sorted(((r.doc_id or 0, r.chunk_id, r.text) for r in chunk_documents(spark, str(tmp_path)).collect()))
        if not part:
            assert found == []
    assert found[-1] == (9007199254740993, 0, "One. Two.")
    assert [r[:2] for r in found[:-1]] == [(0, k) for k in range(2501)] and found[-2][2] == ". y"


def test_page_text():
    html = "<title>T &amp; U</title><nav><a href=/>menu</a></nav><script>var t='</p>';</script><div class=ad>buy<div>now</div></div><p>One <b>two</b>.<p>Three <a href=x>four</a>"
    assert read_page(html) == ("T & U", "One two.\nThree four", 1)
    assert read_page(None) == ("", "", 0)


def test_pages(spark):
    rows = page_extract(spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert all("var t=" not in r.text for r in rows)


def test_streams_equal_batches(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    shutil.copy(f"{DATA}/events.parquet", folder / "a.parquet")
    batch = spark.read.parquet(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
    for name, of in (("counts", window_counts), ("sessions", session_counts)):
        stream = of(read_events(spark, str(folder)))
        query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, of(batch).collect()))


def test_stream_leaves_out_repeats(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    for name in "ab":
        shutil.copy(f"{DATA}/events.parquet", folder / f"{name}.parquet")
    stream = first_within(read_events(spark, str(folder)), ["event_id"], "60 days")
    query = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.table("firsts").count() == spark.read.parquet(f"{DATA}/events.parquet").count()
