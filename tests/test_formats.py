"""Page dumps by byte ranges, and result lines that are there once."""

from __future__ import annotations

import io
import json
import time

import pytest

from pricetide.sources import envelopes, formats
from pricetide.sources.tables import load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    formats.register(spark)


@pytest.mark.parametrize("size", [1, 3, 7, 64, 10_000])
def test_ranges_take_each_line_once(monkeypatch, size):
    monkeypatch.setattr(formats, "STEP_BYTES", 5)
    for text in (b"", b"\n", b"a", b"a\n", b"one\ntwo\n\nthree is long\nx", b"\n\n\nz\n" * 3, "é😀\nü\n".encode() * 4):
        found = [x for a in range(0, len(text), size) for x in formats.lines_of(io.BytesIO(text), a, min(len(text), a + size))]
        assert found == (text.split(b"\n")[:-1] if text.endswith(b"\n") else text.split(b"\n") if text else []), (text, size)


def test_page_dump(spark, tmp_path):
    folder = tmp_path / "dump"
    (folder / "more").mkdir(parents=True)
    pages = [{"url": f"u{i}", "html": f"<title>T{i}</title><p>x {'y' * (i * 7 % 50)}é</p>", "http_status": 200 + i % 3, "other": 1} for i in range(200)]
    (folder / "a.json").write_text("\n".join(json.dumps(p, ensure_ascii=False) for p in pages[:120]) + "\n")
    (folder / "more/b.json").write_text("\n".join(json.dumps(p) for p in pages[120:]) + '\nbroken {\n[1]\n{"url": 5}\n')
    (folder / "_ignored").write_text("x")
    for size in (97, 1 << 20):
        rows = spark.read.format("page_dump").option("rangeBytes", size).load(str(folder))
        assert rows.schema.simpleString().startswith("struct<url:string,html:string,text:string")
        good = {(r["url"], r["html"], r["http_status"]) for r in rows.where("error is null").collect()}
        assert good == {(p["url"], p["html"], p["http_status"]) for p in pages}
        assert rows.where("error = 'bad_line' and status = 'error' and url is null").count() == 3 and rows.count() == 203
    assert spark.read.format("page_dump").load(str(folder)).rdd.getNumPartitions() == 2
    shaped = envelopes.to_envelope(spark.read.format("page_dump").schema("url string, html string").load(f"file://{folder}/a.json"))
    assert shaped.count() == 120 and shaped.where("title = 'T7'").count() == 1


def results_stream(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = load(spark, SF, "results").select("query", "retailer_key", "status")
    for k in range(3):
        rows.where(f"abs(hash(query)) % 3 = {k}").repartition(3).write.mode("append").parquet(path)
        time.sleep(0.02)
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(path)


def written(folder):
    return sorted(line for f in folder.glob("batch=*/*.ndjson") for line in f.read_text().splitlines())


def test_result_lines_are_streamed_once(spark, tmp_path):
    rows, stream = results_stream(spark, tmp_path)
    out, check = tmp_path / "out", str(tmp_path / "check")
    for _ in range(2):  # a restart adds nothing
        q = formats.result_rows(stream).writeStream.format("result_lines").option("path", str(out)).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
    lines = written(out)
    retailer = [x for x in lines if '"type":"retailer"' in x]
    assert sorted(retailer) == sorted(r["value"] for r in envelopes.shop_results_ndjson(rows).where("part = 0").collect())
    summed = [json.loads(x)["data"] for x in lines if '"type":"summary"' in x]
    assert sum(s["attempted"] for s in summed) == rows.count() and sum(s["success"] for s in summed) == rows.where("status = 'ok'").count()
    assert len(list(out.glob("batch=*"))) >= 2 and not list((out / "_aside").iterdir())


def test_a_task_that_runs_twice_leaves_no_double_line(tmp_path):
    writer = formats.ResultLinesWriter({"path": str(tmp_path)})
    rows = [{"query": "q", "status": "ok", "value": '{"type":"retailer"}'}, {"query": "q", "status": "blocked", "value": "two"}]
    writer.write(iter(rows))  # a task that was lost after it wrote
    again, other = writer.write(iter(rows)), writer.write(iter(rows[:1]))
    writer.commit([again, None, other], 4)
    want = sorted(['{"type":"retailer"}', "two", '{"type":"retailer"}', '{"type":"summary","data":{"attempted":3,"success":2,"blocked":1}}'])
    assert written(tmp_path) == want
    writer.commit([writer.write(iter(rows))], 4)  # the batch once more, after a restart
    assert written(tmp_path) == want
    (tmp_path / "batch=5").mkdir()
    (tmp_path / "batch=5/part-00000.ndjson").write_text("half\n")  # a commit that did not end
    writer.commit([writer.write(iter(rows[:1]))], 5)
    assert "half" not in written(tmp_path)
    left = writer.write(iter(rows))
    writer.abort([left, None], 6)
    assert not (tmp_path / "_aside" / left.name).exists() and not (tmp_path / "batch=6").exists()
