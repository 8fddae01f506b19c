"""Archives as other readers take them: identifiers, references, and records by offset."""

import glob
import gzip

from pyspark.sql import DataFrameWriter

from cityloom.llm import url_filter, warc


def test_identifiers_are_unique_and_refer_to_records(spark, tmp_path):
    long = "x" * 3_000_000
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "u", long), (5, "v", None), (None, "n", "same"), (6, "w", "alone"), (6, "w", "alone"), (7, "z", "ß")]
    pages = spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id long, url string, html string, digest string, revisit int")
    warc.write(pages, f"{tmp_path}/w")
    records = warc.read(spark, f"{tmp_path}/w").collect()
    ids = [r.id for r in records]
    assert len(records) == 3 * len(rows) and len(set(ids)) == len(ids)
    responses = {r.id: r for r in records if r.kind == "response"}
    revisits = [r for r in records if r.kind == "revisit"]
    assert len(revisits) == 3 and all(responses[r.refers_to].digest == r.digest for r in revisits)
    assert {r.concurrent_to for r in records if r.concurrent_to} == {r.id for r in records if r.kind in ("response", "revisit")}
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.assemble(warc.read(spark, f"{tmp_path}/w")).collect())
    assert got == sorted([(1, "revisit", 2, 4), (2, "response", 0, 4), (2, "response", 0, 4), (3, "revisit", 5, 0), (4, "response", 0, len(long)), (5, "response", 0, 0), (0, "revisit", 2, 4), (6, "response", 0, 5), (6, "response", 0, 5), (7, "response", 0, 2)])
    for path in glob.glob(f"{tmp_path}/w/part-*"):
        data = open(path, "rb").read()
        at = 0
        for head, block in warc.parse(data):
            assert data[at : at + 9] == b"WARC/1.1\r" and next(warc.parse(data[at:]))[0] == head
            at = data.index(b"\r\n\r\n", at) + 8 + len(block)


def test_whole_files_in_gzip_are_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/g", compression="gzip")
    assert gzip.open(glob.glob(f"{tmp_path}/g/part-*.gz")[0]).read(5) == b"WARC/"
    assert warc.assemble(warc.read(spark, f"{tmp_path}/g")).count() == 2


def test_no_archive_is_without_records(spark, tmp_path):
    pages = spark.range(0, 40, 1, 4).where("id >= 15").selectExpr("id AS page_id", "'u' AS url", "string(id % 12) AS html")  # no rows in the first task
    for name, compression, opened in (("p", "none", open), ("z", "gzip", gzip.open)):
        for part, n in ((pages, 25), (pages.limit(0), 0)):
            path = f"{tmp_path}/{name}{n}"
            warc.write(part, path, compression=compression)
            files = [opened(f, "rb").read() for f in glob.glob(f"{path}/part-*")]
            assert files and all(f.startswith(b"WARC/1.1\r\n") for f in files)
            kinds = [head["warc-type"] for f in files for head, _ in warc.parse(f)]
            assert len(kinds) == 3 * n + 1 and kinds.count("warcinfo") == 1
            records = warc.read(spark, path)
            assert records.count() == 3 * n and warc.assemble(records).count() == n


def test_payloads_are_not_digested_again_for_each_probe(spark, tmp_path, monkeypatch):
    plans, text = [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path: plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()) or text(self, path))
    rows = [(i, f"http://{i}/", f"page {i // 3 if i < 9 else i}") for i in range(200)] + [(8, "http://8/again", "page 2")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/d")
    filters = [line for line in plans[0].splitlines() if "Filter" in line]
    assert any("html" in line for line in filters) and not any("sha" in line.split("Filter", 1)[1].replace("shared", "") for line in filters)
    got = warc.assemble(warc.read(spark, f"{tmp_path}/d")).collect()
    assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == [(0, 2), (1, 2), (3, 5), (4, 5), (6, 8), (7, 8)] and len(got) == 201


def test_short_payloads_stay_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (2, "a", "x")], "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/s", least_bytes=10)
    records = warc.read(spark, f"{tmp_path}/s").collect()
    assert sum(r.kind == "response" for r in records) == 3 and len({r.id for r in records}) == 9


def test_columns_of_pages_keep_their_values(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "mine", "h")], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([("a.com",), (None,), ("",)], "key string")
    r = url_filter.judge(pages, listed, rules=()).first()
    assert (r.host, r.verdict, r.host_, r.verdict_, r.listed) == ("mine", "h", "a.com", "block", True)
