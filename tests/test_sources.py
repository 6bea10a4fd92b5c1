"""Landed JSON pages, corpus union, cache-aside corpus (FIXTURES.md §6)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from penmark.sources import corpus, paged_json


def _land(folder, kind, pages, total_pages=None, extra=None):
    os.makedirs(folder, exist_ok=True)
    field = paged_json.FEEDS[kind]
    for n, items in pages.items():
        body = {kind: [{field: t, "id": i, **(extra or {})} for i, t in enumerate(items)],
                "pagination": {"pages": total_pages or len(pages), "count": sum(len(v) for v in pages.values()), "page": n}}
        with open(os.path.join(folder, f"{kind}_page_{n}.json"), "w") as f:
            json.dump(body, f, indent=2, ensure_ascii=False)


def test_complete_set(spark, tmpdir_fresh):
    d = os.path.join(tmpdir_fresh, "dev")
    _land(d, "devlogs", {1: ["a", "b"], 2: ["c"], 3: []}, extra={"unknown": {"x": 1}})
    rows = paged_json.read_pages(spark, d, "devlogs").collect()
    assert sorted(r.text for r in rows) == ["a", "b", "c"]  # empty page: no rows
    audit = paged_json.page_audit(spark, d, "devlogs").collect()[0]
    assert audit.complete and audit.pages_found == 3 and audit.items == 3
    assert paged_json.missing_pages(spark, d, "devlogs").count() == 0


def test_missing_page_is_flagged(spark, tmpdir_fresh):
    d = os.path.join(tmpdir_fresh, "dev")
    _land(d, "devlogs", {1: ["a"], 3: ["c"]}, total_pages=3)
    audit = paged_json.page_audit(spark, d, "devlogs").collect()[0]
    assert not audit.complete
    assert [r.page for r in paged_json.missing_pages(spark, d, "devlogs").collect()] == [2]


def test_null_text_fails_strict(spark, tmpdir_fresh):
    d = os.path.join(tmpdir_fresh, "dev")
    _land(d, "devlogs", {1: ["a", None]})
    with pytest.raises(Exception):
        paged_json.read_pages(spark, d, "devlogs").collect()
    assert paged_json.read_pages(spark, d, "devlogs", strict=False).where(F.col("text").isNull()).count() == 1


def test_malformed_fails_fast(spark, tmpdir_fresh):
    d = os.path.join(tmpdir_fresh, "dev")
    _land(d, "devlogs", {1: ["a"]})
    with open(os.path.join(d, "devlogs_page_2.json"), "w") as f:
        f.write('{"devlogs": [{"text": "b"}')
    with pytest.raises(Exception):
        paged_json.read_pages(spark, d, "devlogs").collect()


def test_union_keeps_duplicates(spark, tmpdir_fresh):
    d = os.path.join(tmpdir_fresh, "dev")
    p = os.path.join(tmpdir_fresh, "proj")
    _land(d, "devlogs", {1: ["same", "x"]})
    _land(p, "projects", {1: ["same"]})
    u = corpus.corpus_union([
        ("devlogs", paged_json.read_pages(spark, d, "devlogs"), "text"),
        ("projects", paged_json.read_pages(spark, p, "projects"), "text"),
    ])
    assert u.where(F.col("text") == "same").count() == 2
    assert sorted(r.kind for r in u.collect()) == ["devlogs", "devlogs", "projects"]


def test_write_pages_roundtrip(spark, tmpdir_fresh):
    docs = corpus.table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text")
    d = os.path.join(tmpdir_fresh, "landed")
    paged_json.write_pages(docs, d, "devlogs", page_size=50)
    back = paged_json.read_pages(spark, d, "devlogs")
    assert back.count() == docs.count()
    assert back.select(F.md5("text")).exceptAll(docs.select(F.md5("text"))).count() == 0
    assert paged_json.page_audit(spark, d, "devlogs").collect()[0].complete


def test_cache_aside(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "corpus")
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("a",)], "text string")

    assert corpus.corpus_or_build(spark, p, build).count() == 1
    assert corpus.corpus_or_build(spark, p, build).count() == 1
    assert len(calls) == 1


def _one(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_corpus_follows_its_source(spark, tmpdir_fresh):
    src, p = os.path.join(tmpdir_fresh, "src"), os.path.join(tmpdir_fresh, "corpus")
    _one(spark, "a").write.parquet(src)
    first = corpus.corpus_or_build(spark, p, lambda: spark.read.parquet(src), corpus.fingerprint(spark, src))
    _one(spark, "b", "c").write.mode("append").parquet(src)
    second = corpus.corpus_or_build(spark, p, lambda: spark.read.parquet(src), corpus.fingerprint(spark, src))
    assert sorted(r.text for r in second.collect()) == ["a", "b", "c"]
    assert [r.text for r in first.collect()] == ["a"]  # a reader of the old table isn't disturbed


def test_two_builders_read_one_table(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "corpus")

    def slower():  # while this one builds, another finishes
        other = corpus.corpus_or_build(spark, p, lambda: _one(spark, "other"), "s")
        assert [r.text for r in other.collect()] == ["other"]
        return _one(spark, "mine")

    got = corpus.corpus_or_build(spark, p, slower, "s")
    assert [r.text for r in got.collect()] == ["other"]
    assert [f for f in os.listdir(p) if f.startswith("manifest-") and not f.endswith(".json")] == []


def test_a_failed_build_is_never_read(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "corpus")

    def broken():
        rows = _one(spark, "a", "b").repartition(2)
        return rows.selectExpr("if(text = 'b', raise_error('lost'), text) AS text")

    with pytest.raises(Exception):
        corpus.corpus_or_build(spark, p, broken, "s").collect()
    assert [r.text for r in corpus.corpus_or_build(spark, p, lambda: _one(spark, "whole"), "s").collect()] == ["whole"]


@pytest.mark.parametrize("body", ['{"pagination": {"pages": 2, "count": 1}}', '{"devlogs": [{"text": "b"}]}', '{"devlogs": [{"text": "b"}',
                                  '{"devlogs": [{"text": null}], "pagination": {"pages": 2, "count": 1}}'])
def test_page_that_does_not_decode(spark, tmpdir_fresh, body):
    """No list, no pagination, cut off, a null text: each raises in strict
    mode, makes the audit incomplete and stops a training job."""
    d = os.path.join(tmpdir_fresh, "dev")
    _land(d, "devlogs", {1: ["a"]}, total_pages=2)
    with open(os.path.join(d, "devlogs_page_2.json"), "w") as f:
        f.write(body)
    with pytest.raises(Exception):
        paged_json.read_pages(spark, d, "devlogs").collect()
    audit = paged_json.page_audit(spark, d, "devlogs").first()
    assert (audit.complete, audit.n_corrupt, audit.pages_found) == (False, 1, 1)
    assert [r.page for r in paged_json.missing_pages(spark, d, "devlogs").collect()] == [2]
    with pytest.raises(ValueError):
        paged_json.require_complete(spark, d, "devlogs")


def _line(n, texts, pages=3, **more):
    return json.dumps({"page": n, "devlogs": [{"text": t} for t in texts], "pagination": {"pages": pages, "count": 9}, **more})


def _land_lines(folder, *files):
    os.makedirs(folder)
    for i, lines in enumerate(files):
        with open(os.path.join(folder, f"part-{i}.json"), "w") as f:
            f.write("\n".join(lines) + "\n")
    return folder


def test_page_lines_roundtrip_and_files_follow_bytes(spark, tmpdir_fresh):
    texts = [f"text {i}\nwith a line" for i in range(5000)] + ["", "same", "same"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    size = sum(len(t) for t in texts)
    for file_bytes, n_files in ((1 << 30, 1), (-(-size // 4), 4)):
        d = os.path.join(tmpdir_fresh, f"lines-{n_files}")
        paged_json.write_page_lines(docs, d, page_size=10, file_bytes=file_bytes)
        assert len([f for f in os.listdir(d) if f.startswith("part-")]) == n_files  # for 501 pages
        assert sorted(r.text for r in paged_json.read_pages(spark, d, lines=True).collect()) == sorted(texts)
        audit = paged_json.page_audit(spark, d, lines=True).first()
        assert (audit.complete, audit.pages_found, audit.items) == (True, 501, 5003)


def test_page_lines_one_missing_page(spark, tmpdir_fresh):
    d = os.path.join(tmpdir_fresh, "lines")
    paged_json.write_page_lines(spark.range(2000).selectExpr("string(id) AS text"), d, page_size=5)
    [part] = [f for f in os.listdir(d) if f.startswith("part-")]
    with open(os.path.join(d, part)) as f:
        kept = [x for x in f if json.loads(x)["page"] != 237]
    cut = _land_lines(os.path.join(tmpdir_fresh, "cut"), [x.rstrip("\n") for x in kept])
    assert [r.page for r in paged_json.missing_pages(spark, cut, lines=True).collect()] == [237]
    audit = paged_json.page_audit(spark, cut, lines=True).first()
    assert (audit.complete, audit.pages_found, audit.pages_expected) == (False, 399, 400)
    with pytest.raises(ValueError, match="399 of 400"):
        paged_json.require_complete(spark, cut, lines=True)


def test_page_lines_strict(spark, tmpdir_fresh):
    whole = [_line(1, ["a", "b"]), _line(2, [])]
    cases = {
        "torn": ([*whole, _line(3, ["c"])[:-9]], (2, 1, 0)),
        "null": ([*whole, _line(3, ["c", None])], (2, 1, 0)),
        "bare": ([*whole, json.dumps({"page": 3, "devlogs": []})], (2, 1, 0)),
        "unnumbered": ([*whole, _line(None, ["c"])], (2, 1, 0)),
    }
    for name, (lines, want) in cases.items():
        d = _land_lines(os.path.join(tmpdir_fresh, name), lines)
        audit = paged_json.page_audit(spark, d, lines=True).first()
        assert (audit.pages_found, audit.n_corrupt, audit.n_repeated) == want, name
        assert not audit.complete
        with pytest.raises(Exception):
            paged_json.read_pages(spark, d, lines=True).collect()
    good = _land_lines(os.path.join(tmpdir_fresh, "good"), whole, [_line(3, ["c"], extra=1)])
    assert paged_json.page_audit(spark, good, lines=True).first().complete
    again = _land_lines(os.path.join(tmpdir_fresh, "again"), whole, [_line(3, ["c"]), _line(1, ["a", "b"])])
    audit = paged_json.page_audit(spark, again, lines=True).first()
    assert (audit.complete, audit.n_repeated) == (False, 1)


def test_pages_that_no_row_hashes_to_are_landed_empty(spark, tmpdir_fresh):
    docs = spark.range(300).selectExpr("string(id) AS text")
    for n, write in enumerate((paged_json.write_page_lines, paged_json.write_pages)):
        d = os.path.join(tmpdir_fresh, f"sparse-{n}")
        write(docs, d, page_size=1)
        pages = paged_json.read_envelopes(spark, d, lines=n == 0).where("size(items) = 0").count()
        audit = paged_json.page_audit(spark, d, lines=n == 0).first()
        assert pages > 0 and (audit.complete, audit.pages_found, audit.items) == (True, 300, 300)


def test_page_lines_of_an_empty_table(spark, tmpdir_fresh):
    d = os.path.join(tmpdir_fresh, "none")
    paged_json.write_page_lines(spark.createDataFrame([], "text string"), d)
    assert paged_json.read_pages(spark, d, lines=True).count() == 0
    audit = paged_json.page_audit(spark, d, lines=True).first()
    assert (audit.complete, audit.pages_found, audit.items) == (True, 1, 0)  # one empty page


def test_pages_are_made_of_small_partitions(spark, tmpdir_fresh, monkeypatch):
    """A file of page lines is written partition by partition, so what a task
    holds does not grow with the file; texts enter no sort before the shuffle."""
    monkeypatch.setattr(paged_json, "PART_BYTES", 20_000)
    docs = spark.range(4000).selectExpr("repeat(string(id), 20) AS text")
    out, n_pages, size = paged_json._landing(docs, "text", "devlogs", 10, paged_json.PART_BYTES)
    held = out.select(F.spark_partition_id().alias("p"), F.expr("aggregate(devlogs, 0, (a, x) -> a + octet_length(x.text))").alias("n"))
    most = held.groupBy("p").agg(F.sum("n").alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert n_pages == 400 and most[1] == size and most[0] < 2 * 20_000 < size / 6
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]
    for name, write in (("lines", paged_json.write_page_lines), ("pages", paged_json.write_pages)):
        d = os.path.join(tmpdir_fresh, name)
        write(docs, d, page_size=10)
        back = paged_json.read_pages(spark, d, lines=name == "lines").select("text")
        assert back.exceptAll(docs).count() == 0 and back.count() == 4000
        assert paged_json.page_audit(spark, d, lines=name == "lines").first().complete
    assert len([f for f in os.listdir(os.path.join(tmpdir_fresh, "lines")) if f.startswith("part-")]) == 1
