import hashlib

from penmark.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, n int"


def rows():
    long = "é</p>\r\n\r\n" * 300
    data = [(i, f"http://h/{i} \n", long if i % 3 == 0 else f"page {i} " * 200, "x", 1) for i in range(40)]
    data += [(100, None, None, "x", 1), (101, "u", "", "x", 1), (102, "u", "short", "x", 1), (103, "u", "short", "x", 1)]
    return [*data, (39, "twin", long, "x", 1), (None, "none", long, "x", 1), (200, "edge", "a" * 999, "x", 1), (201, "edge", "a" * 999, "x", 1), (202, "e", "b" * 1000, "x", 1), (203, "e", "b" * 1000, "x", 1)]


def test_round_trip(spark, same):
    expected = []
    for page, url, html, *_ in rows():
        body = (html or "").encode()
        mates = [p for p, _, h, *_ in rows() if (h or "").encode() == body and p is not None]
        first = max(mates, default=None)
        again = len(body) >= 1000 and page != first
        expected.append({
            "page_id": page, "payload_bytes": len(body), "payload_digest": hashlib.sha1(body).hexdigest(), "record_type": "revisit" if again else "response",
            "refers_to": first if again else None, "url": warc._uri(url) if url is not None else None, "payload": None if again else body,
        })
    index = warc.write_archives(spark.createDataFrame(rows(), SCHEMA).repartition(3))
    got = warc.read_records(index)
    same(got.withColumn("payload", got.payload), [e | {"payload": bytearray(e["payload"]) if e["payload"] is not None else None} for e in expected])
    some = warc.read_records(index.where("page_id = 7"))
    assert [bytes(r.payload).decode() for r in some.collect()] == ["page 7 " * 200]
    assert index.columns == [c.split()[0] for c in warc.INDEX.split(", ")]


def test_ranges_are_coalesced():
    assert list(warc.ranges([(0, 10), (10, 5), (15 + warc.GAP, 5), (21 + 2 * warc.GAP, 5)])) == [[(0, 10), (10, 5), (15 + warc.GAP, 5)], [(21 + 2 * warc.GAP, 5)]]
    assert list(warc.ranges([(0, warc.READ + 1), (warc.READ + 1, 3)])) == [[(0, warc.READ + 1)], [(warc.READ + 1, 3)]]


def test_empty(spark):
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], SCHEMA))).count() == 0
