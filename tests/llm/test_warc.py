import gzip
import hashlib
import io

import pytest

from marquee.llm import warc as W


def page_rows(spark):
    big = "<p>" + "é" * 60_000
    rows = [(5, "http://a/x y\r\nInjected: 1", "p" * 200), (2, None, "p" * 200), (9, "http://b/é", "p" * 200), (1, "u", None), (3, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", "p" * 200), (7, "u", big), (7, "u", big), (8, "u", big)]
    return rows, spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


def test_round_trip(spark):
    rows, pages = page_rows(spark)
    files = W.write(pages, W.new_folder(spark))
    got = W.read(files).collect()
    assert len(got) == len(rows) == files.groupBy().sum("records").first()[0]
    want = {}
    for page, _, html in rows:
        body = (html or "").encode()
        first = min(p for p, _, h in rows if p is not None and (h or "") == (html or "")) if len(body) >= 100 else page
        want[page] = (len(body), hashlib.sha256(body).hexdigest(), "response" if first == page else "revisit", None if first == page else first)
    for r in got:
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want[r.page_id]
        assert r.payload is None if r.record_type == "revisit" else hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest
    urls = {r.page_id: r.url for r in got}
    assert urls[2] is None and urls[9] == "http://b/%C3%A9" and urls[5] == "http://a/x%20y%0D%0AInjected:%201"


def test_one_member_per_record_and_rolling(spark, monkeypatch):
    monkeypatch.setattr(W, "ROLL_BYTES", 1)
    rows, pages = page_rows(spark)
    files = W.write(pages.coalesce(1), W.new_folder(spark))
    assert W.read(files, payload=False).count() == len(rows)


def archive(*members):
    return io.BytesIO(b"".join(members))


def member(payload=b"x" * 300, **change):
    return W.record(1, "u", payload, hashlib.sha256(payload).hexdigest(), None, False, "2000-01-01T00:00:00Z")


def test_damage_is_found():
    good = member()
    assert len(list(W.records(archive(good, good)))) == 2
    plain = gzip.decompress(good)
    for bad in (good[:-9], gzip.compress(plain.replace(b"xxx\r\n", b"xxy\r\n")), gzip.compress(plain + b"more"), gzip.compress(plain.replace(b"Content-Length: ", b"Content-Length: 9", 1)), gzip.compress(plain[4:]), gzip.compress(plain[:50])):
        with pytest.raises(ValueError):
            list(W.records(archive(good, bad)))
    with pytest.raises(ValueError):
        list(W.records(archive(gzip.compress(plain + plain))))


def test_empty(spark):
    pages = page_rows(spark)[1].limit(0)
    assert W.read(W.write(pages, W.new_folder(spark))).count() == 0
