"""WARC: exact round trip, revisits, selection, damage."""

import hashlib

import pytest

from tickframe.llm import warc
from tickframe.llm.common import new_path, table

from .fixtures import rows


def odd_pages(spark):
    body = "<p>" + "é" * 200 + "</p>"
    data = [(3, "http://a/", body, 1), (1, "http://b/\r\nX: y", body, 1), (2, None, None, 1), (5, "http://c/", "short", 1), (4, "http://d/", "short", 1), (6, "u", "", 1), (None, "u", body, 1), (1, "http://b/", body, 1), (9, "u", "a\r\n\r\nb\x00" * 40_000, 1)]
    return spark.createDataFrame(data, "page_id long, url string, html string, digest int")


def want(pages):
    out = []
    first = {}
    for p in pages:
        if p.page_id is not None and len((p.html or "").encode()) >= 100:
            first[p.html] = min(first.get(p.html, p.page_id), p.page_id)
    for p in pages:
        b = (p.html or "").encode()
        to = first.get(p.html) if len(b) >= 100 and p.page_id is not None else None
        to = to if to is not None and to < p.page_id else None
        out.append((p.page_id, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["odd", "table", "empty"])
def test_round_trip(spark, sf, kind):
    pages = table(spark, sf, "pages") if kind == "table" else odd_pages(spark)
    pages = pages.limit(0) if kind == "empty" else pages
    folder = new_path(spark, "warc")
    index = warc.write(pages, folder)
    got = warc.read(index, folder, with_payload=True)
    assert rows(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == want(pages.collect())
    full = {(p.page_id, p.html or "") for p in pages.collect()}
    assert all((r.page_id, bytes(r.payload).decode()) in full for r in got.where("record_type = 'response'").collect())
    chosen = index.where("page_id % 3 = 0")
    assert warc.read(chosen, folder).count() == chosen.count()


def test_damage_is_an_error():
    member = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parsed(member)[1] == b"payload"
    with pytest.raises(ValueError):
        warc.parsed(warc.record(1, "u", b"payload", "00", None))


def test_matches_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    assert rows(warc.op7_warc(spark, sf)) == sorted(con.sql(warc.OP7_SQL).fetchall(), key=repr)
