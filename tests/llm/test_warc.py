import base64
import hashlib
import uuid

import pytest

from citeloom.llm.warc import captures, deduplicated_archives, page_records, parse, read_archives, resolve_revisits, write_archives
from citeloom.runtime import scratch_folder

SCHEMA = "page_id long, url string, html string, payload string, original string, value string, payload_digest string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "o", "v", "d") for r in rows], SCHEMA)


ROWS = [(5, "http://a/5", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (1, "u1", "one"), (3, None, None),
        (4, "u4", ""), (6, "u6", "WARC/1.1\r\n\r\n\r\nContent-Length: 3\r\n\r\n" + "ä" * 40_000), (7, "a\r\nb", "seven\r\n\r\n"), (None, "n", "one"), (None, "n", "alone")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h in rows:
        f = first.get(h or "")
        revisits = f is not None and f != p
        out.append((p, len((h or "").encode()), digest(h), "revisit" if revisits else "response", f if revisits else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    got = page_records(frame(spark, ROWS)).drop("url")
    assert sorted(map(tuple, got.collect()), key=repr) == expected(ROWS)


def test_payloads_come_back_once(spark):
    folder, back = deduplicated_archives(frame(spark, ROWS))
    rows = back.collect()
    assert {r["page_id"]: r["payload"].decode() for r in rows if r["record_type"] == "response" and r["page_id"] is not None} == {
        2: "<p>same</p>", 1: "one", 3: "", 6: ROWS[6][2], 7: "seven\r\n\r\n"}
    assert all(r["payload"] is None for r in rows if r["record_type"] == "revisit")
    ids = {r["page_id"]: r["record_id"] for r in rows}
    assert next(r["refers_to"] for r in rows if r["page_id"] == 9) == ids[2]
    uuid.UUID(ids[2].removeprefix("<urn:uuid:").rstrip(">"))


def test_small_payloads_stay_responses(spark):
    folder = scratch_folder(spark, "warc-test")
    write_archives(resolve_revisits(captures(frame(spark, ROWS)), least_bytes=5), folder)
    kinds = {r["page_id"]: r["record_type"] for r in read_archives(spark, folder, payload=False).collect()}
    assert kinds[4] == kinds[3] == kinds[1] == "response" and kinds[5] == "revisit"


def test_damaged_archive_is_refused():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [bytes(b) for _, b in parse(good + good)] == [b"ab", b"ab"]
    for bad in (good[:-1] + b"x", b"x" + good):
        with pytest.raises(ValueError):
            list(parse(bad))


def test_empty(spark):
    assert page_records(frame(spark, [])).collect() == []
