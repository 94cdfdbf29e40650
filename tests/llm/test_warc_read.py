"""Archives that other writers could have made, written by hand."""

import base64
import gzip
import hashlib

import pytest

from tidewater.llm.warc import frame, write_archives
from tidewater.llm.warc_read import read_warc


def record(kind, name, block, end="\r\n", **fields):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"warc-record-id: {name}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return end.join(lines).encode() + end.encode() * 2 + block + end.encode() * 2


def http(body, *heads):
    return "\r\n".join(["HTTP/1.0 200 OK", *heads]).encode() + b"\r\n\r\n" + body


def sha1(x, form="32"):
    own = hashlib.sha1(x)
    return "sha1:" + (base64.b32encode(own.digest()).decode() if form == "32" else own.hexdigest())


KIND = {"Content_Type": "application/http; msgtype=response"}
LONG = b"x" * 5000
FILES = {
    # no digests, folded header lines, records that are not asked for, bare line ends
    "plain.warc": record("warcinfo", "<urn:uuid:0>", b"software: other\r\n") + record("request", "<urn:uuid:1>", b"GET / HTTP/1.0\r\n\r\n")
    + record("response", "<urn:uuid:2>", http(b"two", "A: b"), WARC_Target_URI="http://a/\r\n  b", **KIND)
    + record("response", "<urn:uuid:3>", http(b""), end="\n", **KIND) + record("resource", "<urn:uuid:4>", b"", Content_Type="text/plain"),
    # a member a record; digests in both forms, a wrong one and one of another algorithm; chunked framing; a revisit
    "members.warc.gz": b"".join(gzip.compress(r) for r in (
        record("response", "<urn:uuid:5>", http(frame(LONG, 700), "Transfer-Encoding: chunked"), WARC_Payload_Digest=sha1(LONG), **KIND),
        record("response", "<urn:uuid:6>", http(b"six"), WARC_Payload_Digest=sha1(b"six", "hex"), **KIND),
        record("response", "<urn:uuid:7>", http(b"seven"), WARC_Payload_Digest=sha1(b"other"), **KIND),
        record("response", "<urn:uuid:8>", http(b"eight"), WARC_Payload_Digest="md5:abc", **KIND),
        record("revisit", "<urn:uuid:9>", http(b""), WARC_Refers_To="<urn:uuid:6>", **KIND),
    )),
    # one member for all; segments out of order, the others in the next file; no total length is stated for the second record
    "one.warc.gz": gzip.compress(
        record("continuation", "<urn:uuid:b2>", http(LONG)[2000:4000], WARC_Segment_Origin_ID="<urn:uuid:b>", WARC_Segment_Number=2)
        + record("response", "<urn:uuid:b>", http(LONG)[:2000], WARC_Segment_Number=1, WARC_Date="2020-01-01", **KIND)
    ),
    "rest.warc": record("continuation", "<urn:uuid:b3>", http(LONG)[4000:], WARC_Segment_Origin_ID="<urn:uuid:b>", WARC_Segment_Number=3, WARC_Segment_Total_Length=len(http(LONG)))
    + record("response", "<urn:uuid:c>", http(b"1234")[:-2], WARC_Segment_Number=1, **KIND) + record("continuation", "<urn:uuid:c2>", b"34", WARC_Segment_Origin_ID="<urn:uuid:c>", WARC_Segment_Number=2),
    "empty.warc": b"",
}


@pytest.fixture
def archives(tmp_path):
    for name, raw in FILES.items():
        (tmp_path / name).write_bytes(raw)
    return [f"{tmp_path}/{name}" for name in FILES]


def test_archives_of_other_writers(spark, archives):
    rows = {r.record_id.split(":")[-1].rstrip(">"): r for r in read_warc(spark, archives).collect()}
    payloads = {"2": b"two", "3": b"", "4": b"", "5": LONG, "6": b"six", "7": b"seven", "8": b"eight", "9": b"", "b": LONG, "c": b"1234"}
    assert {k: bytes(r.payload) for k, r in rows.items()} == payloads
    assert {k: r.digest_ok for k, r in rows.items()} == dict.fromkeys("2348bc9") | {"5": True, "6": True, "7": False}
    assert {k: r.segments for k, r in rows.items() if r.segments > 1} == {"b": 3, "c": 2}
    assert rows["2"].target_uri == "http://a/ b" and rows["9"].refers_to == "<urn:uuid:6>" and rows["b"].date == "2020-01-01" and rows["6"].date is None
    assert all(r.payload_bytes == len(r.payload) and r.payload_sha1 == hashlib.sha1(r.payload).hexdigest() for r in rows.values())
    assert {r.record_type for r in read_warc(spark, archives, ("request", "warcinfo")).collect()} == {"request", "warcinfo", "continuation"}


def test_damage_is_named(spark, tmp_path):
    whole = FILES["plain.warc"]
    cases = {"cut.warc": (whole[:-30], "cut short"), "odd.warc": (whole + b"odd\r\n", "no record begins"), "gap.warc": (FILES["rest.warc"] + FILES["rest.warc"], "segments of")}
    for name, (raw, said) in cases.items():
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(Exception, match=said):
            read_warc(spark, [f"{tmp_path}/{name}"]).collect()


def test_our_own_archives(spark, tmp_path):
    rows = [(1, "http://a", "a" * 40_000), (2, "http://b", "b"), (3, None, None), (4, "c", "a" * 40_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = write_archives(pages, f"{tmp_path}/own")
    got = read_warc(spark, [f"{tmp_path}/own/archives/{r.file}" for r in manifest.collect()]).collect()
    assert sorted((r.record_type, r.payload_bytes, r.digest_ok) for r in got if r.record_type == "response") == [("response", 0, True), ("response", 1, True), ("response", 40_000, True)]
    assert [r.refers_to.split(":")[2] for r in got if r.record_type == "revisit"] == ["4"]
