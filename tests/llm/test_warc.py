"""WARC: round trip, revisits, and salvage of damaged archives."""
import hashlib
import io
import os

import pytest

from varilens.llm import warc as W


def rec(k, body=b"<p>x</p>"):
    return W.record_bytes("response", f"urn:page:{k}", f"http://a/{k}", hashlib.sha1(body).hexdigest(), len(body), body)


def salvaged(data, span=W.WINDOW):
    W_span, W.WINDOW = W.WINDOW, span
    try:
        rows = list(W.salvage(io.BytesIO(data), len(data)))
    finally:
        W.WINDOW = W_span
    at, last = 0, None
    for r in rows:  # records and gaps cover the file; those of one member share its bytes
        assert r["length"] > 0
        if (r["offset"], r["length"]) != last or r.get("inner_offset") is None:
            assert r["offset"] == at
            at += r["length"]
            inner = 0
        if r.get("inner_offset") is not None:
            assert r["inner_offset"] == inner and r["inner_length"] > 0
            inner += r["inner_length"]
        last = r["offset"], r["length"]
    assert at == len(data)
    return [r["record_id"].rpartition(":")[2] for r in rows if r["kind"] == "record"], [r for r in rows if r["kind"] == "gap"]


@pytest.mark.parametrize("pack", [W.member, lambda b: b], ids=["gzip members", "plain records"])
def test_salvage_finds_later_records(pack):
    parts = [pack(rec(k, os.urandom(50).hex().encode() * 20)) for k in range(6)]
    ids, gaps = salvaged(b"".join(parts))
    assert ids == list("012345") and not gaps
    for damage in (lambda b: b[:10] + b"\0\0\0\0" + b[14:], lambda b: b[:-9], lambda b: b[len(b) // 2:], lambda b: b"junk" + b[7:]):
        ids, gaps = salvaged(b"".join([*parts[:2], damage(parts[2]), *parts[3:]]))
        assert ids == list("01345") and len(gaps) == 1 and gaps[0]["reason"]


def test_changed_payload_bad_length_junk_and_empty_file():
    changed = rec(1, b"<p>one</p>").replace(b"one", b"two")
    ids, gaps = salvaged(W.member(rec(0)) + W.member(changed) + b"WARC/1.1 almost" + rec(2))
    assert ids == ["0", "2"] and len(gaps) == 1 and gaps[0]["reason"] == "payload digest differs"
    ids, gaps = salvaged(rec(0).replace(b"Content-Length: 8", b"Content-Length: 9") + rec(3))
    assert ids[-1] == "3" and gaps
    assert salvaged(b"") == ([], [])
    ids, gaps = salvaged(os.urandom(5000))
    assert ids == [] and len(gaps) == 1


def test_mixed_members_beyond_one_window():
    body = os.urandom(3000).hex().encode()
    data = b"".join(W.member(rec(k, body)) if k % 2 else rec(k, body) for k in range(10))
    cut = data.index(b"WARC/1.1", 10)
    assert salvaged(data[:cut + 3] + b"?" + data[cut + 4:], span=1 << 15)[0] == ["0", "1", "3", "4", "5", "6", "7", "8", "9"]


def test_round_trip_with_copies_nulls_and_repeats(spark):
    big, small = "é" * 600, "x" * 999
    rows = [(1, "u\r\nX: y", big), (2, "u", big), (3, "u", small), (4, "u", small), (5, None, None), (6, "u", ""),
            (7, "u", "x" * 1000), (8, "u", "x" * 1000), (8, "u", "x" * 1000), (9, "u", "long " * 400_000), (None, "u", "n" * 2000), (None, None, "n" * 2000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, salt int")
    files = W.write_archives(pages, file_bytes=2000)
    assert files.count() > 1
    found = W.read_archives(files).where("kind = 'record'").collect()
    got = sorted((r.record_id, r.record_type, r.refers_to, r.header_digest, r.header_bytes) for r in found)
    refers = {1: 2, 7: 8}
    exp = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = refers.get(i)
        exp.append((f"urn:page:{'' if i is None else i}", "revisit" if to else "response", f"urn:page:{to}" if to else None,
                    hashlib.sha1(raw).hexdigest(), len(raw)))
    assert got == sorted(exp, key=lambda r: (r[0], r[1], r[2] or ""))
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.header_digest for r in found if r.record_type == "response")
    assert W.read_archives(files).where("kind = 'gap'").count() == 0


def test_damaged_file_in_a_folder_and_empty_table(spark, tmp_path):
    path = tmp_path / "a.warc.gz"
    parts = [W.member(rec(k)) for k in range(4)]
    path.write_bytes(parts[0] + parts[1][:-5] + parts[2] + parts[3])
    files = spark.createDataFrame([(f"file://{path}",)], "path string")
    rows = W.read_archives(files).orderBy("offset").collect()
    assert [(r.kind, r.record_id) for r in rows] == [("record", "urn:page:0"), ("gap", None), ("record", "urn:page:2"), ("record", "urn:page:3")]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_archives(W.write_archives(empty)).count() == 0


def numbered(n, size=50):
    return [rec(k, os.urandom(size).hex().encode()) for k in range(n)]


@pytest.mark.parametrize("span", [W.WINDOW, 1 << 15])
def test_many_records_in_one_member(span):
    """With the small window the member is too large to keep and is unpacked again."""
    parts = numbered(10, 30_000)
    ids, gaps = salvaged(W.member(b"".join(parts)), span)
    assert ids == list("0123456789") and not gaps
    damaged = parts[3].replace(b"HTTP/1.1 200 OK", b"HTTP/1.1 200 KO").replace(b"\r\n\r\n", b"\r\n\n", 1)
    ids, gaps = salvaged(W.member(b"".join([*parts[:3], damaged, *parts[4:]])) + W.member(rec(77)), span)
    assert ids == [*"012456789", "77"] and len(gaps) == 1
    assert gaps[0]["inner_offset"] == sum(map(len, parts[:3])) and gaps[0]["inner_length"] == len(damaged)
    ids, gaps = salvaged(W.member(parts[0] + b"junk behind it") + W.member(b"junk before" + parts[1]), span)
    assert ids == ["0", "1"] and [g["inner_length"] for g in gaps] == [14, 11]
    ids, gaps = salvaged(W.member(b"no record at all") + W.member(b"") + W.member(parts[2]), span)
    assert ids == ["2"] and len(gaps) == 1 and "inner_offset" not in gaps[0]


def test_digests_in_base32_and_other_algorithms():
    import base64
    body = b"<p>text</p>"
    sha1 = hashlib.sha1(body)
    plain = W.record_bytes("response", "urn:page:1", "u", "DIGEST", len(body), body)
    good = [b"sha1:" + base64.b32encode(sha1.digest()), b"SHA1:" + sha1.hexdigest().upper().encode(), sha1.hexdigest().encode(),
            b"md5:" + hashlib.md5(body).hexdigest().encode(), b"sha-256:" + base64.b32encode(hashlib.sha256(body).digest()).rstrip(b"="),
            b"blake9:whatever"]
    for d in good:
        for pack in (W.member, bytes):
            data = pack(plain.replace(b"sha1:DIGEST", d))
            assert salvaged(data) == (["1"], []), d
    for d, why in ((b"sha1:" + base64.b32encode(hashlib.sha1(b"x").digest()), "payload digest differs"), (b"sha1:zz", "unreadable payload digest")):
        ids, gaps = salvaged(plain.replace(b"sha1:DIGEST", d))
        assert ids == [] and gaps[0]["reason"] == why
    row = next(W.salvage(io.BytesIO(data := plain.replace(b"sha1:DIGEST", good[0])), len(data)))
    assert row["header_digest"] == sha1.hexdigest()


def test_limits_are_parameters_and_losses_are_told(spark):
    pages = spark.createDataFrame([(1, "u", "short"), (2, "u" * 3000, "x" * 5000)], "page_id long, url string, html string")
    files = W.write_archives(pages)
    read = lambda **k: sorted((r.kind, r.reason) for r in W.read_archives(files, **k).collect())
    assert read(whole=True) == [("record", None)] * 2
    assert ("gap", "record over the size limit") in read(record_limit=1000)
    assert ("gap", "headers over the size limit") in read(header_limit=1000)
    with pytest.raises(Exception, match="records were written"):
        W.read_archives(files, record_limit=1000, whole=True).count()


def test_folders_are_qualified_by_spark(spark, tmp_path):
    assert W._qualified(spark, str(tmp_path)) == f"file://{tmp_path}" == W._qualified(spark, f"file://{tmp_path}")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.defaultFS", "viewfs://store/")
    try:
        with pytest.raises(Exception, match="viewfs|mount"):  # the default file system is asked, not the local disk
            W._qualified(spark, "/some/folder")
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.defaultFS", "file:///")
