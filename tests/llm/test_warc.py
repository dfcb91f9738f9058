"""WARC archives: round trip through files, revisits, and the salvage of damaged archives."""

import base64
import gzip
import hashlib
import random
import zlib

import pytest

from memspark.llm import warc

PAYLOADS = [b"<p>one</p>", b"", "é\r\n\r\nWARC/1.1\r\n".encode() * 3, bytes(range(256)) * 40, b"\x1f\x8b\x08" * 5, b"x" * 200_000]


def pieces(gzipped=True):
    records = [warc.record_bytes(str(i), f"http://a/{i}", p, None, "2020-01-01T00:00:00Z") for i, p in enumerate(PAYLOADS)]
    return [warc.member_bytes(r) if gzipped else r for r in records]


def keys(found):
    return [f.record.key for f in found if f.record]


def gaps(found):
    return [(f.offset, f.size) for f in found if f.reason]


def test_whole_archives_have_no_gap():
    for gzipped in (True, False):
        found = list(warc.salvage(b"".join(pieces(gzipped))))
        assert [f.record.payload for f in found] == PAYLOADS and not gaps(found)
        assert found[0].record.digest == base64.b32encode(hashlib.sha1(PAYLOADS[0]).digest()).decode()
    mixed = pieces()[0] + pieces(False)[1] + warc.EMPTY_MEMBER + pieces()[2]
    assert keys(warc.salvage(mixed)) == ["0", "1", "2"] and not gaps(warc.salvage(mixed))
    one_member = gzip.compress(b"".join(pieces(False)))
    assert keys(warc.salvage(one_member)) == list("012345") and not gaps(warc.salvage(one_member))
    assert list(warc.salvage(b"")) == []


@pytest.mark.parametrize("gzipped", [True, False])
def test_damage_costs_only_the_damaged_record(gzipped):
    r = random.Random(3)
    parts = pieces(gzipped)
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    for hit, part in enumerate(parts):
        for _ in range(12):
            at = r.randrange(len(part))
            broken = bytearray(part)
            broken[at] ^= 1 << r.randrange(8)
            found = list(warc.salvage(b"".join([*parts[:hit], bytes(broken), *parts[hit + 1:]])))
            got = [f.record for f in found if f.record]
            others = [p for i, p in enumerate(PAYLOADS) if i != hit]
            assert [x.payload for x in got if x.payload in others] == others  # damage of a header field may go unseen
            if len(got) < len(PAYLOADS):
                assert gaps(found) == [(starts[hit], len(part))] and next(f.reason for f in found if f.reason)


@pytest.mark.parametrize("gzipped", [True, False])
def test_cut_lost_and_foreign_bytes(gzipped):
    parts = pieces(gzipped)
    whole = b"".join(parts)
    junk = b"WARC/1.1\r\nnot a record" + bytes(50) + b"\x1f\x8b\x08 nor a member"
    found = list(warc.salvage(junk + whole))
    assert keys(found) == list("012345") and gaps(found) == [(0, len(junk))]
    at = len(parts[0]) + len(parts[1])
    found = list(warc.salvage(whole[:at] + junk + whole[at:] + junk))
    assert keys(found) == list("012345") and gaps(found) == [(at, len(junk)), (len(whole) + len(junk), len(junk))]
    cut = whole[:-5]
    found = list(warc.salvage(cut))
    assert keys(found) == list("01234") and gaps(found) == [(len(whole) - len(parts[-1]), len(parts[-1]) - 5)]
    lost = parts[0] + parts[1][:30] + parts[2] + parts[3][20:] + parts[4]
    found = list(warc.salvage(lost))
    assert keys(found) == ["0", "2", "4"] and gaps(found) == [(len(parts[0]), 30), (len(lost) - len(parts[4]) - len(parts[3]) + 20, len(parts[3]) - 20)]


def test_bad_record_inside_a_sound_member():
    plain = pieces(False)
    wrong = plain[1].replace(b"Content-Length: 0", b"Content-Length: 9", 1).replace(b"sha1:", b"sha1:AA", 1)
    member = warc.member_bytes(plain[0] + wrong + plain[3])
    found = list(warc.salvage(member + warc.member_bytes(plain[4])))
    assert keys(found) == ["0", "3", "4"] and gaps(found) == [(0, len(member))]


def test_foreign_headers():
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    chunked = (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Payload-Digest: sha1:OTHER\r\nContent-Length: 50"
               b"\r\n\r\nHTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nabc\r\n\r\n")
    found = list(warc.salvage(info + chunked))
    assert [(f.record.key, f.record.payload) for f in found] == [(None, b"abc")]
    assert [f.reason for f in warc.salvage(info.replace(b"Length: 2", b"Length: x"))] == ["no valid Content-Length"]
    assert [f.reason for f in warc.salvage(info.replace(b"warcinfo", b"\xff\xfe"))] == ["header is not UTF-8"]


ROWS = [(5, "http://a", "same"), (3, "http://b\r\nX: y", "same"), (3, None, "same"), (9, "u", "same"), (None, "n", "same"),
        (1, "e", None), (2, "e", ""), (4, "é", "é " * 20_000), (None, "z", "alone"), (None, "z", "alone"), (7, "q", "\r\n\r\nWARC/1.1\r\n")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, None) for r in rows],
                                 "key long, url string, html string, payload string, target int, first_key string").repartition(3)


def test_round_trip_through_files(spark, tmp_path):
    got = warc.through_archives(table(spark, ROWS), "key", "url", "html").collect()
    firsts = {"same": 3, "": 1}
    want = []
    for key, _, html in ROWS:
        body = (html or "").encode()
        first = firsts.get(html or "")
        first = first if first is not None and (key is None or key > first) else None
        want.append((key, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                     "response" if first is None else "revisit", first))
    have = [(r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert {r["url"] for r in got if r["key"] == 3} == {"http://b%0D%0AX: y", None}
    few = warc.through_archives(table(spark, ROWS), "key", "url", "html", min_revisit_bytes=1).collect()
    assert {r["key"]: r["record_type"] for r in few if r["key"] in (1, 2, 9)} == {1: "response", 2: "response", 9: "revisit"}
    assert warc.through_archives(table(spark, ROWS).limit(0), "key", "url", "html").collect() == []


def test_archives_are_bounded_and_salvaged_by_spark(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * 50) for i in range(60)]
    warc.write(table(spark, rows).coalesce(1), "key", "url", "html", str(tmp_path / "w"), archive_bytes=2000)
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) > 3 and all(f.stat().st_size < 2600 for f in files)
    first = bytearray(files[0].read_bytes())
    hit = first.find(warc.MEMBER, 1)
    first[hit + 40] ^= 255
    files[0].write_bytes(bytes(first))
    (tmp_path / "w" / f".{files[0].name}.crc").unlink()
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert len({r["record_key"] for r in got if r["gap_reason"] is None}) == 59
    gap, = [r for r in got if r["gap_reason"]]
    assert gap["offset"] == hit and gap["archive"].endswith(files[0].name)
    assert all(zlib.crc32(r["payload"]) == zlib.crc32(rows[int(r["record_key"])][2].encode()) for r in got if r["payload"])
