import base64
import hashlib
import random

import pyarrow as pa

from staylens.llm import warc


def b32(s):
    return base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()


def brute(pages, least=0):
    out = []
    for key, _, html in pages:
        body = html or ""
        same = [k for k, _, h in pages if (h or "") == body and k is not None]
        first = min(same) if same else None
        revisit = first is not None and key != first and len(body.encode()) >= least
        out.append((key, len(body.encode()), b32(body), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rng = random.Random(1)
    pages = [(i, f"http://h/{i}?q=é \r\nX: y", rng.choice([None, "", "a", "WARC/1.1\r\n\r\n", "é" * 50, "x" * 100_000, "\x1f\x8b\x08"])) for i in range(60)]
    pages += [(100, None, "only"), (101, "u", "twin"), (101, "u", "twin"), (102, "u", "twin"), (None, "u", "twin"), (None, "u", "alone")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted(map(tuple, warc.digest(frame).collect()), key=str) == brute(pages)
    least = warc.read_archives(warc.write_archives(frame, min_payload=2), with_payload=True).collect()
    assert sum(r["record_type"] == "revisit" for r in least) == sum(r[3] == "revisit" for r in brute(pages, 2))
    by_key = {str(k): h or "" for k, _, h in pages}
    assert all(bytes(r["payload"]).decode() == by_key[r["key"]] for r in least if r["record_type"] == "response" and r["key"])
    assert warc.digest(frame.limit(0)).count() == 0


def read(raw):
    records, gaps = [], []
    for offset, length, fields, block in warc.Archive(pa.BufferReader(raw)).records():
        (gaps if fields is None else records).append((offset, length) if fields is None else warc._key_of(fields["warc-record-id"]))
    return records, gaps


def sample(n, compress):
    rng = random.Random(3)
    out = [warc.record(str(i), "u", b := rng.randbytes(rng.randint(0, 4000)), base64.b32encode(hashlib.sha1(b).digest()).decode()) for i in range(n)]
    return [warc.member(x) if compress else x for x in out]


def test_salvage():
    rng = random.Random(4)
    for compress in (True, False):
        parts = sample(30, compress)
        assert read(b"".join(parts)) == ([str(i) for i in range(30)], [])
        starts = [sum(map(len, parts[:i])) for i in range(31)]
        for _ in range(40):
            raw = bytearray(b"".join(parts))
            bad = sorted(rng.sample(range(30), 3))
            for k in bad:                           # the body of a record
                at = starts[k + 1] - 1 - rng.randint(4, 7) if compress else starts[k] + rng.randint(0, 3)
                raw[at] ^= 1 + rng.randrange(255)
            records, gaps = read(bytes(raw))
            assert records == [str(i) for i in range(30) if i not in bad]
            covered = sum(n for _, n in gaps)
            assert covered == sum(len(parts[k]) for k in bad)
        cut = b"".join(parts)[:starts[20] + 10]
        assert read(cut)[0] == [str(i) for i in range(20)] and read(cut)[1] == [(starts[20], 10)]
        noise = rng.randbytes(1000)
        assert read(parts[0] + noise + parts[1])[0] == ["0", "1"]
        assert read(noise) == ([], [(0, 1000)]) and read(b"") == ([], [])
    mixed = sample(4, True)[:2] + sample(4, False)[2:]
    assert read(b"".join(mixed))[0] == list("0123")


def test_large_gap_is_scanned_in_chunks(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 64)
    parts = sample(6, True)
    raw = parts[0] + b"z" * 1000 + parts[1] + b"\x1f\x8b\x08" * 9 + parts[2]
    assert read(raw)[0] == ["0", "1", "2"]
    plain = sample(6, False)
    assert read(plain[0] + b"WARC/1.1 x" * 50 + plain[1])[0] == ["0", "1"]


def test_salvage_inside_members():
    plain = sample(12, False)
    keys = [str(i) for i in range(12)]
    bad = bytearray(plain[4])
    bad[-6] ^= 1
    for damaged in (bytes(bad), b"X" + plain[4][1:], plain[4][:-9]):
        raw = warc.member(b"".join([*plain[:4], damaged, *plain[5:]]))
        records, gaps = read(raw + warc.member(plain[0]))
        assert records == keys[:4] + keys[5:] + ["0"] and gaps == [(0, len(raw))]
        why = [b for _, _, f, b in warc.Archive(pa.BufferReader(raw)).records() if f is None]
        assert why[0].endswith(b" at inner offset %d" % sum(map(len, plain[:4])))
    first = warc.member(b"X" + b"".join(plain)[1:])
    assert read(first)[0] == keys[1:]
    whole = warc.member(b"".join(plain))
    records, gaps = read(whole[:len(whole) * 3 // 4])
    assert len(records) >= 5 and records == keys[:len(records)] and gaps
    crc = bytearray(whole)
    crc[-6] ^= 1
    assert read(bytes(crc) + warc.member(plain[3]))[0] == keys[:-1] + ["3"]
