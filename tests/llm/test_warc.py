"""Round trips and reachability."""

import base64
import hashlib
import random
import time

from strandline.llm import warc

TRAP = "x WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"


def pages():
    out = [(k, f"http://h/{k}", f"<p>{k % 40} é</p>\r\n\r\n" * (k % 5 + 1)) for k in range(120)]
    out += [(500, "u", None), (501, None, ""), (502, "u\r\nWARC/1.0", TRAP), (503, "u", TRAP + TRAP), (504, "u", "WARC/1.0\r\nContent-Length: 999999999\r\n\r\n"), (505, "u", TRAP)]
    return out + [(None, "n", "only null ids"), (None, "n", "<p>1 é</p>\r\n\r\n" * 2), (7, "http://h/7", out[7][2]), (506, "u", "y" * 300000)]


def test_round_trip(spark):
    rows = pages()
    p = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(p).collect()), key=str)
    largest = {}
    for i, _, h in rows:
        h = h or ""
        largest[h] = max([x for x in (largest.get(h), i) if x is not None], default=None)
    want = []
    for i, _, h in rows:
        h = h or ""
        first = largest[h]
        kind = "response" if i == first else "revisit"
        want.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), kind, None if kind == "response" else first))
    assert got == sorted(want, key=str)


def test_candidates_inside_payloads_are_not_reached(spark, tmp_path):
    p = spark.createDataFrame([(1, "u", TRAP), (2, "u", TRAP * 2)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(p, str(tmp_path / "w"))
    found = warc.candidates(spark, str(tmp_path / "w"))
    assert found.count() > 2
    assert sorted(r.page_id for r in warc.read_archives(spark, str(tmp_path / "w")).collect()) == [1, 2]


def test_threshold_and_empty_table(spark):
    p = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.round_trip(p, least=4).collect()} == {"response"}
    assert warc.round_trip(p.where("false")).count() == 0


def test_plain_archives_are_read_from_their_start_under_small_splits(spark, tmp_path):
    p = spark.createDataFrame([(k, "u", f"<p>{k}</p>" * (k % 30) + (TRAP if k % 50 == 0 else "")) for k in range(700)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "plain")
    warc.records(p).write.option("lineSep", "\r\n\r\n").text(path)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in before:
            spark.conf.set(c, "4096")
        found = warc.candidates(spark, path)
        places = found.select("file", "offset").collect()
        got = warc.read_archives(spark, path).select("page_id", "payload_bytes").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(places) == len(set(places)) > 700
    size = lambda k: len(f"<p>{k}</p>" * (k % 30) + (TRAP if k % 50 == 0 else ""))
    assert sorted(map(tuple, got)) == [(k, size(k)) for k in range(700)]


def candidates_by_search(data: bytes) -> dict:
    """Offset and successor of each magic, from a search for its header's end."""
    magic, out, at = warc.MAGIC.encode(), {}, data.find(warc.MAGIC.encode())
    while at >= 0:
        head, found, _ = data[at + len(magic) :].partition(b"\r\n\r\n")
        length = [x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.partition(b":")[0].strip().lower() == b"content-length"]
        if found and len(head) <= warc.HEADER_BYTES and length and length[-1].isdigit() and len(length[-1]) <= 18:
            out[at] = at + len(magic) + len(head) + 4 + int(length[-1]) + 4
        at = data.find(magic, at + len(magic))
    return out


def test_one_pass_finds_the_candidates_of_a_search(monkeypatch):
    monkeypatch.setattr(warc, "HEADER_BYTES", 60)
    rng = random.Random(8)
    bits = ["WARC/1.0\r\n", "\r\n", "\r\n\r\n", "Content-Length: 7\r\n", "content-length:3", "WARC-Type: response\r\n", "x" * 13, "W", "WARC/1.", ": ", "Content-Length: no\r\n"]
    for _ in range(3000):
        data = ("WARC/1.0\r\n" * rng.randint(0, 1) + "".join(rng.choices(bits, k=rng.randint(0, 25)))).encode()
        before, *segs = data.split(warc.MAGIC.encode())
        own = warc.Archive("f", len(before))
        rows = [r for seg in segs for r in own.add(seg)]
        if own.block is not None:
            rows.append([*own.block.row, None, None])
        assert {r[1]: r[2] for r in rows} == candidates_by_search(data), data
        assert len(rows) == len({r[1] for r in rows})
        # whatever a walk from the start reaches, and the file holds, has the digest of its bytes
        found, at = {r[1]: r for r in rows}, 0
        while at in found and found[at][2] - 4 <= len(data):
            r = found[at]
            head = data.find(b"\r\n\r\n", at + len(warc.MAGIC)) + 4
            block = data[head : r[2] - 4]
            payload = block.partition(b"\r\n\r\n")[2] if b"\r\n\r\n" in block else block
            assert r[7:] == [len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()]
            at = r[2]


def test_false_magics_take_linear_time(spark, tmp_path):
    """Every false record claims a block far beyond the file, or none at all; the archive is one record."""
    huge = "WARC/1.0\r\nContent-Length: 99999999999\r\n\r\n"

    def seconds(n):
        payload = huge * n + "WARC/1.0\r\n" * n
        own = warc.Archive("f", 0)
        head = f"Content-Length: {len(payload)}\r\n\r\n"
        start = time.thread_time()
        rows = [r for seg in (head + payload).split(warc.MAGIC) for r in own.add(seg.encode())]
        took = time.thread_time() - start
        assert len(rows) == n + 1 and sum(r[8] is not None for r in rows) == 1
        return took

    assert seconds(80_000) < 3 * (4 * seconds(20_000) + 0.2)
    p = spark.createDataFrame([(1, "u", huge * 20_000), (2, "u", "after")], "page_id long, url string, html string").coalesce(1)
    assert [(r.page_id, r.payload_bytes) for r in sorted(warc.round_trip(p).collect())] == [(1, len(huge) * 20_000), (2, 5)]
