import gzip
import hashlib
import io
import json
import os
import tracemalloc
import zlib

import pytest

from ridelens.llm import warc as W
from ridelens.llm.common import scratch

LONG = "<p>" + "lorem é 🙂 " * 20_000
SAME = "x" * 150
PAGES = [(1, "http://a/1", SAME), (2, "http://a/2", SAME), (3, None, SAME), (None, "http://a/n", SAME),
         (4, "http://a/4 b\n", "short"), (5, "http://a/5", "short"), (6, "http://a/6", None), (7, "u", ""),
         (8, "u", LONG), (9, "u", LONG), (10, "u", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9),
         (11, "u", "é" * 50), (12, "u", "é" * 50), (13, "u", "y" * 99), (14, "u", "y" * 99), (1, "http://a/1", SAME),
         (2, "http://b/2", "another page under the same id" * 9), (None, None, "z" * 200), (None, None, "z" * 200)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", "p", 1) for r in rows],
                                 "page_id long, url string, html string, digest string, payload string, `a.b` int")


def expected(rows):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == payload and j is not None]
        first = min(same, default=None) if len(payload) >= 100 else None
        refers = first if first is not None and first != i else None
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(),
                    "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def archived(spark, rows, **how):
    whole, members = scratch(spark, "whole"), scratch(spark, "members")
    archives = W.write_pages(W.with_revisits(frame(spark, rows).repartition(3)), whole, **how)
    return whole, members, archives, W.normalise(archives, whole, members)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_round_trip_of_odd_pages(spark):
    whole, members, archives, normalised = archived(spark, PAGES)
    got = W.read_records(normalised, members, payloads=True).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == expected(PAGES)
    for r in got:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        if r["payload"] is not None:
            assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]
    ids = {(r["page_id"], r["payload_digest"]): r["record_id"] for r in got}
    for r in got:
        if r["refers_to"] is not None:
            assert r["refers_to_id"] == ids[r["refers_to"], r["payload_digest"]]
    assert {r["target_uri"] for r in got} >= {"http://a/4%20b%0A", "urn:unknown"}


def test_archives_are_one_stream_and_become_members(spark):
    whole, members, archives, normalised = archived(spark, PAGES, archive_bytes=2000)
    before, after = archives.collect(), normalised.collect()
    assert len(before) == len(after) > 3
    assert sum(r["n_records"] for r in before) == sum(r["n_records"] for r in after) == len(PAGES)
    for r in before:
        with open(f"{whole}/{r['name']}", "rb") as f:
            one = zlib.decompressobj(31)
            text = one.decompress(f.read())
        assert one.eof and not one.unused_data and len(text) == r["n_bytes"]
        new = next(a["name"] for a in after if a["name"].startswith(r["name"].removesuffix(".warc.gz")))
        with open(f"{members}/{new}", "rb") as f:
            packed = f.read()
        places = [json.loads(x) for x in open(f"{members}/{new}.idx")]
        assert len(places) == r["n_records"] and sum(p["length"] for p in places) == len(packed)
        pieces = [zlib.decompress(packed[p["offset"]:p["offset"] + p["length"]], 31) for p in places]
        assert b"".join(pieces) == text == gzip.decompress(packed)
        assert all(p.startswith(b"WARC/1.1\r\n") for p in pieces)


def test_empty_table(spark):
    _, members, archives, normalised = archived(spark, [])
    assert archives.count() == normalised.count() == 0
    assert W.read_records(normalised, members).collect() == []


FOREIGN = (b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: 7\r\n\r\na: b\r\n\n\r\n\r\n"
           b"\r\nWARC/1.0\r\nwarc-type: resource\r\nWARC-Target-URI: http://x/\r\n  folded\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
           b"WARC/1.1\nWARC-Type: conversion\nContent-Type: text/plain\nContent-Length: 3\n\nabc\r\n\r\n")


@pytest.mark.parametrize("pack", [gzip.compress, lambda b: gzip.compress(b[:150]) + gzip.compress(b[150:])])
def test_archives_of_other_writers(spark, pack):
    source, target = scratch(spark, "foreign"), scratch(spark, "members")
    os.makedirs(source)
    with open(f"{source}/f.warc.gz", "wb") as f:
        f.write(pack(FOREIGN))
    done = W.normalise(spark.createDataFrame([("f.warc.gz",)], "name string"), source, target)
    got = W.read_records(done, target, payloads=True).orderBy("offset").collect()
    assert [(r["record_type"], r["target_uri"], bytes(r["payload"])) for r in got] == [
        ("warcinfo", None, b"a: b\r\n\n"), ("resource", "http://x/ folded", b""), ("conversion", None, b"abc")]


@pytest.mark.parametrize("broken", [gzip.compress(FOREIGN)[:-20], gzip.compress(FOREIGN[:-6]),
                                    gzip.compress(b"no archive"), b"no gzip"])
def test_damaged_archives_are_errors(broken):
    with pytest.raises((EOFError, ValueError, OSError, zlib.error)):
        W.normalise_stream(gzip.GzipFile(fileobj=io.BytesIO(broken)), io.BytesIO(), io.BytesIO())


def test_damaged_archive_is_named(spark):
    source = scratch(spark, "foreign")
    os.makedirs(source)
    with open(f"{source}/bad.warc.gz", "wb") as f:
        f.write(gzip.compress(FOREIGN)[:-20])
    with pytest.raises(Exception, match="bad.warc.gz"):
        W.normalise(spark.createDataFrame([("bad.warc.gz",)], "name string"), source, scratch(spark, "members"))


def test_normalising_holds_a_buffer_only(tmp_path):
    size, path = 60 << 20, tmp_path / "big.gz"
    with gzip.open(path, "wb", 1) as f:
        f.write(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % size)
        for _ in range(60):
            f.write(bytes(1 << 20))
        f.write(W.END)
    tracemalloc.start()
    with open(path, "rb") as f, open(tmp_path / "out", "wb") as out:
        assert W.normalise_stream(gzip.GzipFile(fileobj=f), out, io.BytesIO())[0] == 1
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_session_options_are_restored(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    archived(spark, PAGES[:2])
    assert spark.conf.get(key, None) == before


def test_query_equals_sql(same_as_sql):
    same_as_sql("op13_warc")
