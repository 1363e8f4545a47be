import random
import struct

import pytest

from locspark.llm.warc import DICTIONARY_MAGIC, archive_round_trip, dictionary_frame, digest, frames, parse, read_archives, record, write_archives

SCHEMA = "page_id long, url string, html string"


def pages():
    r = random.Random(2)
    body = ["<p>x</p>" * 20, "", None, "é" * 5000, "\r\n\r\nWARC/1.1\r\n", "a" * 200_000]
    out = [(i, f"http://h/{i}", r.choice(body) if r.random() < 0.5 else f"<html>{i} " + "text " * r.randint(0, 300)) for i in range(300)]
    return out + [(900, None, "same"), (900, None, "same"), (901, "http://h/\r\nWARC-Type: x", "odd"), (None, "u", "odd"), (None, "u", "alone")]


def test_round_trip(spark):
    data = pages()
    got = sorted(map(str, archive_round_trip(spark.createDataFrame([(*x, 1) for x in data], SCHEMA + ", bytes int")).collect()))
    largest = {}
    for i, _, h in data:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    want = []
    for i, _, h in data:
        raw, to = (h or "").encode(), largest.get(h or "")
        to = None if to == i else to
        want.append(f"Row(page_id={i}, payload_bytes={len(raw)}, payload_digest='{digest(raw)}', record_type='{'response' if to is None else 'revisit'}', refers_to={to})")
    assert got == sorted(want)


def test_archives_hold_one_frame_a_record(spark):
    df = spark.createDataFrame(pages(), SCHEMA)
    archives = write_archives(df, archive_bytes=20_000).collect()
    assert len(archives) > 3 and all(struct.unpack_from("<I", bytes(a.bytes))[0] == DICTIONARY_MAGIC for a in archives)
    assert sum(1 for a in archives for _ in frames(bytes(a.bytes))) == df.count()
    assert {r.record_type for r in read_archives(write_archives(df, min_revisit=1 << 30)).collect()} == {"response"}


def test_damage_is_found():
    good = record(5, "u", b"payload", None)
    assert parse(good) == (5, 7, digest(b"payload"), "response", None)
    for bad in (good[:-1], good.replace(b"payload\r", b"paylaod\r"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Type: response\r\n", b""), good.replace(b"Content-Length: 7", b"Content-Length: 8"), b""):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(ValueError):
        list(frames(dictionary_frame(b"") + b"no frame at all"))


def test_empty(spark):
    assert archive_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
