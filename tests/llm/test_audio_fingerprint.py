import random
import tracemalloc

import numpy as np

from locspark.llm import audio_fingerprint as A


def tones(seed, seconds=1.0, start=0):
    """A melody of random notes, as 8-bit samples."""
    r = np.random.default_rng(seed)
    out = [np.sin(2 * np.pi * r.uniform(150, 2000) * np.arange(700) / A.RATE) for _ in range(int(seconds * A.RATE / 700) + 1)]
    return np.clip(np.concatenate(out)[start:] * 100 + 128, 0, 255).astype(np.uint8).tobytes()


def brute(prints, queries):
    """Pairs with an offset at which the integers agree as the operator asks, over all offsets."""
    out = set()
    for q in queries:
        for d, p in prints.items():
            for offset in range(-len(prints[q]) + 1, len(p)) if d != q and not np.array_equal(p, prints[q]) else ():
                a, z = max(0, offset), min(len(p), len(prints[q]) + offset)
                same = np.flatnonzero(p[a:z] == prints[q][a - offset : z - offset]) + a
                if len(same) >= A.LEAST_VOTES and same[-1] - same[0] + 1 >= A.LEAST_RUN:
                    lo, hi = same[0], same[-1] + 1
                    if np.bitwise_count(p[lo:hi] ^ prints[q][lo - offset : hi - offset]).mean() / 32 <= A.MOST_ERRORS:
                        out.add((d, q))
    return out


def test_all_pairs_of_brute_force(spark):
    r = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    data = {x.doc_id + 1: x.text.encode() for x in docs}
    for i in range(8):
        data[100 * (50 + i)] = tones(i)
        clean = np.frombuffer(tones(i, start=r.choice([0, 64 * 7, 64 * 20])), np.uint8).astype(int)
        data[9000 + i] = np.clip(clean + np.random.default_rng(i).integers(-1, 2, len(clean)), 0, 255).astype(np.uint8).tobytes()
        data[9100 + i] = tones(i, start=64 * 9)
    df = spark.createDataFrame(list(data.items()), "doc_id long, text binary")
    prints = {i: A.fingerprint(A.bytes_as_audio(x)) for i, x in data.items()}
    queries = [i for i in data if i % 100 == 0 and len(prints[i])]
    names = {}
    for i in sorted(prints):
        names.setdefault(prints[i].tobytes(), i)
    want = {(names[prints[d].tobytes()], names[prints[q].tobytes()]) for d, q in brute(prints, queries)}
    for windows in (A.QUERY_WINDOWS, 300):
        rows = A.align_recordings(df, query_windows=windows).collect()
        got = {(x.doc_id, x.query_id) for x in rows if x.query_id is not None}
        assert got == want and len(want) >= 8
        assert {x.doc_id: x.class_id for x in rows if x.query_id is None} == {i: names[p.tobytes()] if len(p) else None for i, p in prints.items()}
    shifted = {x.doc_id: x.offset for x in rows if x.query_id == 5000}
    assert shifted[9100] == -9


def test_edge_cases(spark):
    schema = "doc_id long, text string, digest int"
    rows = A.align_recordings(spark.createDataFrame([(None, "w" * 5000, 0), (7, "w" * 5000, 0), (7, "w" * 5000, 0), (100, None, 0), (200, "", 0), (300, "x" * 200, 0)], schema)).collect()
    assert len(rows) == 6 and sorted(x.class_id or 0 for x in rows) == [0, 0, 0, 7, 7, 7]
    assert A.align_recordings(spark.createDataFrame([], schema)).collect() == []


def test_short_recordings(spark):
    text = lambda seed, n: np.random.default_rng(seed).integers(97, 123, n).astype(np.uint8).tobytes()
    long, late = text(1, 5000), text(2, 5000)
    data = {
        100: text(3, 700), 101: text(3, 700), 102: text(3, 700)[:-60] + text(4, 60),  # a query, a copy, a near copy
        200: long[1600:2000], 201: long,  # a short query within a long recording
        300: late, 301: late[800:1200],  # and the other way about
        400: text(5, 340), 401: text(5, 340) + text(6, 60),  # three windows
        500: text(7, 1500), 501: text(8, 100), 502: text(8, 100), 503: text(9, 100), 504: b"",
    }
    df = spark.createDataFrame(list(data.items()), "doc_id long, text binary")
    for windows in (A.QUERY_WINDOWS, 100):
        rows = A.align_recordings(df, query_windows=windows).collect()
        assert {(x.doc_id, x.query_id, x.offset) for x in rows if x.query_id is not None} == {(102, 100, 0), (201, 200, 100), (301, 300, -50), (401, 400, 0)}
        own = {x.doc_id: x for x in rows if x.query_id is None}
        assert {i: x.class_id for i, x in own.items()} == {i: None if i > 500 else 100 if i == 101 else i for i in data}
        assert {i: x.group_id for i, x in own.items()} == {i: {101: 100, 502: 501, 504: None}.get(i, i) for i in data}


def test_votes_of_runs_are_those_of_windows(monkeypatch):
    r = np.random.default_rng(3)
    for hits in (A.HITS, 7):
        monkeypatch.setattr(A, "HITS", hits)
        for _ in range(40):
            prints = [(10 + k, np.repeat(r.integers(0, 4, n), r.integers(1, 5, n)).astype(np.uint32)) for k, n in enumerate(r.integers(1, 12, 3))]
            own = np.repeat(r.integers(0, 4, 9), r.integers(1, 5, 9)).astype(np.uint32)
            places = {}
            for q, (_, p) in enumerate(prints):
                for i, j in zip(*np.nonzero(own[:, None] == p[None, :])):
                    places.setdefault(q << 32 | int(i - j + (1 << 31)), []).append(int(i))
            got = A.Queries([(i, p.tobytes()) for i, p in prints]).votes(own)
            assert dict(zip(got.key.tolist(), zip(got.votes.tolist(), got.first.tolist(), got.last.tolist()))) == {k: (len(x), min(x), max(x)) for k, x in places.items()}


def test_offset_with_fewer_votes_that_passes(monkeypatch):
    monkeypatch.setattr(A, "MOST_ERRORS", 0.0)
    query = np.arange(1, 41, dtype=np.uint32)
    own = np.concatenate((query[:20], query[:20] + np.uint32(1 << 20), query))
    own[20:40:2] = query[20:40:2]  # offset 0 has most votes, and errors; only at 40 does all fit
    own[40:48] = 0
    ((_, offset, run, wrong),) = A.Queries([(1, query.tobytes())]).matches(own)
    assert (offset, run, wrong) == (40, 32, 0)


def test_long_constant_recording_takes_little_memory():
    p = A.fine_fingerprint(A.bytes_as_audio(b"a" * 1_000_000))
    tracemalloc.start()
    found = A.Queries([(1, p.tobytes())]).matches(p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(1, 0, len(p), 0.0)] and peak < 100 << 20
