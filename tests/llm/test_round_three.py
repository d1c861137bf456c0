"""Operators 11 to 13 against plain versions."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from segloom.llm import importance_resampling as I
from segloom.llm import subvector_centroids as C
from segloom.llm import warc_archive as A
from segloom.llm.common import shared_folder


def plain_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds if kept else 0):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for j, g in groups.items():
            centroids[j] = [sum(x) // len(g) for x in zip(*g)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    sums = collections.Counter()
    for _, j, d in last:
        sums[j] += d
    return sorted((str(i), j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in last)


@pytest.mark.parametrize("block, chunk", [(4, 16), (7, 1000), (64, 3)])
def test_clusters(spark, block, chunk):
    """Odd rows, copies and ties; any size of blocks and chunks."""
    rng = random.Random(block)
    rows = [(i, [rng.choice((-1.5, 0.0, 0.25, 2.0)) + rng.random() * (i % 3) for _ in range(64)]) for i in range(120)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [rows[3], rows[3]] + [(None, rows[5][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [None] + [1.0] * 63), (2005, [float("nan")] * 64), (2006, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, label string, cluster int").repartition(3)
    got = C.cluster_vectors(df, block=block, chunk=chunk).collect()
    assert sorted((str(r.vec_id), *r[1:]) for r in got) == plain_clusters(rows)


def test_few_and_far_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    assert C.cluster_vectors(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, [0.0] * 64), (2, [1.0] * 64)]
    assert sorted((str(r.vec_id), *r[1:]) for r in C.cluster_vectors(spark.createDataFrame(rows, kind)).collect()) == plain_clusters(rows)
    far = [(i, [x] + [0.0] * 63) for i, x in enumerate([1e300, -1e300, 3e5, 2e5, 1.0])]
    got = {r.vec_id: r for r in C.cluster_vectors(spark.createDataFrame(far, kind), k=1, rounds=0).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and max(r.distance for r in got.values()) == C.TOP


WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def plain_resampling(docs, target, buckets=10_000):
    def feats(text):
        w = WORD.findall((text or "").encode().translate(LOWER))
        return len(w), [zlib.crc32(x) % buckets for x in (*w, *(a + b" " + b for a, b in zip(w, w[1:])))]

    own, other = [(i, *feats(t)) for i, t in docs], [feats(t)[1] for t in target]
    s, t = collections.Counter(b for _, _, f in own for b in f), collections.Counter(b for f in other for b in f)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = [(*r[:1], *r[2:], k) for k, r in enumerate(able[: 25 * len(able) // 100], 1)]
    left = able[25 * len(able) // 100 :] + [r for r in rows if r[1] < 20]
    return sorted(map(str, [*drawn, *((r[0], *r[2:], None) for r in left)]))


def test_resampling_of_the_tables(spark, sf):
    from segloom.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(str(tuple(r)) for r in QUERIES["op12_importance_resampling"](spark, sf).collect()) == plain_resampling(docs, target)


@pytest.mark.parametrize("words, pairs, piece", [(0, 0, 1 << 22), (3, 1, 40), (20_000, 1 << 16, 7)])
def test_resampling_of_odd_rows(spark, monkeypatch, words, pairs, piece):
    """Whatever the head holds and wherever long texts are cut; nulls, ties, repeated rows, no word and very long words."""
    for name, value in (("HEAD_WORDS", words), ("HEAD_PAIRS", pairs), ("PIECE", piece), ("BLOCK", 50)):
        monkeypatch.setattr(I, name, value)
    rng = random.Random(1)
    pool = ["a", "the", "Zwölf", "ÄB", "x9", "naïve", "мир", "q" * 300, "of"]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(60)]
    docs += [(None, docs[5][1]), (None, docs[5][1]), (7, docs[7][1]), (7, docs[8][1]), (100, None), (101, ""), (102, " .,- \x00"), (103, "the, of;the\tof " * 40)]
    target = ["the of the of", None, "", "мир"]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank long, bucket int").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    # The monkeypatched sizes are read on the driver only, so tasks get them through functions.
    head = I.head_of(df.unionByName(goal, allowMissingColumns=True).select("text"), shared_folder(spark, "head"))
    assert len(head.index) <= words and len(head.keys) <= pairs
    assert sorted(str(tuple(r)) for r in I.importance_resample(df, goal).collect()) == plain_resampling(docs, target)
    assert I.importance_resample(df.limit(0), goal).collect() == []
    assert sorted(str(tuple(r)) for r in I.importance_resample(df, goal.limit(0)).collect()) == plain_resampling(docs, [])


def test_texts_in_pieces(monkeypatch):
    text = ("alpha beta, gamma " * 50 + "w" * 100 + " end").encode()
    whole = I.Head([b"alpha"], [(b"beta", b"gamma")], 10_000).of_texts([text, b"", text])
    monkeypatch.setattr(I, "PIECE", 30)
    monkeypatch.setattr(I.pieces, "__defaults__", (30,))
    cut = I.Head([], [], 10_000).of_texts([text, b"", text])
    assert [(n, sorted(x.tolist())) for n, x in whole] == [(n, sorted(x.tolist())) for n, x in cut]


def archive(spark, rows, least=0, parts=3, **sizes):
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, sha string").repartition(parts, "url", "html")
    manifest = A.write_warc(df, shared_folder(spark, "warc"), least, **sizes)
    return manifest, A.read_warc(manifest, payloads=True).collect()


def test_archives(spark):
    """Copies, ties, nulls and long pages; the same files however the rows are dealt."""
    rng = random.Random(2)
    rows = [(i * 7 - 300, f"http://h/{i}", f"<p>{rng.choice('abc')}{'é' * rng.randrange(3)}</p>" if i % 3 else f"<p>{i}</p>" + "x" * i) for i in range(100)]
    rows += [(5000, "http://long", "<b>long</b>" * 50_000), (6000, None, None), (6001, "", ""), (6002, "http://a b\r\nX: y/ü", "odd")]
    rows += [rows[3]] * 3 + [(None, "n1", "<p>none</p>"), (None, "n2", "<p>none</p>"), (None, "n3", rows[10][2]), (-(2**63), "low", "low"), (2**63 - 1, "high", "<p>aé</p>")]
    for least in (0, 9):
        first = {}
        for i, _, h in rows:
            first[h or ""] = min(first.get(h or "", (True, 0)), (i is None, i or 0))
        want, seen = collections.Counter(), set()
        for i, _, h in rows:
            h = h or ""
            digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
            again = len(h.encode()) >= least and ((i is None, i or 0) != first[h] or h in seen)
            if (i is None, i or 0) == first[h]:
                seen.add(h)
            want[i, len(h.encode()), digest, "revisit" if again else "response", None if not again or first[h][0] else first[h][1]] += 1
        names = []
        for parts in (1, 5):
            manifest, got = archive(spark, rows, least, parts, shard_bytes=2000, roll_bytes=1500)
            assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
            assert len({r.record_id for r in got}) == len(got)
            kept = {r.payload_digest: r.payload for r in got if r.record_type == "response"}
            assert set(kept.values()) == {h or "" for _, _, h in rows}
            files = manifest.orderBy("path").collect()
            assert len(files) > 10 and sum(f.records for f in files) == len(rows)
            names.append([(f.path.rsplit("/", 1)[1], f.records, f.first_id, f.last_id, f.n_bytes, f.sha256) for f in files])
        assert names[0] == names[1]
        ids = [f[2:4] for f in names[0]]
        assert all(a is not None and b is not None and a <= b for a, b in ids[2:]) or None in sum(ids[:3], ())


def test_archive_of_nothing(spark):
    manifest, got = archive(spark, [])
    assert got == [] and manifest.count() == 0


def test_archives_roll_and_leave_no_temporary_files(spark):
    import os

    import pyarrow.fs as pafs

    rows = [(i, f"u{i}", hashlib.sha256(str(i).encode()).hexdigest() * 20) for i in range(200)]
    manifest, got = archive(spark, rows, roll_bytes=3000)
    files = manifest.collect()
    assert len({f.shard for f in files}) == 1 and len(files) > 5 and len(got) == 200
    system, folder = pafs.FileSystem.from_uri(os.path.dirname(files[0].path))
    names = [f.path for f in system.get_file_info(pafs.FileSelector(folder))]
    assert not [n for n in names if n.endswith(".tmp")]
    import gzip

    for f in files:  # any gzip reader sees the records
        data = gzip.decompress(system.open_input_file(pafs.FileSystem.from_uri(f.path)[1]).read())
        assert data.count(b"WARC/1.1\r\n") == f.records and hashlib.sha256(system.open_input_file(pafs.FileSystem.from_uri(f.path)[1]).read()).hexdigest() == f.sha256


def test_damaged_records_are_found():
    data = A.record(1, "u", b"payload", None, "0", "1970-01-01T00:00:00Z")
    assert A.parsed(data)["payload"] == "payload"
    with pytest.raises(ValueError):
        A.parsed(data.replace(b"payload", b"pAyload"))
    with pytest.raises(EOFError):
        import io

        list(A.members(io.BytesIO(A.member(data)[:-5])))


def test_distances_by_code():
    rng = np.random.default_rng(0)
    x = rng.integers(-3000, 3000, (50, 64))
    x[10:30] = x[3]
    row = dict(zip(("ids", "kind", "code_kind", "dictionaries", "codes"), C.encoded(list(range(50)), x, 4)))
    c = C.Chunk(row, 64, 4)
    centroids = rng.integers(-3000, 3000, (5, 64))
    assert (c.distances(centroids) == ((x[:, None] - centroids[None]) ** 2).sum(axis=2)).all()
    assert all(len(words) <= 31 for _, words, _ in c.blocks)
