"""The registered queries against their SQL, and the pipeline's stages against brute force."""

import collections
import math
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from test_operators import grouped_by_brute_force, hits_by_brute_force

from segloom.fixtures import TABLES
from segloom.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want, got = con.sql(Q.ORACLE_SQL[name]).df(), Q.QUERIES[name](spark, sf).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(str([None if pd.isna(x) else int(x) if isinstance(x, (float, np.floating)) and x == int(x) else x for x in r]) for r in f[columns].astype(object).itertuples(index=False, name=None))  # noqa: E731  nulls make floats of integers
    assert rows(got) == rows(want)


def plain_quality(model, text):
    """The score by averaging over every feature of the text, one at a time."""
    parts, bias = model
    words, total, n = (text or "").encode().split(), 0.0, 0
    for w in words:
        w = b"<" + w + b">"
        for f in [w, *(w[i : i + k] for k in (3, 4) for i in range(len(w) - k + 1))]:
            total, n = total + parts[zlib.crc32(f) % 2**15], n + 1
    logit = bias
    if n:
        again = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        seen = 1 - len(set(words)) / len(words)
        logit += total / n + parts[2**15] * again + parts[2**15 + 1] * seen
    return 1 / (1 + math.exp(-logit))


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P
    import public_tokenizers
    from tokenizers import Tokenizer

    from segloom.llm.common import written
    from segloom.llm.subword_quality import fit
    from segloom.llm.temperature_mixing import plan

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf), name)
        kept[name] = before.collect(), docs.collect()
        assert docs.columns == columns
        if name != "mixing":  # a stage that filters changes no row
            assert not set(kept[name][1]) - set(kept[name][0])
    ids = lambda rows: sorted(r.doc_id for r in rows)

    before, after = kept["quality"]
    held = {r.doc_id for r in before if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    rows = labels.filter(~labels["doc_id"].isin(list(held))).selectExpr("doc_id", "quality as label")
    model = fit(spark.read.parquet(f"{sf}/documents.parquet"), rows)
    scores = {r.doc_id: plain_quality(model, r.text) for r in before}
    assert all((scores[r.doc_id] >= 0.5) == (r in after) for r in before if abs(scores[r.doc_id] - 0.5) > 1e-6)

    before, after = kept["near_duplicates"]
    groups = grouped_by_brute_force([r.doc_id for r in before], [r.text for r in before], 80)
    assert ids(after) == sorted({least for _, least in groups.values()})

    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {r.doc_id: hits_by_brute_force(r.text, items, 13) for r in before}
    assert ids(after) == sorted(i for i, (n, hit, _) in found.items() if not (hit and 20 * hit >= n))

    before, after = kept["mixing"]
    count = lambda r: len((r.text or "").encode().split())
    totals, got = collections.Counter(), collections.Counter()
    for r in before:
        totals[r.source] += count(r)
    for r in after:
        got[r.source] += count(r)
    weights = {}
    for source, total, weight, take, full, _, _ in plan(dict(totals)):
        longest = max(count(r) for r in before if r.source == source)
        assert take - longest <= got[source] <= take
        times = collections.Counter(r.doc_id for r in after if r.source == source)
        assert all(full <= times[r.doc_id] <= full + 1 for r in before if r.source == source)
        weights[source] = weight
    # The order of the mixture: up to any place each source has about its share of what is taken of it.
    done = collections.Counter()
    for r in after:
        done[r.source] += count(r)
        for s in weights:
            assert abs(done[s] / got[s] - done[r.source] / got[r.source]) <= max(count(x) for x in before) * (1 / got[s] + 1 / got[r.source]) + 0.05

    tokens = sorted(P.STAGES[-1][1](spark, docs, sf).collect(), key=lambda r: r.start)
    tok, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    assert len(tokens) == len(after)
    for r, d in zip(tokens, after):  # in the order of the files
        want = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


CLASHES = ("score", "n_hit", "items", "n_words", "n_items", "spans", "n_tokens", "epoch", "block", "pos", "mix_at", "kept", "key", "digest", "part", "path", "at", "_row", "_others", "_id", "_digest", "_rest", "_uid", "a.b", "label")


def test_pipeline_stages_on_hard_rows(spark, sf):
    """Null and repeated doc_ids, null and empty texts, repeated rows and columns that have the stages' own names."""
    import corpus_pipeline as P

    prose = " ".join(f"word{i % 37}" for i in range(60))
    other = " ".join(f"thing{i % 41}" for i in range(60))
    rows = [(None, prose, "s"), (None, prose, "s"), (3, prose, None), (3, other, "s"), (3, other, "s"), (4, None, "s"), (5, "", "t"), (None, None, None), (6, other + " x", "t")]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in CLASHES)
    docs = spark.createDataFrame([(*r, *[-5] * len(CLASHES)) for r in rows], schema)
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        assert all(set(r[3:]) == {-5} for r in got.collect()), name
        assert stage(spark, docs.limit(0), sf).count() == 0
    left = P.without_near_copies(spark, docs, sf).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(3, prose), (3, other), (4, None), (5, ""), (None, None)], key=str)
    assert P.token_files(spark, docs, sf).count() == len(rows)
    assert P.token_files(spark, docs.limit(0), sf).count() == 0
