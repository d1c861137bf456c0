"""Results that small cases of the training-data operators would miss."""


def test_licenses_without_a_word_and_close_together():
    from segloom.llm.patience_licenses import TEMPLATES, Scanner, words

    scan = Scanner({"mit-line": TEMPLATES["mit-line"]}, 0.8, 0.6).scan
    filler = " ".join(f"w{i}" for i in range(40))
    lacks = words(f"{filler} Released under the MIT terms. {filler} license".encode())
    assert [(f[1], f[2], f[3]) for f in scan(lacks)] == [(40, 44, 0.8)]
    twice = words(f"{filler} {TEMPLATES['mit-line']} {TEMPLATES['mit-line']} {filler}".encode())
    assert [(f[1], f[2], f[3]) for f in scan(twice)] == [(40, 45, 1.0), (45, 50, 1.0)]


def test_items_of_two_blocks_count_once(spark):
    from segloom.llm.winnow import decontaminate

    one, two = (" ".join(f"{k}{i}" for i in range(20)) for k in "ab")
    docs = spark.createDataFrame([(1, f"{one} and {two}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, one), (7, two)], "item_id long, text string")
    got = {n: [(r.n_items, r.items, r.n_hit) for r in decontaminate(docs, items, block_words=n).collect()] for n in (1, 1000)}
    assert got[1] == got[1000] == [(1, ["7"], 40)]


def test_repeats_of_the_tables(spark, sf):
    """The query over a table's whole texts: n_bytes is the length before anything is removed, what was removed stands in the columns after it."""
    from test_operators import removed_by_brute_force

    from segloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op2_suffix_repeats"](spark, sf)
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = {r.doc_id: tuple(r)[1:5] for r in got.collect()}
    assert rows == dict(zip((d.doc_id for d in docs), removed_by_brute_force([d.text for d in docs], 400)))
    assert all(rows[d.doc_id][0] == len((d.text or "").encode()) for d in docs)
    assert 0 < sum(r[1] > 0 for r in rows.values()) < len(rows)
