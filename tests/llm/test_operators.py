"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, key string, _row long, a int, l int"


def docs_of(spark, texts, ids=None, sources=None):
    ids = range(len(texts)) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    rows = [(i, t, "en", s, 0, 1.0, True, "k", 7, 1, 2) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, 60 + 10 * i) for i in range(12)]
    near = [" ".join(w if i != 40 else "changed" for i, w in enumerate(b.split(" "))) for b in base[4:8]]
    passage = prose(rng, 90)
    return [*base, *near, base[0], base[0], None, "", "  \n ", "one two", "ONE two", "x" * 3000, "ab " * 700, passage + " " + prose(rng, 50), prose(rng, 50) + "\n" + passage, "é ü 漢字 \U0001f600 " * 30]


# 1. Token files.


def test_token_files(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from segloom.llm.common import shared_folder
    from segloom.llm.token_files import TokenFile, read_digests, write_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = docs_of(spark, texts, [None, *range(100, 99 + len(texts))])
    index = write_tokens(docs, shared_folder(spark, "t"), path, seq_len=16)
    got = sorted(read_digests(index).collect(), key=lambda r: r.start)
    tok, at = Tokenizer.from_file(path), 0
    for r, t in zip(got, texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert [r.doc_id for r in got] == [None, *range(100, 99 + len(texts))]
    first = min(index.collect(), key=lambda r: (r.shard, r.offset))
    ids, mask = TokenFile(first.path).sequence(0)
    assert len(ids) == 16 and np.unpackbits(mask, bitorder="little").tolist() == [1] * 16
    assert not ids.flags.owndata and not mask.flags.owndata
    shard = TokenFile(first.path)
    total = sum(r.n_tokens for r in index.collect() if r.shard == first.shard)
    _, mask = shard.sequence((total - 1) // 16)
    assert np.unpackbits(mask, bitorder="little").sum() == (total - 1) % 16 + 1


def test_pieces_are_whole_pretokens():
    import public_tokenizers

    from segloom.llm.token_files import encoder

    enc, rng = encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    alphabet = ["a", "B", "7", "'s", "word.", "é", "л,", "_", "ª", "Õé)", "a\u0301", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "é", "漢", "!", "<|endoftext|>", "\U0001f600"]
    samples = ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(400)]
    for s, ids in zip(samples, enc.encode(samples)):
        assert np.frombuffer(ids, "<u2").tolist() == enc.tokenizer.encode(s, add_special_tokens=False).ids


def test_token_files_of_no_rows(spark):
    from segloom.llm.token_files import tokens_of

    assert tokens_of(spark, docs_of(spark, ["x"]).limit(0)).count() == 0


# 2. Repeats.


def removed_by_brute_force(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + span] for b in data for i in range(len(b) - span + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [1, 1000])
def test_repeats(spark, texts, limit):
    from segloom.llm.suffix_repeats import Repeats

    got = Repeats(docs_of(spark, texts), span=100, limit=limit).removed().collect()
    want = removed_by_brute_force(texts, 100)
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(want))


def maximal_repeats(texts, span):
    """bytes -> (distinct text, start) of each maximal repeat, by trying all lengths."""
    data = collections.Counter((t or "").encode() for t in texts)
    out = {b: {(b, 0)} for b, n in data.items() if n > 1 and len(b) >= span}
    live, n = [(b, i) for b in data for i in range(len(b))], span
    while live:
        seen = collections.defaultdict(list)
        for b, i in live:
            if i + n <= len(b):
                seen[b[i : i + n]].append((b, i))
        seen = {w: at for w, at in seen.items() if len(at) > 1}
        for w, at in seen.items():
            before, behind = {b[i - 1 : i] if i else None for b, i in at}, {b[i + n : i + n + 1] for b, i in at}
            if (len(before) > 1 or before == {None}) and (len(behind) > 1 or behind == {b""}):
                out.setdefault(w, set()).update(at)
        live, n = [x for at in seen.values() for x in at], n + 1
    return out


def nested(seed):
    """Texts that share passages of many lengths, inside one another, overlapping, at edges and as a whole."""
    r = random.Random(seed)
    own = lambda n: "".join(r.choices("abcdefghij \u00e9", k=n))
    a, b, c = own(1300), own(90), own(230)
    return [a, own(50) + a[:700] + own(60), own(20) + a[300:1100] + b + c, c + own(10) + a[400:520], own(30) + b + c + a[:150], a[250:650], c, c, own(80) + c + c[:150], own(200), "", None, "x" * 260, own(40) + a, a[900:] + "y", a[100:230] + b]


def test_repeats_of_short_periods(spark):
    """Texts of one byte or a short period, alone and inside others; 5 MB of a period are few rows."""
    from segloom.llm.suffix_repeats import Repeats

    made = ["a" * 1000, "b" * 99 + "a" * 300 + "c", "xy" * 400 + "z", "q" + "xy" * 130, "abc" * 90, "abd" * 33]
    got = Repeats(docs_of(spark, made), span=100, limit=3).removed().collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(removed_by_brute_force(made, 100)))
    long = "0123456789" * 500_000
    r = Repeats(docs_of(spark, [long, "own text"]), span=400)
    assert r.found.count() < 10_000
    assert {x.doc_id: tuple(x)[1:4] for x in r.removed().collect()} == {0: (5_000_000, 5_000_000, 1), 1: (8, 0, 0)}


@pytest.mark.parametrize("limit", [2, 20_000])
def test_repeats_of_hot_passages(spark, limit):
    """A passage that many texts share between different words, longer and shorter than the span."""
    from segloom.llm.suffix_repeats import Repeats

    rng = random.Random(7)
    own = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    hot, short = own(260), own(70)
    made = [own(rng.randrange(60)) + x + own(rng.randrange(60)) for x in [hot] * 12 + [hot[:150], hot[90:], short + hot[:130], short + hot[:140]] + [short] * 8]
    got = Repeats(docs_of(spark, made), span=100, limit=limit).removed().collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(removed_by_brute_force(made, 100)))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeat_groups(spark, seed):
    """All maximal repeats of 100 bytes or more with all their occurrences, and no other."""
    from segloom.llm.suffix_repeats import Repeats

    made = nested(seed)
    r = Repeats(docs_of(spark, made), span=100)
    by_key = {bytes(x.key): x.text.encode() for x in r.texts.collect()}
    groups = collections.defaultdict(set)
    for g in r.groups().collect():
        text = by_key[bytes(g.key)]
        assert g.n == sum((t or "").encode() == text for t in made)
        assert hashlib.md5(w := text[g.start : g.start + g.length]).digest() == bytes(g.id)
        groups[w].add((text, g.start))
    want = maximal_repeats(made, 100)
    assert max(map(len, want)) > 1200 and len(want) > 15
    assert groups == want


def test_no_repeats_of_no_rows(spark):
    from segloom.llm.suffix_repeats import Repeats

    assert Repeats(docs_of(spark, ["x"]).limit(0)).removed().count() == 0


# 3. Mixing.


def test_exponent():
    from segloom.llm.temperature_mixing import entropy, find_exponent, tempered

    totals = [1000, 100, 10]
    e = find_exponent(totals, 1110, max_repeats=2.0)
    assert max(w * 1110 / t for w, t in zip(tempered(totals, e), totals)) == pytest.approx(2.0)
    e = find_exponent(totals, 1110, target_entropy=0.9)
    assert entropy(tempered(totals, e)) == pytest.approx(0.9)


def test_mixing(spark):
    from segloom.llm.temperature_mixing import mixed, plan

    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(1, 40)) for _ in range(300)] + [None, ""]
    sources = ["big"] * 240 + [None] * 20 + ["c"] * 40 + ["none", "none"]
    got = mixed(docs_of(spark, texts, sources=sources), max_repeats=2.0).collect()
    size = collections.Counter()
    for t, s in zip(texts, sources):
        size[s] += len((t or "").split())
    want = {r[0]: r for r in plan(dict(size), max_repeats=2.0)}
    for s in size:
        rows = [r for r in got if r.source == s]
        _, total, _, take, full, rest, _ = want[s]
        for epoch in range(full):
            assert sorted(r.doc_id for r in rows if r.epoch == epoch) == [i for i, x in enumerate(sources) if x == s]
        last = sum(r.n_tokens for r in rows if r.epoch == full)
        assert last <= rest and (rest == 0 or rest - last < 40)
        assert all(0 <= r.mix_at <= 1 for r in rows)
    assert mixed(docs_of(spark, ["x"]).limit(0)).count() == 0


# 4. Language model.


def test_language_model(spark, texts):
    from segloom.llm.recurrent_lm import lm_scores

    every = texts * 2
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = {r.doc_id: r for r in lm_scores(docs_of(spark, every), held).collect()}
    words = [[*(t or "").encode().lower().split(), b""] for t in every]
    count = collections.Counter(w for i, ws in enumerate(words) if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in enumerate(words):
        r = got[i]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)


def test_probabilities_sum_to_one():
    from segloom.llm.recurrent_lm import Network

    net = Network(np.array([5.0, 3, 2, 1, *[1] * 60]), 4.2)
    h = np.random.default_rng(0).normal(0, 1, (1, 16)).astype(np.float32)
    p = sum(math.exp(net.outputs(h, np.array([k]), False)[0][0]) for k in range(65))
    assert p == pytest.approx(1, abs=1e-4)


def test_gradients():
    """A window's step goes down the slope that differences of the loss show."""
    from segloom.llm import recurrent_lm as L

    rng = np.random.default_rng(3)
    net = L.Network(np.array([5.0, 4, 3, 2]), 1.5)
    docs = [rng.integers(1, 5, 20).astype(np.uint16) for _ in range(8)]
    before = L.score_docs(net, docs).sum()
    for _ in range(30):
        L.learn_docs(net, docs)
    assert L.score_docs(net, docs).sum() > before + 5


def test_state_is_carried_across_windows():
    from segloom.llm import recurrent_lm as L

    rng = np.random.default_rng(4)
    net = L.Network(np.array([5.0, 4, 3, 2]), 1.5)
    docs = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 3, 100, 65, 32, 33)]
    together, alone = L.score_docs(net, docs), [L.score_docs(net, [d])[0] for d in docs]
    assert together == pytest.approx(alone, abs=1e-3)


# 5. Fingerprints.


def plain_sample(text):
    """The method by its definition, a term and a sample at a time, in plain Python."""
    import xxhash

    def uniform(h, k):
        x = (h + (k + 1) * 0x9E3779B1) % 2**32
        x ^= x >> 16
        x = x * 0x7FEB352D % 2**32 ^ h >> 32
        x ^= x >> 15
        x = x * 0x846CA68B % 2**32
        return ((x ^ x >> 16) // 2**9 + 0.5) / 2**23

    out = []
    terms = collections.Counter(text.encode().lower().split()) or {b"": 1}
    for k in range(64):
        best = None
        for word, n in terms.items():
            h = xxhash.xxh3_64_intdigest(word)
            u = [uniform(h, 64 * i + k) for i in range(5)]
            r, c = -math.log(u[0] * u[1]), -math.log(u[2] * u[3])
            t = math.floor(math.log(n * max(1, len(word))) / r + u[4])
            y = math.exp(r * (t - u[4]))
            best = min(best or (math.inf,), (c / (y * math.exp(r)), h, t))
        out.append(best[1:])
    return out


def test_fingerprints(spark, texts):
    from segloom.llm.common import mix
    from segloom.llm.weighted_sampling import edited, fingerprints

    ids = [None, *random.Random(1).sample(range(1000), len(texts) - 1)]
    got = {r.doc_id: r for r in fingerprints(docs_of(spark, texts, ids)).collect()}
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, -(ids[i] or 0)))
    same = []
    for k, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        new, r = edited(text, following), got[ids[i]]
        a, b, c = (plain_sample(x) for x in (text, new, following))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        near = lambda x, y: sum(p == q for p, q in zip(x, y)) / 64
        # Numbers of 32 bits in the operator, of 64 here: a sample in a thousand may differ.
        assert abs(r.near_edited - near(a, b)) <= 2 / 64 and abs(r.near_next - near(a, c)) <= 2 / 64
        for values, hexed in ((a, r.fingerprint), (b, r.edited_fingerprint)):
            h, t = np.array([v[0] for v in values], np.uint64), np.array([v[1] for v in values], np.int64).astype(np.uint64)
            same.append(np.mean(np.frombuffer(bytes.fromhex(hexed), np.uint16) == mix(h + mix(t + np.uint64(1))) >> np.uint64(48)))
    assert np.mean(same) > 0.995
    assert fingerprints(docs_of(spark, ["x"]).limit(0)).count() == 0
    one = fingerprints(docs_of(spark, ["alone"])).first()
    assert one.near_next == 1.0


def test_sampling_in_blocks():
    """Terms over several blocks, and a table that starts over, give what one block gives."""
    from segloom.llm import weighted_sampling as C

    terms = {f"t{i}".encode(): 1 + i % 7 for i in range(3000)}
    draws = C.Draws(1)
    whole, part = C.sample(terms, draws), [C.sample(dict(list(terms.items())[i::3]), draws) for i in range(3)]
    assert all(w in (p[k] for p in part) for k, w in enumerate(whole))
    assert (C.sample(dict(reversed(terms.items())), C.Draws()) == whole).all()


def test_likeness_is_generalised_jaccard():
    from segloom.llm import weighted_sampling as C

    rng, errors = random.Random(9), []
    draws = C.Draws()
    for _ in range(40):
        a = {f"t{i}".encode(): rng.randrange(1, 9) for i in rng.sample(range(60), 40)}
        b = {f"t{i}".encode(): rng.randrange(1, 9) for i in rng.sample(range(60), 40)}
        true = sum(min(a.get(t, 0), b.get(t, 0)) for t in a | b) / sum(max(a.get(t, 0), b.get(t, 0)) for t in a | b)
        errors.append(C.likeness(C.sample(a, draws), C.sample(b, draws)) - true)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09


# 6. Quality.


def test_quality(spark):
    from segloom.llm.subword_quality import quality, remainder

    rng = random.Random(3)
    texts = [prose(rng, 50) if i % 2 else " ".join(w.upper() + "!!" for w in prose(rng, 50).split()) for i in range(300)] + [None, ""]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality(docs, labels, ["doc_id"]).withColumn("held", remainder(F.col("doc_id"), 3) == 1).collect()
    held = [r for r in got if r.held and r.doc_id < 300]
    assert len(got) == 302 and np.mean([(r.score >= 0.5) == (r.doc_id % 2) for r in held]) > 0.95
    assert quality(docs, labels.limit(0), ["doc_id"]).select("score").distinct().collect()[0].score == 0.5
    assert quality(docs.limit(0), labels, ["doc_id"]).count() == 0


# 7. Near duplicates.


def grouped_by_brute_force(ids, texts, percent):
    sets = []
    for t in texts:
        w = tuple((t or "").encode().lower().split())
        sets.append({w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set())
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(range(len(ids)), 2):
        both = len(sets[x] & sets[y])
        if sets[x] and sets[y] and 100 * both >= percent * len(sets[x] | sets[y]):
            root[find(x)] = find(y)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[find(i)]) for i in range(len(ids))}


@pytest.mark.parametrize("limit", [3, 200])
def test_near_duplicates(spark, texts, limit):
    from segloom.llm.chosen_path import NearDuplicates

    rng = random.Random(8)
    base = prose(rng, 200).split()
    copies = []
    for k in range(25):  # a chain: each copy is near the one before, far from the first
        base = list(base)
        base[(k * 37) % 200] = f"new{k}"
        copies.append(" ".join(base))
    every = texts + copies
    got = NearDuplicates(docs_of(spark, every), limit=limit).grouped().collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == grouped_by_brute_force(list(range(len(every))), every, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_null_ids_and_no_rows(spark):
    from segloom.llm.chosen_path import NearDuplicates

    t = "a b c d e f g"
    got = NearDuplicates(docs_of(spark, [t, t, "other words here", None], [None, 4, None, None])).grouped().collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(None, 4, False), (4, 4, True), (None, None, True), (None, None, True)], key=str)
    assert NearDuplicates(docs_of(spark, ["x"]).limit(0)).grouped().count() == 0


# 8. Decontamination.


def hits_by_brute_force(text, items, span):
    import re

    cut = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    words, hit, found = cut(text), set(), set()
    for item_id, item in items:
        ws = cut(item)
        n = min(len(ws), span)
        windows = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()
        for i in range(len(words) - n + 1):
            if ws and tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item_id))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [10, 10**6])
def test_decontamination(spark, texts, block):
    from segloom.llm.winnow import decontaminate

    items = [(0, texts[1]), (1, texts[2][30:400]), (2, None), (3, ""), (4, "One, TWO"), (5, "ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab"), (6, texts[1]), (10, "é ü 漢字")]
    got = decontaminate(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_words=block, keep=["lang"]).collect()
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == hits_by_brute_force(texts[r.doc_id], items, 13), r.doc_id
        assert r.n_items == len(r["items"]) and sum(s.last - s.first for s in r.spans) >= r.n_hit
    none = decontaminate(docs_of(spark, texts), spark.createDataFrame([], "item_id long, text string"))
    assert none.agg(F.sum("n_hit")).first()[0] == 0 and none.count() == len(texts)


# 9. Preference pairs.


def test_preference_pairs(spark):
    from segloom.llm.preference_pairs import preference_pairs

    rows = [(1, True, 0, "user", "hi", 1), (1, True, 1, "assistant", "yes", 1), (1, True, 2, "user", None, 1), (1, False, 0, "user", "hi", 1), (1, False, 1, "assistant", "no", 1), (2, True, 0, "user", "x", 1), (None, True, 0, "user", "x", 1), (3, True, 0, None, "s", 1), (3, False, 0, None, "s", 1)]
    got = {r.pair_id: r for r in preference_pairs(spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string, n int")).collect()}
    a = got[1]
    assert (a.n_prompt, a.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert a.chosen == "<|assistant|>\nyes<|end|>\n<|user|>\n<|end|>\n" and a.rejected == "<|assistant|>\nno<|end|>\n"
    first, last = map(int, a.chosen_mask.split("-"))
    assert a.chosen[first:last] == "yes<|end|>"
    assert (got[2].n_prompt, got[2].rejected, got[2].n_chosen) == (0, "", 1)
    assert (got[3].n_prompt, got[3].chosen, got[3].rejected) == (1, "", "") and len(got) == 3


def test_preference_pairs_run_no_python(spark, sf):
    from segloom.llm.preference_pairs import op9_preference_pairs

    plan = op9_preference_pairs(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# 10. Licenses.


def test_alignment_is_common_subsequence():
    from segloom.llm.patience_licenses import align

    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice(b"abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert len(align(list(b"xxabcdeyy"), list(b"abXde"))) == 4


def test_licenses(spark):
    from segloom.llm.patience_licenses import TEMPLATES, licenses

    rng = random.Random(6)
    filler = [prose(rng, 300) for _ in range(6)]
    texts = [filler[0] + "\n" + TEMPLATES["mit"] + "\n" + filler[1], filler[2], None, "", TEMPLATES["gpl-3.0-line"] + " " + filler[3] + " " + TEMPLATES["gpl-3.0-line"].upper(), TEMPLATES["isc"].replace("any purpose", "every purpose"), "released " + filler[4] + " under MIT", TEMPLATES["apache-2.0-line"] + " " + TEMPLATES["cc-by-nc-4.0-line"]]
    got = {r.doc_id: r for r in licenses(docs_of(spark, texts)).collect()}
    names = {i: [f.name for f in r.found] for i, r in got.items()}
    assert names == {0: ["mit"], 1: [], 2: [], 3: [], 4: ["gpl-3.0-line"] * 2, 5: ["isc"], 6: [], 7: ["apache-2.0-line", "cc-by-nc-4.0-line"]}
    assert got[0].found[0].first == 300 and got[0].coverage == 1.0 and 0.9 < got[5].coverage < 1
    assert licenses(docs_of(spark, ["x"]).limit(0)).count() == 0
