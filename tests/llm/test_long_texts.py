"""Long words, long texts and hot passages: bounded memory and time, and results equal to plain versions."""

import math
import random
import time
import tracemalloc

import numpy as np
import pytest


def plain_log_probability(net, ids):
    """A document's natural log-probability by the equations of the network, one token and one number at a time."""
    from segloom.llm.recurrent_lm import CLASS, HIDDEN

    p, n = {k: v.astype(float).tolist() for k, v in net.p.items()}, HIDDEN
    sigmoid = lambda a: 1 / (1 + math.exp(-a))
    h, before, total = [0.0] * n, 0, 0.0
    for target in ids:
        x = [a + b for a, b in zip(p["x"][before], p["b"])]
        gate = [sigmoid(x[j] + sum(h[i] * p["u"][i][j] for i in range(n))) for j in range(2 * n)]
        z, r = gate[:n], gate[n:]
        new = [math.tanh(x[2 * n + j] + sum(r[i] * h[i] * p["v"][i][j] for i in range(n))) for j in range(n)]
        h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(n)]
        kind, inner = (net.n_class - 1, None) if target >= net.soft else divmod(target, CLASS)
        logits = [sum(h[i] * p["c"][i][k] for i in range(n)) + p["cb"][k] for k in range(net.n_class)]
        total += logits[kind] - math.log(sum(map(math.exp, logits)))
        if inner is not None:
            logits = [sum(h[i] * p["w"][kind][i][k] for i in range(n)) + p["wb"][kind][k] for k in range(CLASS)]
            total += logits[inner] - math.log(sum(map(math.exp, logits)))
        before = target
    return total


def test_scores_equal_the_equations():
    from segloom.llm import recurrent_lm as L

    rng = np.random.default_rng(8)
    net = L.Network(np.arange(70, 0, -1).astype(float), 3.0)
    docs = [np.append(rng.integers(1, 71, n), 0).astype(np.uint16) for n in (0, 1, 5, 31, 32, 33, 90)]
    for _ in range(4):
        L.learn_docs(net, docs)
    assert L.score_docs(net, docs) == pytest.approx([plain_log_probability(net, d.tolist()) for d in docs], rel=1e-4)


def test_gradients_equal_differences():
    """What a step adds to the squared gradients is the square of the loss's slope, by differences."""
    from segloom.llm import recurrent_lm as L

    rng = np.random.default_rng(9)
    counts = np.arange(40, 0, -1).astype(float)
    net = L.Network(counts, 3.0)
    doc = rng.integers(0, 41, 12).astype(np.uint16)
    ids, before, number, fresh = L.lanes([doc])
    start, state = {k: v.copy() for k, v in net.p.items()}, net.state()
    net.step(before, fresh, np.zeros((1, L.HIDDEN), np.float32), ids, number >= 0)
    scale = len(doc) ** -0.5

    def loss(name, at, by):
        other = L.Network(counts, 3.0).load(state)
        other.p = {k: v.astype(float) for k, v in start.items()}
        other.p[name][at] += by
        return -plain_log_probability(other, doc.tolist())

    for name in ("x", "b", "u", "v", "c", "cb", "w", "wb"):
        moved = np.argwhere(net.g2[name] > 1.001e-4)
        for at in map(tuple, moved[rng.permutation(len(moved))[:4]]):
            slope = (loss(name, at, 1e-4) - loss(name, at, -1e-4)) / 2e-4
            assert net.g2[name][at] - 1e-4 == pytest.approx(min(1, abs(slope * scale)) ** 2, rel=0.03, abs=1e-6), (name, at)
            assert np.sign(start[name][at] - net.p[name][at]) == np.sign(slope)


def test_a_long_text_takes_no_room_for_the_short_ones():
    from segloom.llm import recurrent_lm as L

    docs = [np.ones(5_000_000, np.uint16), *(np.ones(50, np.uint16) for _ in range(300))]
    tracemalloc.start()
    ids, before, number, fresh = L.lanes(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and ids.size <= 3 * sum(map(len, docs))
    assert np.bincount(number[number >= 0], minlength=301).tolist() == list(map(len, docs)) and fresh.sum() == 301


def test_pieces_of_a_word_are_its_features():
    from segloom.llm import subword_quality as Q

    rng = random.Random(2)
    for n in (1, 2, 3, 5, 64, 65, 3000, Q._PIECE - 3, Q._PIECE - 2, Q._PIECE, 2 * Q._PIECE + 1):
        word = rng.randbytes(n)
        assert sorted(Q.features(word)) == sorted(np.concatenate(list(Q.feature_pieces(word))).tolist())


def test_long_words_count_and_score_alike():
    from segloom.llm import subword_quality as Q

    rng = random.Random(4)
    words = [bytes(rng.choices(b"abcdef", k=rng.choice([3, 9, 64, 65, 200]))) for _ in range(300)]
    at, share = Q.Counter()(b" ".join(words))
    plain = np.bincount([f for w in words for f in Q.features(w)], minlength=Q.BUCKETS + 2)
    grams = at < Q.BUCKETS
    assert np.flatnonzero(plain).tolist() == at[grams].tolist()
    assert share[grams] == pytest.approx(plain[at[grams]] / plain.sum(), rel=1e-5)
    parts = np.random.default_rng(1).normal(0, 1, Q.BUCKETS + 2).astype(np.float32)
    scores = Q.WordScores(parts)
    for w in words:
        f = Q.features(w)
        assert scores[w].imag == len(f) and scores[w].real == pytest.approx(float(parts[f].astype(float).sum()), abs=1e-9)


def test_a_word_of_fifty_megabytes():
    from segloom.llm import subword_quality as Q

    text = b"abcdefgh" * 6_250_000
    tracemalloc.start()
    at, share = Q.Counter()(text)
    value = Q.WordScores(np.ones(Q.BUCKETS + 2, np.float32))[text]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert value.real == value.imag == 1 + 2 * len(text) + 4 - 5 and share.sum() == pytest.approx(1) and len(at) < 40
    assert peak < 300e6


def plain_hits(items, doc, span):
    mask, found = [False] * len(doc), set()
    for number, item in enumerate(items):
        n = min(span, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if item else set()
        for i in range(len(doc) - n + 1):
            if tuple(doc[i : i + n]) in windows:
                found.add(number)
                mask[i : i + n] = [True] * n
    return mask, found


def hashed(words):
    from segloom.llm.common import WordHashes

    return WordHashes().of([w.encode() for w in words])


def test_windows_equal_brute_force():
    from segloom.llm.winnow import Index

    r = random.Random(3)
    for _ in range(300):
        letters = "abcdef"[: r.randint(1, 6)]
        items = [[r.choice(letters) for _ in range(r.choice([0, 1, 3, 12, 13, 14, 40]))] for _ in range(r.randint(0, 6))]
        doc = [r.choice(letters) for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 3) if items else 0):
            at = r.randint(0, len(doc))
            doc[at:at] = r.choice(items)[r.randint(0, 5) :]
        index = Index([(k, " ".join(x).encode()) for k, x in enumerate(items)], 13)
        mask, found = index.hits(hashed(doc))
        assert (mask.tolist(), {index.ids[i] for i in found}) == plain_hits(items, doc, 13)


def test_a_passage_that_all_items_share():
    from segloom.llm.winnow import Index

    shared = [f"s{i}" for i in range(14)]
    index = Index([(k, " ".join([*shared, f"x{k}", f"y{k}"]).encode()) for k in range(5000)], 13)
    doc = hashed(shared * 200)
    start = time.perf_counter()
    mask, found = index.hits(doc)
    assert time.perf_counter() - start < 1  # 22.5 s where each item was extended on its own
    assert mask.all() and len(found) == 5000


def test_a_long_item():
    from segloom.llm.winnow import Index

    words = [f"w{i % 7919}x{i // 7919}" for i in range(300_000)]
    index = Index([("long", " ".join(words).encode())], 13)
    mask, found = index.hits(hashed(["no", *words[150_000:150_013], "no", *words[7:19], "no"]))
    assert np.flatnonzero(mask).tolist() == list(range(1, 14)) and found == {0}
