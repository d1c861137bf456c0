"""Language-model scores of documents by a gated recurrent network, trained here in numpy.

Tokens: words (A-Z lower-cased, `[^\\x20\\x09-\\x0D]+`) and one end per document. Their counts in the training documents are
summed by Spark over the whole corpus. The network predicts the SOFT most frequent tokens and, as one more class, all others;
among those it falls back on smoothed counts, so that every text has a probability. Its output is factored: first the class of
a token, then the token within its class. Documents of a task are laid end to end into lanes; windows of WINDOW steps are
trained by back-propagation that ends at the window, while the state is carried on, and so a document is scored as a whole.

Long documents get fewer lanes, so that the table of lanes never exceeds three times the tokens laid out. In training, a document
is cut only where it is longer than a lane's fair share of its task's tokens (and than SEGMENT); each piece then has the token
before it as first input and a state of its own, so that no lane outlasts the others by far. Scores always carry the state through.

Training covers all training documents once, in ROUNDS slices. In each slice every task trains from the same weights on its
own documents, and the weights are averaged, in a tree, weighted by tokens (local stochastic gradient descent). The averages
are of a fixed size. The PLAIN most frequent words at most are broadcast with their counts; rarer ones are counted by a join.

Null texts count as empty and have the end alone. Null doc_ids are training documents. Repeated rows are rows of their own.
Without training documents counts are 0 and the network stays as initialised. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, rows_out, table, text_bytes, written

SOFT, CLASS, HIDDEN = 2048, 32, 16
PLAIN = 200_000
WINDOW, LANES, SEGMENT, CHUNK, ROUNDS, RATE = 32, 256, 1024, 4_000_000, 6, 0.12
LOG10 = math.log(10)


class Network:
    """A GRU over token ids 0..soft (soft: all rarer tokens), with class-factored output."""

    def __init__(self, counts: np.ndarray, rare: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.soft, self.n_class = len(counts), -(-len(counts) // CLASS) + 1
        h, c = HIDDEN, self.n_class
        mass = np.zeros((c, CLASS))
        mass.ravel()[: self.soft] = counts + 0.1
        mass[-1, 0] = rare
        total = mass.sum(axis=1)
        near = lambda *shape: rng.normal(0, 0.15, shape)
        with np.errstate(divide="ignore"):
            inner = np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / total[:, None]), -1e4)
        values = {"x": near(self.soft + 1, 3 * h), "b": np.zeros(3 * h), "u": near(h, 2 * h), "v": near(h, h), "c": near(h, c), "cb": np.log(total / total.sum()), "w": near(c, h, CLASS) * (mass > 0)[:, None, :], "wb": inner}
        self.shapes = {k: v.shape for k, v in values.items()}
        self.p = {k: v.astype(np.float32) for k, v in values.items()}
        self.g2 = {k: np.full(v.shape, 1e-4, np.float32) for k, v in values.items()}

    def state(self) -> np.ndarray:
        return np.concatenate([x.ravel() for d in (self.p, self.g2) for x in d.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for d in (self.p, self.g2):
            for k, shape in self.shapes.items():
                n = math.prod(shape)
                d[k] = flat[at : at + n].reshape(shape).astype(np.float32)
                at += n
        return self

    def forward(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None) -> tuple[np.ndarray, np.ndarray]:
        """States after each of the T x B inputs, and the last; where fresh, the state starts from 0. keep: gets h, gates, r * h and m of all steps."""
        u, v, n = self.p["u"], self.p["v"], HIDDEN
        steps, b = ids.shape
        x = (self.p["x"] + self.p["b"])[ids]
        x_gates, x_new = x[:, :, : 2 * n], x[:, :, 2 * n :]
        live = (~fresh).astype(np.float32)[:, :, None]
        out, h0, gates = np.empty((steps, b, n), np.float32), np.empty((steps, b, n), np.float32), np.empty((steps, b, 2 * n), np.float32)
        rh, m = np.empty((steps, b, n), np.float32), np.empty((steps, b, n), np.float32)
        for t in range(steps):
            h = np.multiply(h, live[t], out=h0[t])
            g = np.matmul(h, u, out=gates[t])
            g += x_gates[t]
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.multiply(g[:, n:], h, out=rh[t])
            new = np.matmul(rh[t], v, out=m[t])
            new += x_new[t]
            np.tanh(new, out=new)
            o = np.subtract(h, new, out=out[t])
            o *= g[:, :n]
            o += new
            h = o
        if keep is not None:
            keep.extend((h0, gates, rh, m, live))
        return out, h

    def outputs(self, h: np.ndarray, target: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None, dict | None]:
        """Natural log-probabilities of the targets; with learn also the gradients of their negative sum."""
        p, n = self.p, len(h)
        kind, inner = target // CLASS, target % CLASS
        rare = target >= self.soft
        kind = np.where(rare, self.n_class - 1, kind)
        # States are within -1 and 1, so logits stay small; the bound only keeps exp finite whatever is learned.
        logits = h @ p["c"]
        logits += p["cb"]
        np.minimum(logits, 60, out=logits)
        rows = np.arange(n)
        picked = logits[rows, kind]
        e = np.exp(logits, out=logits)
        s = e @ np.ones(e.shape[1], np.float32)  # faster than a sum of short rows
        logp = picked - np.log(s)
        if learn:
            dc = e
            dc /= s[:, None]
            dc[rows, kind] -= 1
            g = {"c": h.T @ dc, "cb": dc.sum(axis=0), "w": np.zeros(self.shapes["w"], np.float32), "wb": np.zeros(self.shapes["wb"], np.float32)}
            dh = dc @ p["c"].T
        order = np.argsort(kind.astype(np.uint16), kind="stable")  # a radix sort
        ends = np.searchsorted(kind[order], np.arange(self.n_class - 1), "right")
        sorted_h, sorted_inner = h[order], inner[order]
        got, sums, ones = np.zeros(n, np.float32), np.ones(n, np.float32), np.ones(CLASS, np.float32)
        back = np.zeros_like(sorted_h) if learn else None
        first = 0
        for c, last in enumerate(ends.tolist()):
            if last > first:
                part = slice(first, last)
                hc = sorted_h[part]
                y = hc @ p["w"][c]
                y += p["wb"][c]
                np.minimum(y, 60, out=y)
                i, k = rows[: last - first], sorted_inner[part]
                got[part] = y[i, k]
                e = np.exp(y, out=y)
                s = sums[part] = e @ ones
                if learn:
                    e /= s[:, None]
                    e[i, k] -= 1
                    g["w"][c], g["wb"][c] = hc.T @ e, e.sum(axis=0)
                    np.matmul(e, p["w"][c].T, out=back[part])
            first = last
        logp[order] += got - np.log(sums)
        if learn:
            dh[order] += back
        return (logp, dh, g) if learn else (logp, None, None)

    def step(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, target: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """One update on a window; returns the state at its end."""
        keep: list = []
        out, last = self.forward(ids, fresh, h, keep)
        n, p = HIDDEN, self.p
        _, dout, g = self.outputs(out[valid], target[valid].astype(np.int64), True)
        dh_all = np.zeros_like(out)
        dh_all[valid] = dout
        h0, gates, rh, m, live = keep
        dx = np.empty((*ids.shape, 3 * n), np.float32)
        z, r = gates[:, :, :n], gates[:, :, n:]
        slope = gates * (1 - gates)
        # What each step multiplies, for all steps at once.
        to_new, to_z = (1 - z) * (1 - m * m), (h0 - m) * slope[:, :, :n]
        to_r = h0 * slope[:, :, n:]
        ut, vt, dh = np.ascontiguousarray(p["u"].T), np.ascontiguousarray(p["v"].T), np.zeros_like(h)
        for t in range(len(ids) - 1, -1, -1):
            dh += dh_all[t]
            d = dx[t]
            dm = np.multiply(dh, to_new[t], out=d[:, 2 * n :])
            drh = dm @ vt
            np.multiply(dh, to_z[t], out=d[:, :n])
            np.multiply(drh, to_r[t], out=d[:, n : 2 * n])
            dh *= z[t]
            drh *= r[t]
            dh += drh
            dh += d[:, : 2 * n] @ ut
            dh *= live[t]
        flat = lambda a: a.reshape(-1, a.shape[-1])
        du, dv = flat(h0).T @ flat(dx[:, :, : 2 * n]), flat(rh).T @ flat(dx[:, :, 2 * n :])
        g |= {"u": du, "v": dv, "b": dx.sum(axis=(0, 1))}
        inputs, dflat = ids.ravel(), dx.reshape(-1, 3 * n)
        order = np.argsort(inputs, kind="stable")
        used, starts = np.unique(inputs[order], return_index=True)
        gx = np.add.reduceat(dflat[order], starts, axis=0)
        scale = np.float32(1 / max(1, len(inputs)) ** 0.5)
        for k, d in g.items():
            d = np.clip(d * scale, -1, 1)
            self.g2[k] += d * d
            p[k] -= np.float32(RATE) * d / np.sqrt(self.g2[k])
        d = np.clip(gx * scale, -1, 1)
        self.g2["x"][used] += d * d
        p["x"][used] -= np.float32(RATE) * d / np.sqrt(self.g2["x"][used])
        return last


def lanes(docs: list[np.ndarray], firsts: list[int] | None = None, most: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lays documents end to end into lanes of about equal lengths, longest first, no more lanes than leave the table within three times the tokens: ids, the inputs before them (a document's first: that of firsts, or the end), document number (-1: none), starts; all T x B."""
    b = max(1, min(most, len(docs), 1 + sum(map(len, docs)) // max(1, max(map(len, docs), default=1))))
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    load, put = [(0, k) for k in range(b)], [[] for _ in range(b)]
    for i in order:
        n, k = heapq.heappop(load)
        put[k].append(i)
        heapq.heappush(load, (n + len(docs[i]), k))
    put.sort(key=lambda x: -sum(len(docs[i]) for i in x))
    length = sum(len(docs[i]) for i in put[0]) if docs else 0
    ids, doc, fresh = np.zeros((length, b), np.uint16), np.full((length, b), -1, np.int32), np.zeros((length, b), bool)
    before = np.zeros((length, b), np.uint16)
    for k, own in enumerate(put):
        at = 0
        for i in own:
            n = len(docs[i])
            ids[at : at + n, k], doc[at : at + n, k], fresh[at, k] = docs[i], i, True
            before[at, k], before[at + 1 : at + n, k] = firsts[i] if firsts else 0, docs[i][:-1]
            at += n
    return ids, before, doc, fresh


def windows(ids: np.ndarray, before: np.ndarray, doc: np.ndarray, fresh: np.ndarray, rows: int = 0) -> Iterator[tuple]:
    """Windows of inputs, starts, targets and documents, over the lanes that go on: WINDOW steps each, or more where that makes at most `rows` rows."""
    lengths, at = (doc >= 0).sum(axis=0), 0
    while at < len(ids):
        live = int((lengths > at).sum())
        steps = max(WINDOW, rows // live)
        part = (slice(at, at + steps), slice(0, live))
        yield before[part], fresh[part], ids[part], doc[part]
        at += steps


def learn_docs(net: Network, docs: list[np.ndarray]) -> None:
    size = max(SEGMENT, -(-sum(map(len, docs)) // LANES))  # a lane's fair share: no document is cut that needn't outlast the rest
    cut = [(d[a : a + size], int(d[a - 1]) if a else 0) for d in docs for a in range(0, len(d), size)]
    ids, before, doc, fresh = lanes([d for d, _ in cut], [f for _, f in cut])
    h = np.zeros((ids.shape[1], HIDDEN), np.float32)
    for x, f, y, d in windows(ids, before, doc, fresh):
        h = net.step(x, f, h[: x.shape[1]], y, d >= 0)


def score_docs(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """The natural log-probability of each document's ids."""
    ids, before, doc, fresh = lanes(docs)
    h, out = np.zeros((ids.shape[1], HIDDEN), np.float32), np.zeros(len(docs))
    for x, f, y, d in windows(ids, before, doc, fresh, WINDOW * LANES):
        states, h = net.forward(x, f, h[: x.shape[1]], None)
        valid = d >= 0
        logp, _, _ = net.outputs(states[valid], y[valid].astype(np.int64), False)
        out += np.bincount(d[valid], weights=logp, minlength=len(docs))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(uids, documents' ids), some million tokens at a time."""
    uids, docs, n = [], [], 0
    for b in batches:
        for u, x in zip(b.column("uid").to_pylist(), b.column("ids").to_pylist()):
            uids.append(u)
            docs.append(np.frombuffer(x, np.uint16))
            n += len(docs[-1])
            if n >= CHUNK:
                yield uids, docs
                uids, docs, n = [], [], 0
    if docs:
        yield uids, docs


def _counts(docs: DataFrame) -> DataFrame:
    """(w, c) over the training documents; the end is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["w", "c"])
            found.clear()
            return out

        for b in batches:
            for text in text_bytes(b.column("text")):
                found.update(text.translate(LOWER).split())
                found[b""] += 1
                if len(found) > 500_000:
                    yield flush()
        if found:
            yield flush()

    parts = docs.filter("not held_out").select("text").mapInArrow(count, "w binary, c long")
    return written(parts.groupBy("w").agg(F.sum("c").alias("c")), "counts")


def _averaged(rows: DataFrame) -> tuple[float, np.ndarray | None]:
    """The mean of the state rows, weighted by n, summed in a tree."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0.0, None
        for b in batches:
            for k, s in zip(b.column("n").to_pylist(), b.column("state").to_pylist()):
                x = np.frombuffer(s, np.float32) * np.float32(k)
                n, total = n + k, x if total is None else total + x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / np.float32(n)).tobytes()], pa.binary())], names=["n", "state"])

    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for parts in sorted({max(1, math.isqrt(many)), 1}, reverse=True):
        rows = rows.repartition(parts).mapInArrow(add, "n double, state binary")
    got = rows.collect()
    return (got[0].n, np.frombuffer(got[0].state, np.float32)) if got else (0.0, None)


def lm_scores(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; scores are log10."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = _counts(base)
    got = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, types = int(got.n or 0), int(got.v)
    # The least count from which on at most PLAIN words are left, from a histogram of a few hundred bins.
    bins = counts.groupBy(F.floor(F.log2("c") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("least")).orderBy(F.col("bin").desc()).collect()
    floor, held = None, 0
    for r in bins:
        held += r.k
        if held > PLAIN:
            break
        floor = r.least
    head = sorted(((r.c, bytes(r.w)) for r in counts.filter(F.col("c") >= floor).collect()), key=lambda x: (x[1] != b"", -x[0], x[1])) if floor else []
    if not head or head[0][1] != b"":
        head.insert(0, (0, b""))
    head_counts = np.array([c for c, _ in head], np.float64)
    soft = head_counts[:SOFT]
    rare_mass = (total - soft.sum()) + 0.1 * (types - (soft > 0).sum()) + 0.1
    words = spark.sparkContext.broadcast(({w: i for i, (_, w) in enumerate(head)}, head_counts))
    rows = written(_encoded(base, words, len(soft), rare_mass, total + 0.1 * (types + 1)), "encoded")
    state = _trained(rows, soft, rare_mass)
    scored = _network_scores(rows, soft, rare_mass, state)
    tails = rows.select("uid", F.explode("tail").alias("w")).join(counts, "w", "left").groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("logs"), F.sum(F.col("c").isNotNull().cast("long")).alias("known"), F.count(F.lit(1)).alias("k"))
    out = rows.drop("ids", "tail").join(scored, "uid").join(tails, "uid", "left")
    k, logs = F.coalesce("k", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - k * math.log10(total + 0.1 * (types + 1))).alias("base_score"),
        (F.col("net") + F.col("rare") + logs - k * math.log10(rare_mass)).alias("score"),
    )


def _encoded(base: DataFrame, words, soft: int, rare_mass: float, norm: float) -> DataFrame:
    """Per document: uid, ids (rarer tokens as `soft`), sums for the words that are broadcast, and the tail of all others."""
    out = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("rare", pa.float64()), ("ids", pa.binary()), ("tail", pa.list_(pa.binary()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, counts = words.value
        logs, uid = np.log10(counts + 0.1), TaskContext.get().partitionId() << 40

        def rows():
            nonlocal uid
            for b in batches:
                for doc_id, held, text in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), text_bytes(b.column("text"))):
                    ws = text.translate(LOWER).split()
                    ws.append(b"")
                    at = np.fromiter(map(known.get, ws, repeat(-1)), np.int64, len(ws))
                    head = at[at >= 0]
                    plain = head[head >= soft]
                    tail = [ws[i] for i in np.flatnonzero(at < 0).tolist()]
                    ids = np.where((at < 0) | (at >= soft), soft, at).astype(np.uint16)
                    yield uid, doc_id, held, len(ws), int((counts[head] > 0).sum()), float(logs[head].sum() - len(head) * math.log10(norm)), float(logs[plain].sum() - len(plain) * math.log10(rare_mass)), ids.tobytes(), tail
                    uid += 1

        yield from rows_out(out, rows(), 1000)

    return base.mapInArrow(encode, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare double, ids binary, tail array<binary>")


def _trained(rows: DataFrame, soft: np.ndarray, rare: float) -> np.ndarray:
    """The weights after all slices."""
    state = Network(soft, rare).state()
    for r in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast(state)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net, n = Network(soft, rare).load(shared.value), 0
            for _, docs in _chunks(batches):
                learn_docs(net, docs)
                n += sum(map(len, docs))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([net.state().tobytes()], pa.binary())], names=["n", "state"])

        part = rows.filter(~F.col("held_out") & (F.pmod(F.xxhash64("uid"), F.lit(ROUNDS)) == r)).select("uid", "ids")
        _, new = _averaged(part.mapInArrow(learn, "n double, state binary"))
        state = state if new is None else new
    return state


def _network_scores(rows: DataFrame, soft: np.ndarray, rare: float, state: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(soft, rare).load(shared.value)
        for uids, docs in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(score_docs(net, docs) / LOG10)], names=["uid", "net"])

    return rows.select("uid", "ids").mapInArrow(score, "uid long, net double")


def op4_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return lm_scores(table(spark, sf_dir, "documents"), held)
