"""Exact repeats of at least `span` bytes, by common-prefix interval trees over sampled, enhanced suffix arrays.

A whole corpus has no one suffix array that fits a task. Suffixes are therefore sampled by content: of the 64-byte gram
hashes, those that are smallest in a window of span - 63 are anchors, so that equal strings of `span` bytes hold equal
anchors at equal places. An anchor occurrence with at most span - 64 bytes before it and `span` bytes from it on is its
context; a string of `span` bytes around the anchor lies within it. Suffixes at one anchor are sorted, their common prefixes
scanned with a stack into the interval tree, and each interval (a right-maximal repeat of r bytes) is split by a second scan
over the common suffixes of what stands before, which is where the left extensions differ (l bytes): together they are the
maximal repeats of l + r bytes with all their occurrences.

Scale: equal texts are one text with a count; equal contexts are one context with a count, summed before any shuffle by
anchor. Anchors that occur once are dropped before any text moves. Anchors that follow one another at equal distances with
equal contexts, as in texts of a short period, are one row. Long texts are searched in pieces of a megabyte. An anchor with more than `limit` different contexts
isn't scanned in one task: all windows of its contexts are hashed (128 bits) and counted as rows, which is exact too and
spreads over the cluster. Only hashes, places and needed contexts are shuffled; texts are dealt out once, into a bucketed table.

Null texts count as empty; texts shorter than `span` lose nothing. Repeated rows and equal texts of `span` bytes lose every
byte. Null doc_ids are kept as rows. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import copy
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, discard, mix, rows_out, runs, shared_folder, shuffle_partitions, sliding_min, table, text_bytes, written

GRAM, LEAST_SPAN = 64, 400
LIMIT = 20_000  # contexts of at most 736 bytes: 15 MB in a task
#: Lengths of the beginnings by which the reach of contexts is bounded.
LADDER = (4, 8, 12, 16, 20, 24, 32, 40, 48, 64, 80, 96, 128, 160, 192, 256, 320, 400)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_TABLE2 = mix(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = []


def _pow(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers


def window_hashes(data: np.ndarray, k: int, values: np.ndarray = _TABLE) -> np.ndarray:
    """A 64-bit hash of each k bytes of data: differences of prefix sums, shifted to the same power."""
    n = len(data)
    up, down = _pow(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])


def anchors(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are smallest in some window; all equal ones count."""
    if len(data) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, w = window_hashes(data, GRAM), span - GRAM + 1
    low = sliding_min(h, w)
    edge = np.zeros(w - 1, np.uint64)  # a gram is kept if the largest minimum of the windows that hold it is itself
    top = ~sliding_min(~np.concatenate([edge, low, edge]), w)
    at = np.flatnonzero(top == h)
    return at, h[at]


def _placed(text: bytes, span: int, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(place, hash) of a text's anchors, from pieces that overlap by what decides about an anchor."""
    over = 2 * span  # a gram is an anchor if it is smallest in a window of span bytes around it
    for first in range(0, max(1, len(text)), size):
        low, high = max(0, first - over), min(len(text), first + size + over)
        at, h = anchors(np.frombuffer(text, np.uint8)[low:high], span)
        at = at + low
        own = slice(*np.searchsorted(at, (first, first + size)))
        yield from zip(at[own].tolist(), h[own].view(np.int64).tolist())


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """The interval tree of a common-prefix array, bottom-up: (value, first, last) with value >= least. lcp[i] is of suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []  # (value, first suffix), values rising
    for i, v in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > v:
            value, first = stack.pop()
            if value >= least:
                yield value, first, i
        if v and (not stack or stack[-1][0] < v):
            stack.append((v, first))


def common(strings: list[bytes], order: list[int], bound: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Lengths of the common prefixes of neighbours in the given order; 0 across groups."""
    n = len(order)
    if n < 2:
        return np.zeros(0, np.int64)
    rows = np.frombuffer(b"".join(strings[i].ljust(width, b"\0") for i in order), np.uint8).reshape(n, width)
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    order_ = np.array(order)
    lcp = np.minimum(lcp, np.minimum(bound[order_[1:]], bound[order_[:-1]]))
    return np.where(group[order_[1:]] == group[order_[:-1]], lcp, 0)


class RangeMin:
    """Minima of any range of an array, from a sparse table."""

    def __init__(self, x: np.ndarray):
        self.levels = [x.astype(np.int32)]
        while 2 << (len(self.levels) - 1) <= len(x):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of x[a:b], b > a."""
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for level in np.unique(k):
            m = k == level
            out[m] = np.minimum(self.levels[level][a[m]], self.levels[level][b[m] - (1 << int(level))])
        return out


def repeat_scan(group: np.ndarray, left: list[bytes], right: list[bytes], span: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeats among contexts: (l, r, members) with l + r >= span. left is reversed; contexts of a group stand together, and those of different groups share nothing."""
    n = len(group)
    if n < 2:
        return
    edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), n]  # equal groups stand together
    by_right = [i for a, b in zip(edges, edges[1:]) for i in sorted(range(a, b), key=right.__getitem__)]
    by_left = [i for a, b in zip(edges, edges[1:]) for i in sorted(range(a, b), key=left.__getitem__)]
    lcp = common(right, by_right, np.fromiter(map(len, right), np.int64, n), group, max(map(len, right)))
    lefts = common(left, by_left, np.fromiter(map(len, left), np.int64, n), group, max(1, *map(len, left)))
    least_left, next_left = None, lefts.tolist()
    suffix, rank = np.array(by_right), np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    member, ranked = np.array(by_left), rank.tolist()
    for r, first, last in intervals(lcp, GRAM):
        need = span - r
        if last - first == 1:  # two contexts, as most have
            a, b = sorted((ranked[by_right[first]], ranked[by_right[last]]))
            low = min(next_left[a:b])
            if low >= need:
                yield low, r, member[[a, b]]
            continue
        least_left = least_left or RangeMin(lefts)
        ranks = np.sort(rank[suffix[first : last + 1]])
        between = least_left(ranks[:-1], ranks[1:])
        if need <= 0 and not (between > 0).any():
            yield 0, r, member[ranks]
            continue
        if need <= 0 and between.min() == 0:
            yield 0, r, member[ranks]  # their left extensions differ at once
        for l, a, b in intervals(between, max(1, need)):
            yield l, r, member[ranks[a : b + 1]]


def _bucketed(texts: DataFrame, name: str, place: str) -> DataFrame:
    """Writes texts into buckets by key, so that later joins on key leave them where they are."""
    spark = texts.sparkSession
    texts.write.bucketBy(shuffle_partitions(spark), "key").sortBy("key").option("path", f"{place}/texts").saveAsTable(name)
    return spark.table(name)


class Repeats:
    """The stages of the operator over (key, text): distinct texts with their number n."""

    def __init__(self, docs: DataFrame, span: int = 400, limit: int = LIMIT):
        self.span, self.limit, self.spark = span, limit, docs.sparkSession
        self.place, self.name = shared_folder(self.spark, "repeats"), f"texts_{uuid.uuid4().hex}"
        self.keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
        self.texts = _bucketed(self.keyed.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n")), self.name, self.place)
        self._search(span, span - GRAM, span)

    def _search(self, span: int, before: int, reach: int) -> None:
        """Anchors of windows of `span`, and the contexts of those that occur more than once: `before` bytes before an anchor, `reach` from it on."""
        self.span, self.before, self.reach = span, before, reach
        self.found = written(self._occurrences(), "anchors", self.place)
        often = written(self.found.groupBy("a").agg(F.sum("times").alias("m")).filter("m > 1").select("a"), "often", self.place)
        self.found = written(self.found.join(often, "a", "left_semi"), "repeated", self.place)
        each = written(self.found.groupBy("a", "c").agg(F.sum("times").alias("k"), F.min(F.struct("key", "pos")).alias("at")), "contexts", self.place)
        self.several = written(each.groupBy("a").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "several", self.place)
        self.contexts = written(self._fetched(each.join(self.several, "a").select("a", "c", "k", "m", "at.key", "at.pos")), "bytes", self.place)
        self.each = each

    def _occurrences(self) -> DataFrame:
        span, before, reach = self.span, self.before, self.reach
        out = pa.schema([("a", pa.int64()), ("c", pa.binary()), ("key", pa.binary()), ("pos", pa.int32()), ("step", pa.int32()), ("times", pa.int32())])

        def occurrences(key: bytes, text: bytes) -> Iterator[tuple]:
            """One row for each anchor; for anchors that follow one another at equal distances with equal contexts, as in runs of a short period, one for all."""
            run, last = None, 0
            for p, a in _placed(text, span):
                start = max(0, p - before)
                c = xxhash.xxh3_128_digest(text[start : p + reach], seed=p - start)
                if run and run[0] == a and run[1] == c and (run[5] == 1 or p - last == run[4]):
                    run[4], run[5] = p - last, run[5] + 1
                else:
                    if run:
                        yield tuple(run)
                    run = [a, c, key, p, 1, 1]
                last = p
            if run:
                yield tuple(run)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from rows_out(out, (r for key, text in zip(b.column("key").to_pylist(), text_bytes(b.column("text"))) for r in occurrences(key, text)), 10_000)

        return self.texts.select("key", "text").mapInArrow(find, "a long, c binary, key binary, pos int, step int, times int")

    def _fetched(self, needed: DataFrame) -> DataFrame:
        """The bytes of one occurrence of each context in `needed`."""
        before, reach, some = self.before, self.reach, self._some()
        lists = needed.groupBy("key").agg(F.collect_list(F.struct("a", "c", "k", "m", "pos")).alias("each"))
        out = pa.schema([("a", pa.int64()), ("c", pa.binary()), ("k", pa.int64()), ("m", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = ((x["a"], x["c"], x["k"], x["m"], text[max(0, x["pos"] - before) : x["pos"]][::-1], text[x["pos"] : x["pos"] + reach]) for text, each in zip(text_bytes(b.column("text")), b.column("each")) for x in map(pa.StructScalar.as_py, each))
                yield from rows_out(out, rows, some)

        return self.texts.select("key", "text").join(lists, "key").select("text", "each").mapInArrow(cut, "a long, c binary, k long, m long, left binary, right binary")

    def _some(self) -> int:
        """Contexts that are handled at a time: about 6 MB."""
        return max(1, 8000 * (2 * LEAST_SPAN) // (self.before + self.reach + GRAM))

    def _scanned(self, emit, schema: str) -> DataFrame:
        """emit over the contexts of whole anchors, those of at most `limit` contexts, some thousand contexts at a time."""
        few = self.contexts.filter(F.col("m") <= self.limit).select("a", "c", "left", "right").repartition("a").sortWithinPartitions("a")
        span, some = self.span, self._some()

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for b in batches:
                if not b.num_rows:
                    continue
                cut = b.num_rows
                a = b.column("a").to_numpy()
                held_n = sum(x.num_rows for x in held)
                if held_n + cut >= some:  # whole anchors only: cut where the last one begins
                    last = int(np.searchsorted(a, a[-1]))
                    if last or (held and held[-1].column("a")[-1].as_py() != a[-1]):
                        yield from emit(pa.Table.from_batches([*held, b.slice(0, last)]), span)
                        held = [b.slice(last)]
                        continue
                held.append(b)
            if held:
                yield from emit(pa.Table.from_batches(held), span)

        return few.mapInArrow(scan, schema)

    def covers(self) -> DataFrame:
        """a, c, l, r: around the occurrences of context c the bytes [pos - l, pos + r) are repeated."""
        full = self.each.filter("k > 1").select("a", "c", F.lit(self.span - GRAM).alias("l"), F.lit(self.span).alias("r"))
        out = pa.schema([("a", pa.int64()), ("c", pa.binary()), ("l", pa.int32()), ("r", pa.int32())])

        def emit(t: pa.Table, span: int) -> Iterator[pa.RecordBatch]:
            a, c = t.column("a").to_numpy(), t.column("c").to_pylist()
            l, r = np.full(len(a), -1), np.full(len(a), -1)
            for x, y, members in repeat_scan(a, t.column("left").to_pylist(), t.column("right").to_pylist(), span):
                l[members], r[members] = np.maximum(l[members], x), np.maximum(r[members], y)
            at = np.flatnonzero(r >= 0)
            if len(at):
                yield batch(out, [(int(a[i]), c[i], int(l[i]), int(r[i])) for i in at])

        return full.unionByName(self._scanned(emit, "a long, c binary, l int, r int")).unionByName(self._counted())

    def _reach(self, many: DataFrame) -> DataFrame:
        """a, c, l, r: how far at most a context agrees with another one of its anchor, to the left and to the right.

        Beginnings of some lengths are hashed and counted; between two lengths the longer one, less a byte, bounds it.
        """
        steps = {0: [n for n in LADDER if n <= self.span - GRAM], 1: [n for n in LADDER if GRAM < n <= self.span]}
        out = pa.schema([("a", pa.int64()), ("side", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("c", pa.binary())])

        def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols = zip(*(b.column(x).to_pylist() for x in ("a", "c", "left", "right")))
                rows = ((a, side, n, xxhash.xxh3_64_intdigest(part[:n]) - (1 << 63), c) for a, c, left, right in cols for side, part in ((0, left), (1, right)) for n in steps[side] if n <= len(part))
                yield from rows_out(out, rows, 1 << 17)

        rows = many.mapInArrow(beginnings, "a long, side int, n int, h long, c binary")
        keys = ["a", "side", "n", "h"]
        shared = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("t")).filter("t > 1").select(*keys), "beginnings", self.place)
        far = rows.join(shared, keys).groupBy("a", "c").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))

        def bound(col: str, ns: list[int], least: int, most: int) -> F.Column:
            up = F.lit(ns[0] - 1 if ns else most)
            for n, above in zip(ns, [*(x - 1 for x in ns[1:]), most]):
                up = F.when(F.col(col) == n, above).otherwise(up)
            return F.greatest(F.coalesce(up, F.lit(least)), F.lit(least))

        return far.select("a", "c", bound("l", steps[0], 0, self.span - GRAM).alias("l"), bound("r", steps[1], GRAM, self.span).alias("r"))

    def _counted(self) -> DataFrame:
        """The same for anchors of more contexts: windows that occur in two contexts, by counting their hashes.

        Only windows within the reach of a context are hashed; others occur once.
        """
        many, span = self.contexts.filter(F.col("m") > self.limit).select("a", "c", "left", "right"), self.span
        reach = self._reach(many)
        near = reach.filter(F.col("l") + F.col("r") >= span).select("a", "c", F.col("l").alias("far_l"), F.col("r").alias("far_r"))
        out = pa.schema([("w", pa.int64()), ("w2", pa.int64()), ("a", pa.int64()), ("c", pa.binary()), ("l", pa.int32())])

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a, c, left, right, far_l, far_r in zip(*(b.column(x).to_pylist() for x in ("a", "c", "left", "right", "far_l", "far_r"))):
                    most, least = min(far_l, len(left)), max(0, span - min(far_r, len(right)))
                    if most >= least:
                        data = np.frombuffer(left[:most][::-1] + right[: span - least], np.uint8)
                        w, w2 = (window_hashes(data, span, v).view(np.int64) for v in (_TABLE, _TABLE2))
                        n = len(w)
                        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(w2), pa.array(np.full(n, a)), pa.array([c] * n, pa.binary()), pa.array(np.arange(most, most - n, -1, np.int32))], schema=out)

        rows = many.join(near, ["a", "c"]).mapInArrow(windows, "w long, w2 long, a long, c binary, l int")
        rows = written(rows, "windows", self.place)
        keys = ["a", "l", "w", "w2"]  # a window is met once for each anchor in it, and place of the anchor
        twice = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("t")).filter("t > 1").select(*keys), "twice", self.place)
        return rows.join(twice, keys).groupBy("a", "c").agg(F.max("l").alias("l"), (F.lit(span) - F.min("l")).cast("int").alias("r"))

    def groups(self) -> DataFrame:
        """Maximal repeats of `span` bytes or more, of any length, with all occurrences: id (the MD5 of the bytes), length, key, start and n, the number of documents of that text.

        A repeat is maximal if the bytes before its occurrences aren't all the same, nor those behind it; ends of texts differ from
        all. Each level takes the repeats of span to twice span bytes, with anchors and contexts of that size, so that a level
        moves about as many bytes as the first; the next one doubles span, until no anchor occurs twice. A text that several
        documents have is a repeat itself, of one row. Left out are anchors with more than `limit` contexts of the first level's
        size, and accordingly fewer of longer ones.
        """
        top, span = self.texts.agg(F.max(F.octet_length("text"))).first()[0] or 0, self.span
        several = self.texts.filter((F.col("n") > 1) & (F.octet_length("text") >= span))
        every = several.select(F.col("key").alias("id"), F.octet_length("text").cast("int").alias("length"), "key", F.lit(0).alias("start"))
        while span <= top:
            level = copy.copy(self)
            level.limit = max(1, self.limit * self.span // span)
            level._search(span, span - GRAM + 1, 2 * span)
            if level.found.isEmpty():
                break
            every = every.unionByName(level._level())
            span *= 2
        return every.distinct().join(self.texts.select("key", "n"), "key").select("id", "length", "key", "start", "n")

    def _level(self) -> DataFrame:
        """id, length, key, start of the maximal repeats of span to twice span bytes: one that starts at most `before` - 1 bytes before its first anchor is seen whole from there, with a byte on either side."""
        before = self.before
        out = pa.schema([("id", pa.binary()), ("a", pa.int64()), ("c", pa.binary()), ("l", pa.int32()), ("length", pa.int32())])

        def emit(t: pa.Table, span: int) -> Iterator[pa.RecordBatch]:
            a, c, left, right = (t.column(x).to_pylist() for x in ("a", "c", "left", "right"))

            def rows():
                for l, r, members in repeat_scan(np.array(a), left, right, span):
                    members = members.tolist()
                    behind = {right[j][r : r + 1] for j in members}
                    if l >= before or l + r >= 2 * span or (len(behind) == 1 and behind != {b""}):  # cut off by the contexts, or all go on alike
                        continue
                    i = members[0]
                    name = hashlib.md5(left[i][:l][::-1] + right[i][:r]).digest()
                    for j in members:
                        yield name, a[j], c[j], l, l + r

            yield from rows_out(out, rows())

        found = written(self._scanned(emit, "id binary, a long, c binary, l int, length int"), "groups", self.place)
        places = F.explode(F.transform(F.sequence(F.lit(0), F.col("times") - 1), lambda i: F.col("pos") - F.col("l") + i * F.col("step")))
        return found.join(self.found, ["a", "c"]).select("id", "length", "key", places.alias("start"))

    def digests(self) -> DataFrame:
        """Per distinct text: key, n_bytes, n_removed, n_spans, kept_sha256, spans."""
        covers = written(self.covers(), "covers", self.place)
        spans = self.found.join(covers, ["a", "c"]).groupBy("key").agg(F.collect_list(F.struct((F.col("pos") - F.col("l")).alias("s"), (F.col("pos") + (F.col("times") - 1) * F.col("step") + F.col("r")).alias("e"))).alias("each"))
        span = self.span
        out = pa.schema([("key", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

        def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for key, n, text, each in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), text_bytes(b.column("text")), b.column("each")):
                    size = len(text)
                    depth = np.zeros(size + 1, np.int32)
                    if n > 1 and size >= span:
                        depth[0], depth[size] = 1, -1
                    elif each.is_valid:
                        v = each.values
                        s = np.clip(v.field("s").to_numpy(), 0, size)
                        e = np.clip(v.field("e").to_numpy(), 0, size)
                        np.add.at(depth, s, 1)
                        np.add.at(depth, e, -1)
                    gone = np.cumsum(depth[:size]) > 0
                    first, last = runs(gone)
                    kept = hashlib.sha256()
                    for a, z in zip([0, *last.tolist()], [*first.tolist(), size]):
                        kept.update(text[a:z])
                    rows.append((key, size, int(gone.sum()), len(first), kept.hexdigest()))
                yield from rows_out(out, rows, 1 << 20)

        joined = self.texts.join(spans, "key", "left").select("key", "n", "text", "each")
        return joined.mapInArrow(remove, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    def removed(self) -> DataFrame:
        """The digest of each document's text."""
        return self.keyed.select("doc_id", "key").join(written(self.digests(), "digests"), "key").drop("key")


    def close(self) -> None:
        """Deletes what the stages have written; removed() stays readable, groups() doesn't."""
        self.spark.sql(f"drop table {self.name}")
        discard(self.spark, self.place)


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    repeats = Repeats(table(spark, sf_dir, "documents"))
    out = repeats.removed()
    repeats.close()
    return out
