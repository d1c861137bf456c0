"""Near-duplicate documents: a chosen-path similarity join of word-shingle sets.

Every set has a signature of minwise values. In each of several independent trees a set walks from the root along its
minwise values at coordinates that the node it has reached chooses; sets that are alike walk together. Nodes that are small
enough are compared exhaustively; a larger one is first branched further, several ways at a time so that recall stays. With
16 trees of three levels a pair at the threshold of 0.85 is missed by all trees with a chance of about 3e-7. Candidates pass
a loose test on signatures (five deviations below the threshold) and then an exact one on full sets.

Scale: equal sets are one class and never compared. A class is first tested against one partner: of the nodes it is in, the
member that is in the largest nodes over all trees, which stands in the middle of its group; so a group of thousands of
copies is linked by about as many tests as it has members. After that only nodes that hold different components are looked
at, and in them only pairs across components, those outside the largest component against all, in blocks of `limit`. Blocks
hold keys and signatures first; a pair that meets in several nodes is a candidate in the first of them only. The texts of
members that have candidates are then dealt to the same blocks, where components that get linked count as one from then on,
so a block gives fewer links than it has members, and no list of pairs is ever written. If more than `limit` members are outside the largest component, the node branches
further. No node, class or list of links comes to the driver or as a whole to one task; of sets a task holds HELD bytes.

Words: A-Z lower-cased, `[^\\x20\\x09-\\x0D]+`. Fewer than five words form one shingle; without words a document is linked with
nothing. Null texts count as empty. Repeated rows and equal texts are linked. Null doc_ids take part and never name a
component unless alone. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, batch, discard, mix, rows_out, shared_folder, shingle_hashes, shuffle_partitions, table, text_bytes, written

SHINGLE, COORDS, TREES, DEPTH, LIMIT = 5, 128, 16, 3, 1000
#: Bytes of shingle sets that a task holds on to.
HELD = 64_000_000
#: Pairs of signatures that are compared at a time.
PAIRS = 8192
#: A node that is still too large branches so many ways, two levels deeper each; a pair at 0.85 walks on together with a chance of 0.979.
WAYS, DEEPER, ROUNDS = 3, 2, 6


def shingle_set(text: bytes, h: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = h.of(text.translate(LOWER).split())
    if not len(words):
        return words
    return np.unique(shingle_hashes(words, min(SHINGLE, len(words))) + np.uint64(min(SHINGLE, len(words))))


_SEEDS = mix(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).astype(np.uint32)


def signature(s: np.ndarray) -> np.ndarray:
    """Minwise values of COORDS linear permutations of the hashes' upper 32 bits."""
    out, top = np.full(COORDS, 0xFFFFFFFF, np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(top), 256):
        x = top[None, at : at + 256] * (_SEEDS[:COORDS, None] | np.uint32(1))
        x += _SEEDS[COORDS:, None]
        np.minimum(out, x.min(axis=1), out=out)
    return mixed32(out)


def mixed32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def walk(node: np.ndarray, sigs: np.ndarray, levels: int) -> np.ndarray:
    """From the given nodes on: each level's coordinate is chosen by the node, its value names the child."""
    rows = np.arange(len(sigs))
    for _ in range(levels):
        at = (mix(node) % np.uint64(COORDS)).astype(np.int64)
        node = mix(node * np.uint64(0x9E3779B97F4A7C15) + sigs[rows, at].astype(np.uint64) + np.uint64(1))
    return node


def roots(sigs: np.ndarray) -> np.ndarray:
    """The nodes at the end of the first levels, a column a tree."""
    starts = mix(np.arange(1, TREES + 1, dtype=np.uint64))
    return np.stack([walk(np.full(len(sigs), t, np.uint64), sigs, DEPTH) for t in starts], axis=1)


def alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sets have a similarity of percent / 100 or more."""
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def digest() -> F.Column:
    """What names a text among rows of one doc_id."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _words(column: pa.Array) -> np.ndarray:
    """Digests of 16 bytes as two numbers each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDS)


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, p, q) in batches that end where a block does; a batch more than a block is never waited for."""
    columns, held = ("node", "p", "q"), []
    for b in batches:
        if not b.num_rows:
            continue
        other = np.zeros(b.num_rows, bool)
        for c in columns:
            x = b.column(c).to_numpy()
            other |= x != x[-1]
        cut = int(other.nonzero()[0][-1]) + 1 if other.any() else 0  # where the batch's last block begins
        if held and (cut or any(held[-1].column(c)[-1].as_py() != b.column(c)[-1].as_py() for c in columns)):
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        elif cut:
            yield b.slice(0, cut)
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def candidates(t: pa.RecordBatch, least: int, percent: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, same): rows outside the largest component against all members of their block, PAIRS at a time: those of other components whose signatures agree in `least` places or more, and that meet in no earlier tree."""
    node, p, q = (t.column(c).to_numpy() for c in ("node", "p", "q"))
    sigs, sizes, comp = _sigs(t.column("sig")), t.column("n").to_numpy(), _words(t.column("comp"))
    first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
    last = np.concatenate([first[1:], [len(node)]])
    split = last - np.add.reduceat(t.column("out").to_numpy(zero_copy_only=False).astype(np.int64), first)  # members stand before those outside
    if depth == 0:
        at = roots(sigs).view(np.int64)
        tree = (at == node[:, None]).argmax(axis=1)
        there = np.array([x + x[:1] * (TREES - len(x)) for x in t.column("nodes").to_pylist()], np.int64)
        live = (at[:, :, None] == there[:, None, :]).any(axis=2) & (np.arange(TREES) < tree[:, None])

    def test(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.repeat([o for o, _ in held], [len(x) for _, x in held]), np.concatenate([x for _, x in held])
        ok = (comp[i] != comp[j]).any(axis=1) & (100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j]))
        i, j = i[ok], j[ok]
        same = (sigs[i] == sigs[j]).sum(axis=1)
        ok = same >= least
        i, j, same = i[ok], j[ok], same[ok]
        if depth == 0 and len(i):
            ok = ~((at[i] == at[j]) & live[i] & live[j]).any(axis=1)
            i, j, same = i[ok], j[ok], same[ok]
        return i, j, same

    held, n = [], 0
    for a, m, z in zip(first.tolist(), split.tolist(), last.tolist()):
        if a < m < z:
            members = np.arange(a, m)
            for o in range(m, z):
                held.append((o, members))
                n += m - a
                if n >= PAIRS:
                    yield test(held)
                    held, n = [], 0
    if held:
        yield test(held)


def components(edges: DataFrame, under: str | None = None) -> DataFrame:
    """Connected components of (x, y): (x, comp) with comp the least x of the component. Least labels of neighbours, with label jumping; a written table a round."""
    both = written(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges", under)
    labels = written(both.groupBy("x").agg(F.least(F.first("x"), F.min("y")).alias("comp")), "labels", under)
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), "comp"), "y").groupBy("x").agg(F.min("comp").alias("near"))
        lower = labels.join(near, "x").select("x", "comp", F.least("comp", "near").alias("low"))
        up = labels.select(F.col("x").alias("low"), F.col("comp").alias("jump"))
        step = written(lower.join(up, "low").select("x", F.least("low", "jump").alias("comp"), (F.least("low", "jump") != F.col("comp")).alias("moved")), "labels", under)
        labels = step.select("x", "comp")
        if step.filter("moved").isEmpty():
            return labels


class NearDuplicates:
    """The join over documents at a similarity of percent / 100."""

    def __init__(self, docs: DataFrame, percent: int = 85, limit: int = LIMIT):
        self.spark, self.percent, self.limit = docs.sparkSession, percent, limit
        self.place = shared_folder(self.spark, "near")  # of all that is only read until components are known
        self.least = int((percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / COORDS) ** 0.5) * COORDS)
        base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        base = base.withColumn("digest", digest())
        self.docs = written(base.mapInArrow(self._signed, "doc_id long, digest binary, n_shingles int, key binary, sig binary, body binary"), "sets", self.place)
        self.name, self.found = f"classes_{uuid.uuid4().hex}", None
        one = self.docs.filter("key is not null").groupBy("key").agg(F.first(F.struct("sig", "body", "n_shingles")).alias("v"))
        one = one.select("key", F.col("v.n_shingles").alias("n"), "v.sig", "v.body")
        one.write.bucketBy(shuffle_partitions(self.spark), "key").sortBy("key").option("path", f"{self.place}/classes").saveAsTable(self.name)
        self.classes = self.spark.table(self.name)

    @staticmethod
    def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's set size, the set's name, its signature and the packed text, in one pass."""
        h, pack = WordHashes(), zstandard.ZstdCompressor(1)
        out = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int32()), ("key", pa.binary()), ("sig", pa.binary()), ("body", pa.binary())])

        def rows():
            for b in batches:
                for doc_id, name, text in zip(b.column("doc_id").to_pylist(), b.column("digest").to_pylist(), text_bytes(b.column("text"))):
                    s = shingle_set(text, h)
                    if len(s):
                        yield doc_id, name, len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes(), pack.compress(text)
                    else:
                        yield doc_id, name, 0, None, None, None

        yield from rows_out(out, rows(), 2000)

    def _roots(self) -> DataFrame:
        """(node, x): the places of each class at the end of the first levels."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    for node in roots(_sigs(b.column("sig"))).T:
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(node).view(np.int64)), b.column("key")], names=["node", "x"])

        return self.classes.select("key", "sig").mapInArrow(place, "node long, x binary")

    def _shared(self, members: DataFrame) -> DataFrame:
        """Members of nodes with at least two, with the node's size m."""
        nodes = written(members.groupBy("node").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "nodes", self.place)
        return written(members.join(nodes, "node"), "members", self.place)

    def _partners(self, members: DataFrame) -> DataFrame:
        """(x, y): for each class the middle member of the node that it shares most often with its middle."""
        place = written(members.groupBy("x").agg(F.sum("m").alias("p")), "places", self.place)
        middle = members.join(place, "x").groupBy("node").agg(F.max(F.struct("p", "x")).alias("t")).select("node", F.col("t.x").alias("y"))
        pairs = members.join(written(middle, "middles", self.place), "node").filter("x <> y")
        return pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("k")).groupBy("x").agg(F.max_by("y", F.struct("k", "y")).alias("y"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) whose full sets are alike enough."""
        pairs = written(pairs, "pairs", self.place)
        keys = written(pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct(), "keys", self.place)
        bodies = written(self.classes.select("key", "body").join(keys, "key", "left_semi"), "bodies", self.place)
        percent = self.percent

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, unpack = WordHashes(), zstandard.ZstdDecompressor()
            last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
            for b in batches:
                keep = []
                for y, p, q in zip(b.column("y").to_pylist(), b.column("px"), b.column("py")):
                    if last[0] != y:
                        last = (y, shingle_set(unpack.decompress(q.as_py()), h))
                    keep.append(alike(shingle_set(unpack.decompress(p.as_py()), h), last[1], percent))
                yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

        half = pairs.join(bodies.select(F.col("key").alias("y"), F.col("body").alias("py")), "y")
        whole = half.join(bodies.select(F.col("key").alias("x"), F.col("body").alias("px")), "x")
        # Dealt by x, so that a partner of thousands is in many tasks; in order of y, so that each builds its set once.
        return written(whole.select("x", "y", "px", "py").sortWithinPartitions("y").mapInArrow(test, "x binary, y binary"), "links", self.place)

    def _mixed(self, members: DataFrame, comps: DataFrame) -> DataFrame:
        """Members of nodes that hold several components: node, x, comp, total, top (the largest component), rest (members outside it)."""
        named = written(members.select("node", "x").join(comps, "x", "left").withColumn("comp", F.coalesce("comp", "x")), "named", self.place)
        sizes = named.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("k"))
        nodes = sizes.groupBy("node").agg(F.max(F.struct("k", "comp")).alias("t"), F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"))
        nodes = written(nodes.filter("n > 1").select("node", "total", F.col("t.comp").alias("top"), (F.col("total") - F.col("t.k")).alias("rest")), "mixed", self.place)
        return written(named.join(nodes, "node"), "across", self.place)

    def _deeper(self, rows: DataFrame) -> DataFrame:
        """(node, x) of the children of large nodes."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    sigs, node = _sigs(b.column("sig")), b.column("node").to_numpy().view(np.uint64)
                    for way in range(WAYS):
                        child = walk(mix(node + np.uint64(way + 1)), sigs, DEEPER)
                        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column("x")], names=["node", "x"])

        return rows.select("node", "x").join(self.classes.select(F.col("key").alias("x"), "sig"), "x").mapInArrow(place, "node long, x binary")

    def across(self, members: DataFrame, comps: DataFrame) -> DataFrame:
        """Links (x, y) between components, out of nodes that hold several."""
        found: DataFrame | None = None
        for depth in range(ROUNDS + 1):
            mixed = self._mixed(members, comps)
            if mixed.isEmpty():
                break
            fits = (F.col("rest") <= self.limit) | F.lit(depth == ROUNDS)
            part = self._compared(mixed.filter(fits), depth)
            found = part if found is None else found.unionByName(part)
            large = mixed.filter(~fits)
            if large.isEmpty():
                break
            members = self._shared(self._deeper(large))
        if found is None:
            return self.spark.createDataFrame([], "x binary, y binary")
        return written(found, "links", self.place)

    def _compared(self, rows: DataFrame, depth: int) -> DataFrame:
        """Links out of blocks of a node: some of all its members, and some of those outside its largest component; each pair of blocks meets in one group."""
        limit, least, percent = self.limit, self.least, self.percent
        a, b = F.ceil(F.col("total") / limit).cast("int"), F.ceil(F.col("rest") / limit).cast("int")
        side = F.xxhash64("x")
        cols = ("node", "x", "comp")
        every = rows.select(*cols, F.lit(False).alias("out"), F.pmod(side, a).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), b - 1)).alias("q"))
        outs = rows.filter("comp <> top").select(*cols, F.lit(True).alias("out"), F.explode(F.sequence(F.lit(0), a - 1)).alias("p"), F.pmod(side, b).cast("int").alias("q"))
        known = written(rows.groupBy("x").agg(F.collect_set("node").alias("nodes")), "known", self.place)  # at most TREES a class and round
        known = known.join(self.classes.select(F.col("key").alias("x"), "n", "sig"), "x")
        block = ["node", "p", "q"]
        dealt = lambda r: r.repartition(*block).sortWithinPartitions(*block, "out")

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The members that have a candidate."""
            for t in whole_blocks(batches):
                use = np.zeros(t.num_rows, bool)
                for i, j, _ in candidates(t, least, percent, depth):
                    use[i] = use[j] = True
                if use.any():
                    yield t.filter(pa.array(use))

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, unpack, out = WordHashes(), zstandard.ZstdDecompressor(), pa.schema([("x", pa.binary()), ("y", pa.binary())])
            for t in whole_blocks(batches):
                name, comp, bodies = t.column("x").to_pylist(), t.column("comp").to_pylist(), t.column("body")
                root: dict[bytes, bytes] = {}
                sets: dict[int, np.ndarray] = {}
                held, at, found = 0, None, []

                def find(c: bytes) -> bytes:
                    top = c
                    while top in root:
                        top = root[top]
                    while c != top:
                        root[c], c = top, root[c]
                    return top

                def members(i: int) -> np.ndarray:
                    nonlocal held
                    if i not in sets:
                        if held > HELD:
                            sets.clear()
                            held = 0
                        sets[i] = shingle_set(unpack.decompress(bodies[i].as_py()), h)
                        held += sets[i].nbytes + 200
                    return sets[i]

                for i, j, same in candidates(t, least, percent, depth):
                    for o, m in zip(i[order := np.argsort(-same, kind="stable")].tolist(), j[order].tolist()):
                        x, y = find(comp[o]), find(comp[m])
                        if x != y and alike(members(o), members(m), percent):
                            root[x] = y
                            found.append((name[o], name[m]))
                if found:
                    yield batch(out, found)

        kept_rows = "node long, p int, q int, out boolean, x binary, comp binary, n int, sig binary, nodes array<long>"
        names = [x.split()[0] for x in kept_rows.split(", ")]
        placed = every.unionByName(outs).join(known, "x").select(*names)
        near = written(dealt(placed).mapInArrow(some, kept_rows), "candidates", self.place)
        texts = near.join(self.classes.select(F.col("key").alias("x"), "body"), "x").select(*names, "body")
        return dealt(texts).mapInArrow(link, "x binary, y binary")

    def classed(self) -> DataFrame:
        """(x, comp) of the classes that are linked with another."""
        members = self._shared(self._roots())
        links = self.verified(self._partners(members))
        more = self.across(members, components(links, self.place))
        return components(links.unionByName(more), self.place)

    def _named(self) -> DataFrame:
        """doc_id, digest, n_shingles and comp, the name of a row's component, null if it has no words."""
        if self.found is None:
            rows = self.docs.select("doc_id", "digest", "n_shingles", "key")
            named = rows.join(self.classed().withColumnRenamed("x", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
            self.found = written(named.select("doc_id", "digest", "n_shingles", "comp"), "named")
            self.spark.sql(f"drop table {self.name}")
            discard(self.spark, self.place)
        return self.found

    def grouped(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept per row."""
        named = self._named()
        least = written(named.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")), "least")
        out = named.join(least, "comp", "left").withColumn("component_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")))
        return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

    def survivors(self) -> DataFrame:
        """doc_id and digest of one row of each component, the one with the least doc_id (null last), then digest; and of all rows without words."""
        named = self._named()
        one = named.filter("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("t"))
        return one.select("t.doc_id", "t.digest").unionByName(named.filter("comp is null").select("doc_id", "digest").distinct())


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(table(spark, sf_dir, "documents")).grouped()


#: The same by an exact join on shingles, and components by spreading least ids.
OP7_SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, hash(array_to_string(ws[i : i + least(len(ws), 5) - 1], ' ')) as sh from w, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) t(i) where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (select a.doc_id as x, b.doc_id as y from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
          group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
pairs as (select x, y from links union all select y, x from links),
reach(x, y) as (select doc_id, doc_id from documents union select reach.x, pairs.y from reach join pairs on reach.y = pairs.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n on n.doc_id = d.doc_id join (select x, min(y) as component_id from reach group by x) c on c.x = d.doc_id
"""
