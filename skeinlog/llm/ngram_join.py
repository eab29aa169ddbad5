"""N-gram Jaccard join: groups of documents whose word-shingle sets are linked.

Two documents are linked when |A and B| / |A or B| reaches p / q. Links are found in prefix trees of
globally ordered sets (see trie_join); what follows here deals the sets to trees so that every link is
found in one.

1. A fixed-size table of counters, summed over all texts, tells frequent shingles from the rest. It
   gives the global order of the trees and ranks signatures, so its collisions cannot change a result.
2. Sets of up to M elements that are linked differ in at most k = 2 M (q - p) / (q + p) elements. A
   set is cut by hash ranges into k + 1 + slack parts, so at least slack + 1 parts of linked sets
   are equal. A part is the stronger the more infrequent, and then the more elements it has; each
   set leaves out its slack weakest parts and signs the rest. Of two linked sets take the one whose
   weakest signed part is stronger: one of the slack + 1 equal parts is signed by it, and hence by
   the other too. Sets are signed for the size class they are in and those their larger partners can be in.
3. Sets that sign the same part are tied in a star around the least of them, first within each task,
   so that a part is sent once by a task, then for each part. What is sent is ten bytes for a part: 40 bits of
   its hash besides those that tell its bucket, and its least node; a row holds what a task has for a bucket.
   Signatures or nodes that agree by chance are candidates more, no links. Connected components of
   the stars hold every link. Copies of a set are one node from the start.
4. One text of each node goes to its component's tree. A component that weighs more than `block` is dealt
   to several trees, and its hub, the set with the fewest infrequent shingles, goes to all of them: what is
   joined with the hub in any tree is one group. Only sets of such components that were not joined with
   the hub look for links in the other trees, in pieces that weigh as little.
5. The links found give the final components.

Defined results: words are runs of what isn't ASCII white space, with A-Z lower-cased; a text of
fewer words than the width is one shingle; null, empty and blank texts have none and are linked with
nothing. Whole texts count, however long; one that weighs more than `block` is a block of its own. Sets
are compared by 64-bit shingle hashes and known by 104 bits of a digest. A row whose doc_id is null takes
part in links; its group is the smallest id reachable, or null. Repeated rows get equal results, and
ties of any kind are broken by digest, id and hash of the text. Extra columns never clash. An empty table
gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import connected_components
from .shingles import WordHashes, mix, set_digest, shingle_sets
from .trie_join import components

COUNTER_BITS = 22
SLICES = 256
#: Signatures that a task ties and sends at once, buckets that they are dealt to, and bits of a node.
FLUSH, BUCKETS, NODE_BITS = 1 << 20, 1 << 12, 40
#: What the sets of a tree weigh: their shingles and SET_WEIGHT for each set.
BLOCK = 100_000
SET_WEIGHT = 200
SALTS = 32


def count_shingles(texts: DataFrame, width: int, bits: int = COUNTER_BITS) -> np.ndarray:
    """Counters by the low bits of the shingle's hash, summed over all texts. A task's share in a
    counter stops at 255; what reaches the driver is 2 ** bits counters, however large the corpus."""
    size = 1 << bits
    step = size // SLICES

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = WordHashes(), np.zeros(size, np.uint32)
        for batch in batches:
            sets = shingle_sets(batch.column(0).cast(pa.binary()).to_pylist(), width, words)
            if sets:
                at, n = np.unique(np.concatenate(sets) & np.uint64(size - 1), return_counts=True)
                total[at] += n.astype(np.uint32)
        if total.any():
            slim = np.minimum(total, 255).astype(np.uint8).reshape(SLICES, step)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in slim], pa.binary())], names=["slice", "counters"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(blob.as_buffer(), np.uint8).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in sums.values()], pa.binary())], names=["slice", "counters"])

    out = np.zeros((SLICES, step), np.int64)
    with common.small_batches(texts.sparkSession):
        shares = common.map_arrow(texts, share, "slice int, counters binary").repartition(min(SLICES, common.partitions(texts.sparkSession)), "slice")
        sums = common.map_arrow(shares, add, "slice int, counters binary").collect()  # SLICES rows, of fixed size
    for row in sums:
        out[row["slice"]] = np.frombuffer(row["counters"], "<u4")
    return out.ravel()


def frequent(counters: np.ndarray) -> np.ndarray:
    """Which counters stand out from the mean load and its noise."""
    load = counters.mean() if len(counters) else 0
    return counters > load + 6 * load**0.5 + 16


def level_of(counters: np.ndarray) -> np.ndarray:
    """The order of magnitude (to base 2) of each counter, in a byte."""
    return np.frexp(counters.astype(float))[1].astype(np.uint8)


class Signer:
    """Signatures of sets, such that linked sets have one in common."""

    def __init__(self, p: int, q: int, often: np.ndarray):
        self.p, self.q, self.often = p, q, often
        self.mask = np.uint64(len(often) - 1)
        self.tops = [1]
        self.cuts: dict[int, np.ndarray] = {}

    def classes(self, n: int) -> Iterator[int]:
        """Greatest sizes of the classes of a set of n and of the larger sets it can be linked with."""
        most = n * self.q // self.p
        while self.tops[-1] < most:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 13 // 10))
        i = bisect_left(self.tops, n)
        yield self.tops[i]
        while i + 1 < len(self.tops) and self.tops[i] + 1 <= most:
            i += 1
            yield self.tops[i]

    def rare(self, s: np.ndarray) -> int:
        """Infrequent elements of a set."""
        return len(s) - int(np.count_nonzero(self.often[(s & self.mask).astype(np.int64)]))

    def __call__(self, s: np.ndarray) -> np.ndarray:
        spread = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s))))
        rare = np.concatenate((np.zeros(1, np.int64), np.cumsum(~self.often[(s & self.mask).astype(np.int64)])))
        out = []
        for top in self.classes(len(s)):
            differ = 2 * top * (self.q - self.p) // (self.q + self.p)
            slack = (differ + 1) // 2
            parts = differ + 1 + slack
            if top not in self.cuts:
                self.cuts[top] = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
            at = np.concatenate(([0], np.searchsorted(s, self.cuts[top]), [len(s)]))
            strength = (rare[at[1:]] - rare[at[:-1]]) * (1 << 32) + np.diff(at)
            signed = np.flatnonzero(strength >= np.sort(strength)[slack])
            value = spread[at[signed + 1]] - spread[at[signed]]
            out.append(mix(value ^ mix(np.uint64(top << 32) + signed.astype(np.uint64))))
        return np.concatenate(out)


def stars(signs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct signs with their least node, and edges from the other nodes of a sign to that."""
    order = np.argsort(signs, kind="stable")
    signs, nodes = signs[order], nodes[order]
    first = np.flatnonzero(np.concatenate(([True], signs[1:] != signs[:-1]))) if len(signs) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(nodes, first) if len(signs) else nodes
    hub = np.repeat(least, np.diff(np.append(first, len(signs))))
    tied = nodes != hub
    edges = np.unique(np.stack((nodes[tied], hub[tied]), axis=1), axis=0)
    return signs[first], least, edges[:, 0], edges[:, 1]


FACTS = "kind int, bucket int, a bigint, b bigint, row struct<doc_id:bigint,row_key:bigint,n:bigint,node:bigint,node2:bigint,rare:bigint>, signs binary"
ROW, EDGE, SIGN = 0, 1, 2
ROW_TYPE = pa.struct([(k, pa.int64()) for k in ("doc_id", "row_key", "n", "node", "node2", "rare")])
BUCKET_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def facts(kind: int, bucket: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None, row: pa.Array | None = None, signs: pa.Array | None = None) -> pa.RecordBatch:
    n = len(bucket)
    cols = [pa.array(np.full(n, kind, np.int32)), pa.array(bucket.astype(np.int32)), *(pa.nulls(n, pa.int64()) if x is None else pa.array(x) for x in (a, b))]
    cols += [pa.nulls(n, ROW_TYPE) if row is None else row, pa.nulls(n, pa.binary()) if signs is None else signs]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "bucket", "a", "b", "row", "signs"])


def edge_facts(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return facts(EDGE, mix(a.view(np.uint64)) >> BUCKET_SHIFT, a, b)


def packed(signs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Buckets of sorted signs, and for each its signs and their nodes, five bytes either."""
    bucket = signs >> BUCKET_SHIFT
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    both = np.empty((len(signs), 10), np.uint8)
    both[:, :5] = signs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    both[:, 5:] = nodes.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5]
    at = np.append(first, len(signs)).astype(np.int32) * 10
    return bucket[first], pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(both)])


def unpacked(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The signs, without their buckets, and nodes of some rows of packed()."""
    both = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 10)
    wide = np.zeros((2, len(both), 8), np.uint8)
    wide[0, :, :5], wide[1, :, :5] = both[:, :5], both[:, 5:]
    return wide[0].reshape(-1).view("<u8"), wide[1].reshape(-1).view("<i8")


def sign_texts(rows: DataFrame, width: int, p: int, q: int, often: np.ndarray) -> DataFrame:
    """rows (doc_id, row_key, text) to facts. ROW: row has the ids, n, node and node2 (of the set's digest) and rare (its
    infrequent shingles); bucket spreads them. EDGE: nodes a and b are tied. SIGN: packed() signs of a bucket."""
    shared = np.packbits(often).tobytes()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signer = WordHashes(), Signer(p, q, np.unpackbits(np.frombuffer(shared, np.uint8)).astype(bool))
        signs, nodes, held, place = [], [], 0, 0

        def ties() -> Iterator[pa.RecordBatch]:
            sign, node, a, b = stars(np.concatenate(signs), np.concatenate(nodes))
            yield edge_facts(a, b)
            bucket, data = packed(sign, node)
            for i in range(0, len(bucket), common.BATCH_ROWS):
                yield facts(SIGN, bucket[i : i + common.BATCH_ROWS], signs=data[i : i + common.BATCH_ROWS])

        with np.errstate(over="ignore"):
            for batch in batches:
                sets = shingle_sets(batch.column(2).cast(pa.binary()).to_pylist(), width, words)
                digests = np.array([set_digest(s) if len(s) else (0, 0) for s in sets], np.int64).reshape(-1, 2)
                digests[:, 0] &= (1 << NODE_BITS) - 1
                size = np.array([len(s) for s in sets], np.int64)
                rare = np.array([signer.rare(s) for s in sets], np.int64)
                row = pa.StructArray.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (size, digests[:, 0], digests[:, 1], rare))], fields=list(ROW_TYPE))
                spread = mix(digests[:, 1].view(np.uint64) + np.arange(place, place + len(sets), dtype=np.uint64)) >> BUCKET_SHIFT
                place += len(sets)
                yield facts(ROW, spread, row=row)
                for s, v in zip(sets, digests[:, 0], strict=True):
                    if len(s):
                        signs.append(signer(s))
                        nodes.append(np.full(len(signs[-1]), v))
                        held += len(signs[-1])
                        if held >= FLUSH:
                            yield from ties()
                            signs, nodes, held = [], [], 0
            if held:
                yield from ties()

    return common.map_arrow(rows, sign, FACTS)


def tied(signed: DataFrame) -> DataFrame:
    """The facts of sign_texts() with edges for signs: those that sets of several tasks have in common. A task has sent
    a part once, with its least node, so a part that a third of all sets sign is ten bytes for each task here. Signs
    are shuffled, but not stored; a bucket of them is in memory at a time."""

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, data, edges, held = None, [], [np.zeros((0, 2), np.int64)], 0

        def end() -> None:
            nonlocal held
            if len(data) > 1:
                edges.append(np.stack(stars(*unpacked(data))[2:], axis=1))
                held += len(edges[-1])

        def found() -> pa.RecordBatch:
            return edge_facts(*np.unique(np.concatenate(edges), axis=0).T.copy())

        with np.errstate(over="ignore"):
            for batch in batches:
                signs = pc.equal(batch.column(0), SIGN)
                yield batch.filter(pc.invert(signs))
                for bucket, blob in zip(*batch.filter(signs).select(["bucket", "signs"]).columns, strict=True):
                    if bucket.as_py() != last:
                        end()
                        last, data = bucket.as_py(), []
                    data.append(blob.as_py())
                if held >= FLUSH:
                    yield found()
                    edges, held = edges[:1], 0
            end()
            yield found()

    dealt = signed.repartition(common.partitions(signed.sparkSession), "bucket").sortWithinPartitions("bucket")
    return common.map_arrow(dealt, tie, FACTS).drop("bucket", "signs")


TREES = "array<struct<i:bigint,j:bigint,asks:boolean>>"


def join_trees(texts: DataFrame, width: int, p: int, q: int, levels: np.ndarray) -> DataFrame:
    """texts (component, i, j, asks, own1, own2, text), those of a tree (component, i, j) in a row, to the groups
    joined in any tree: of group (node, node2) the group that it is part of (to1, to2). Sets with the same own1,
    own2 are one group from the start; only sets that ask look up their links. The first set's group keeps its name."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)  # 2 ** COUNTER_BITS bytes, however large the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tree, sets = WordHashes(), None, {}

        def end() -> Iterator[pa.RecordBatch]:
            if len(sets) < 2:
                return
            known, asks, first = [], [], {}
            for i, (_, own, asked) in enumerate(sets.values()):
                known.append(first.setdefault(own, i))
                asks.append(asked)
            root = components([s for s, _, _ in sets.values()], p, q, shared.value, np.array(known), np.array(asks))
            names = [own for _, own, _ in sets.values()]
            moved = list(dict.fromkeys((*names[i], *names[r]) for i, r in enumerate(root.tolist()) if names[i] != names[r]))
            if moved:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in moved], pa.int64()) for k in range(4)], names=["node", "node2", "to1", "to2"])

        for batch in batches:
            found = shingle_sets(batch.column(6).cast(pa.binary()).to_pylist(), width, words)
            rows = list(zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True))
            for (*at, asks, own1, own2), s in zip(rows, found, strict=True):
                if at != tree:
                    yield from end()
                    tree, sets = at, {}
                sets.setdefault(set_digest(s), (s, (own1, own2), asks))
        yield from end()

    return common.map_arrow(texts, run, "node bigint, node2 bigint, to1 bigint, to2 bigint")


def deal(rows: DataFrame, near: DataFrame) -> DataFrame:
    """The texts of near (component, own1, own2, first, rep_id, rep_key, repeated, trees), a row for each of a text's
    trees, those of a tree in a row, `first` ones first. Where rows repeat a text under one doc_id, one of them goes."""

    def texts_of(near: DataFrame) -> DataFrame:
        likely = common.flag_likely(rows, F.xxhash64("doc_id", "row_key"), near, F.xxhash64("rep_id", "rep_key"), "likely").filter("likely")
        texts = likely.join(near, likely["doc_id"].eqNullSafe(near["rep_id"]) & (likely["row_key"] == near["rep_key"]))
        return texts.select("component", "own1", "own2", "first", "rep_id", "rep_key", "trees", "text")

    texts = texts_of(near.filter("not repeated"))
    several = near.filter("repeated")
    if not several.isEmpty():  # with partial aggregates, so that a row that a third of all rows repeat is one row per task
        one = texts_of(several).groupBy("component", "own1", "own2", "first", "rep_id", "rep_key", "trees").agg(F.min("text").alias("text"))
        texts = texts.unionByName(one.select(*texts.columns))
    texts = texts.select("component", "own1", "own2", "first", F.explode("trees").alias("at"), "text").select("component", "at.i", "at.j", "at.asks", "own1", "own2", "text", "first")
    texts = texts.repartition(common.partitions(rows.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j", F.desc("first"))
    return texts.drop("first")


def tree_groups(rows: DataFrame, near: DataFrame, width: int, p: int, q: int, levels: np.ndarray, block: int) -> tuple[DataFrame, DataFrame]:
    """near (component, node, node2, n, rare, rep_id, rep_key, repeated), whose sets are to be joined within components.

    Two tables: the sets (node, node2) that are part of another's group (to1, to2), and of those groups the ones
    that are part of a further group (g, to)."""
    weight = F.col("n") + SET_WEIGHT
    cut = lambda w: (F.floor((F.sum(w) - 1) / block) + 1).cast("bigint")
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    tree = lambda i, j, asks: F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"))
    zero, yes = F.lit(0).cast("bigint"), F.lit(True)

    def with_total(sets: DataFrame, totals: DataFrame) -> DataFrame:
        """sets with the totals of their component, if there are any; a component's sets are spread by salt, so that a
        large one is not one task. Only components of more than one block have totals."""
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        return sets.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(totals.withColumn("salt", salt), ["component", "salt"], "left").drop("salt")

    near = common.store(near)
    total = near.groupBy("component").agg(cut(weight).alias("blocks"), F.min(F.struct("rare", "node", "node2")).alias("hub")).filter("blocks > 1")
    near = with_total(near, total).withColumns({"blocks": F.coalesce("blocks", F.lit(1).cast("bigint")), "first": F.coalesce((F.col("node") == F.col("hub.node")) & (F.col("node2") == F.col("hub.node2")), F.lit(False))})
    near = common.store(near.withColumn("block", F.pmod(F.xxhash64("node", "node2"), F.col("blocks"))))
    trees = F.when(F.col("first"), F.transform(upto("blocks"), lambda i: tree(i, zero, yes))).otherwise(F.array(tree(F.col("block"), zero, yes))).cast(TREES)
    asked = near.select("component", F.col("node").alias("own1"), F.col("node2").alias("own2"), "first", "rep_id", "rep_key", "repeated", trees.alias("trees"))
    found = common.store(join_trees(deal(rows, asked), width, p, q, levels))

    # sets of cut components that no tree joined with the hub look for links in every block
    near = near.filter("blocks > 1").join(found, ["node", "node2"], "left").withColumns({"own1": F.coalesce("to1", "node"), "own2": F.coalesce("to2", "node2")})
    near = near.withColumn("outside", (F.col("own1") != F.col("hub.node")) | (F.col("own2") != F.col("hub.node2")))
    pieces = near.filter("outside").groupBy("component").agg(cut(weight).alias("pieces"))
    near = with_total(near, pieces).filter("pieces is not null").withColumn("piece", F.when(F.col("outside"), F.pmod(F.xxhash64("node2", "node"), F.col("pieces"))))
    home = F.transform(upto("pieces"), lambda j: tree(F.col("block"), j, F.coalesce(F.col("piece") == j, F.lit(False))))
    away = F.when(F.col("outside"), F.transform(F.filter(upto("blocks"), lambda i: i != F.col("block")), lambda i: tree(i, F.col("piece"), yes)))
    trees = F.concat(home.cast(TREES), F.coalesce(away.cast(TREES), F.array().cast(TREES)))
    asked = common.store(near.select("component", "own1", "own2", "first", "rep_id", "rep_key", "repeated", trees.alias("trees")))
    if asked.isEmpty():
        return found, None
    edges = join_trees(deal(rows, asked), width, p, q, levels).select(F.struct("node", "node2").alias("a"), F.struct(F.col("to1").alias("node"), F.col("to2").alias("node2")).alias("b"))
    return found, connected_components(edges).select(F.col("node").alias("g"), F.col("component").alias("to"))


def similar_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, p: int = 4, q: int = 5, block: int = BLOCK) -> DataFrame:
    """A row for each row of df: doc_id, row_key (hash of the text), n_shingles, node, component_id (the
    smallest doc_id reachable by links of p / q or more) and keeper_key (of that document's texts, the
    row_key that stands for the group)."""
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row_key"), F.col(text).alias("text"))
    counters = count_shingles(rows.select("text"), width)
    stored = common.store(tied(sign_texts(rows, width, p, q, frequent(counters))))
    docs = stored.filter(F.col("kind") == ROW).select("row.*")
    own_id = F.struct("doc_id", "row_key")
    classes = docs.filter("n > 0").groupBy("node", "node2").agg(F.max("n").alias("n"), F.max("rare").alias("rare"), F.min(own_id).alias("any"), F.min(F.when(F.col("doc_id").isNotNull(), own_id)).alias("rep"), (F.count("*") > 1).alias("repeated"))
    classes = common.store(classes)

    near = connected_components(stored.filter(F.col("kind") == EDGE).select("a", "b")).join(classes, "node")
    near = near.select("component", "node", "node2", "n", "rare", F.col("any.doc_id").alias("rep_id"), F.col("any.row_key").alias("rep_key"), "repeated")
    found, further = tree_groups(rows, near, width, p, q, level_of(counters), block)

    labels = classes.join(found, ["node", "node2"], "left")
    labels = labels.select("node", "node2", "rep", F.struct(F.coalesce("to1", "node").alias("node"), F.coalesce("to2", "node2").alias("node2")).alias("g"))
    if further is not None:
        labels = labels.join(further, "g", "left").withColumn("g", F.coalesce("to", "g")).drop("to")
    least = labels.groupBy("g").agg(F.min("rep").alias("least"))
    labels = labels.join(least, "g").select(F.col("node").alias("joined"), F.col("node2").alias("joined2"), "least")
    has = lambda c: F.when(F.col("n") > 0, F.col(c))
    out = docs.withColumns({"joined": has("node"), "joined2": has("node2")}).join(labels, ["joined", "joined2"], "left")
    return out.withColumn("least", F.when(F.col("n") > 0, F.col("least")).otherwise(own_id)).select("doc_id", "row_key", F.col("n").alias("n_shingles"), "node", F.col("least.doc_id").alias("component_id"), F.col("least.row_key").alias("keeper_key"))


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, p: int = 4, q: int = 5, block: int = BLOCK) -> DataFrame:
    """df with one row of each group of linked rows: that of the smallest doc_id (of the smallest hash of
    its text where an id has several). Rows without a word are linked with nothing and all stay; so do
    groups without any doc_id."""
    key, k, likely = common.fresh(df, "row_key"), common.fresh(df, "kept"), common.fresh(df, "likely")
    groups = similar_groups(df, text, doc_id, width, p, q, block).filter("n_shingles > 0 and component_id is not null")
    keeps = F.coalesce((F.col("doc_id") == F.col("component_id")) & (F.col("row_key") == F.col("keeper_key")), F.lit(False))
    rows = groups.groupBy("doc_id", "row_key").agg(F.count("*").alias("n"), F.bool_or(keeps).alias("keeps"))
    # rows that go, or that stay once of several: only these, and few others by chance, are shuffled with their texts
    rows = common.store(rows.filter("n > 1 or not keeps").select(F.col("doc_id").alias(f"{k}_id"), F.col("row_key").alias(f"{k}_key"), F.col("keeps").alias(k)))
    df = df.withColumn(key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    own = F.col(doc_id).cast("bigint")
    df = common.flag_likely(df, F.xxhash64(own, F.col(key)), rows, F.xxhash64(f"{k}_id", f"{k}_key"), likely)
    asked = df.filter(F.col(likely)).join(rows, own.eqNullSafe(F.col(f"{k}_id")) & (F.col(key) == F.col(f"{k}_key")), "left").drop(f"{k}_id", f"{k}_key")
    once = asked.filter(F.col(k)).dropDuplicates([doc_id, key]).drop(k)
    rest = df.filter(~F.col(likely)).unionByName(asked.filter(F.col(k).isNull()).drop(k)).unionByName(once)
    return rest.drop(key, likely)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.same_columns(common.documents(spark, sf_dir), ["doc_id", "text"])
    return similar_groups(docs, width=3, p=9, q=10).select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), overlap AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM overlap JOIN sizes p ON p.doc_id = x JOIN sizes r ON r.doc_id = y
  WHERE 100 * n_shared >= 90 * (p.n + r.n - n_shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.y AS b FROM reach JOIN links ON reach.b = links.x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN reach r ON r.a = d.doc_id
GROUP BY d.doc_id, n
"""
