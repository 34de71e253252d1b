"""N-gram Jaccard join with signature trees.

A document's set is its distinct 5-word shingles, hashed to 64 bits. Two documents link when their sets'
Jaccard similarity is 0.8 or more. Components are exact; links are as many as connect them, since two
documents that a canopy has connected already aren't compared again.

1. Equal sets are one node, named by a 64-bit sum of mixed shingle hashes; copies cost no more than that.
2. Prefixes bring candidates together: under one order of all shingles (rarer first, then by hash), two
   sets that link share one of the first n - ceil(0.8 n) + 1 shingles of each. Frequencies come from a
   sketch of counts over all shingles of all documents, as wide as the corpus asks for (at most 2^24
   counters); any order is exact, so collisions cost candidates and never links.
3. Every prefix shingle that several nodes have names the least of them as its leader. A leader and all
   nodes it leads are a canopy; two documents that link are in some canopy together. Canopies are as
   many rows as (node, leader) pairs, not pairs of documents.
4. A canopy is cut in blocks of about 256 nodes of like size (fewer where sets are long), and its leader
   joins each block. A block's nodes become a signature tree: a leaf has a bitmap of its set's shingles,
   four bits a shingle; a node of the tree has the OR of its children's bitmaps and the range of their
   sizes. The tree is traversed against itself: a pair of tree nodes is dropped when its sizes can't reach
   0.8, or when the bits that both have, with the most shingles that share a bit, are fewer than the least
   overlap that the sizes need. Only sets of surviving leaves travel. Their pairs are verified on the sets,
   those with the leader first, and pairs that are connected by then are left out.
5. Where a canopy has several blocks and nodes that aren't connected to its leader, its blocks meet in
   pairs: pairs are pruned by the OR of each block, then both trees are traversed against each other, and
   tree nodes that are connected to the leader as a whole are never paired. So a group of m near copies
   costs m verified links, not m squared.
6. Links make components.

Nulls and texts without words: an empty set, linked with nothing. Fewer than five words: one shingle,
the whole sequence. Very long texts: sets of any length; a block holds fewer of them. Repeated rows each
give a row. Rows of one id are one document, whatever their texts: what any of them reaches, all reach.
A row whose id is null takes part by its text; its component_id is the least id reachable, null if there
is none. Other columns, whatever their names, aren't read. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.arrowtext import Words, chunks, mix64, table64, utf8
from geostrata.llm.filters import bit_filter, passes
from geostrata.operators.components import connected_components
from geostrata.session import discard, materialize

N, NUM, DEN = 5, 80, 100
FANOUT, BLOCK, PAIR_BYTES = 8, 256, 8_000_000
#: Shingles of a block's sets at most (unless one pair has more), counters of a segment of the sketch, bytes of text worked on at once.
BLOCK_SHINGLES, SEGMENT, BLOCK_BYTES = 4_000_000, 1 << 16, 1_000_000
PLACE = table64(N, 77)
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(part: np.ndarray, o: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(part, o)
    h, n = w.hash, len(w.hash)
    sh = np.zeros(max(0, n - N + 1), np.uint64)
    for k in range(N):
        sh += h[k : n - N + 1 + k] * PLACE[k]
    sh = mix64(sh)
    out = []
    for k in range(len(o) - 1):
        a, b = w.first[k], w.first[k + 1]
        if b - a >= N:
            s = np.sort(sh[a : b - N + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            out.append(mix64((h[a:b] * PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def all_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, off = utf8(column)
    for lo, _, part, o in chunks(data, off, BLOCK_BYTES):
        yield lo, shingle_sets(part, o)


def sketch_bits(characters: int) -> int:
    """Bits of the number of counters: about eight shingles a counter, within 2^16 to 2^24 counters."""
    return min(24, max(16, int(characters // 48).bit_length()))


def sketched(bits: int):
    """For mapInArrow: counts of a partition's shingles by their leading bits, as compressed segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for b in batches:
            for _, sets in all_sets(b.column("text")):
                np.add.at(total, (np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        z, segments = zstandard.ZstdCompressor(level=1), total.reshape(-1, SEGMENT)
        for k in np.flatnonzero(segments.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([z.compress(segments[k].tobytes())], pa.binary())], ["segment", "counts"])

    return run


def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of segments, from rows sorted by segment, as weights of one byte: eight steps for each doubling."""
    z, unz = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    for t in grouped(batches, ["segment"]):
        total = np.zeros(SEGMENT, np.int64)
        for c in t.column("counts"):
            total += np.frombuffer(unz.decompress(c.as_py()), np.uint32)
        weight = np.minimum(255, np.rint(8 * np.log2(total + 1.0))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([t.column("segment")[:1].combine_chunks(), pa.array([z.compress(weight.tobytes())], pa.binary())], ["segment", "counts"])


def frequencies(docs: DataFrame) -> np.ndarray:
    """Weights of shingles by their leading bits; 16 MB at most, whatever the input."""
    bits = sketch_bits(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    parts = docs.select("text").mapInArrow(sketched(bits), "segment int, counts binary")
    rows = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(weighed, "segment int, counts binary")
    out, unz = np.zeros((1 << bits) // SEGMENT * SEGMENT, np.uint8), zstandard.ZstdDecompressor()
    for r in rows.toLocalIterator():
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(unz.decompress(bytes(r.counts)), np.uint8)
    return out


def bitmap(s: np.ndarray) -> np.ndarray:
    """Four bits a shingle, rounded up to a power of two: bit (hash mod width) for each."""
    width = 1 << max(6, int(4 * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def name_of(s: np.ndarray) -> int:
    """The node of a set."""
    return int((mix64(s ^ ONE) + mix64(s * TWO + ONE)).sum().view(np.int64)) if len(s) else 0


def describe(weights):
    """For mapInArrow: id, n, node, prefix and bitmap of each text. weights: broadcast frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = weights.value
        shift = np.uint64(64 - (len(weight) - 1).bit_length())
        for b in batches:
            for lo, sets in all_sets(b.column("text")):
                prefix = []
                for s in sets:
                    n = len(s)
                    p = n - -(-NUM * n // DEN) + 1 if n else 0
                    prefix.append(s[np.argsort(weight[(s >> shift).astype(np.int64)], kind="stable")[:p]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([name_of(s) for s in sets], pa.int64()),
                        pa.array(prefix, pa.list_(pa.int64())), pa.array([bitmap(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n", "node", "prefix", "bits"],
                )

    return run


def wanted_sets(words):
    """For mapInArrow: (node, set) of the texts that a broadcast bit filter over ids lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words.value
        for b in batches:
            use = np.flatnonzero(passes(w, b.column("h").to_numpy()))
            if len(use):
                b = b.take(pa.array(use))
                for _, sets in all_sets(b.column("text")):
                    yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])

    return run


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) at a smaller width."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class Tree:
    """A signature tree over sets of one bitmap width: levels from leaves to root."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, linked: np.ndarray, who: np.ndarray) -> None:
        order = np.lexsort((n, linked))
        self.who = who[order]
        bits, n, linked = bits[order], n[order], linked[order]
        shared = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, shared, linked)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, sh, li = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sh, at), np.logical_and.reduceat(li, at)))

    def at_width(self, width: int) -> Tree:
        if self.levels[0][0].shape[1] == width:
            return self
        b, n, _, _, li = self.levels[0]
        return Tree(folded(b, width), n, li, self.who)


def possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray) -> np.ndarray:
    """Whether node pairs (i of level x, j of level y) may hold a pair that links and isn't known."""
    ok = ~(x[4][i] & y[4][j])
    ok &= (DEN * x[2][i] >= NUM * y[1][j]) & (DEN * y[2][j] >= NUM * x[1][i])
    out = np.zeros(len(i), bool)
    live = np.flatnonzero(ok)
    step = max(1, PAIR_BYTES // x[0].shape[1])
    for k in range(0, len(live), step):
        p = live[k : k + step]
        both = np.bitwise_count(x[0][i[p]] & y[0][j[p]]).sum(axis=1, dtype=np.int64) + np.minimum(x[3][i[p]], y[3][j[p]])
        out[p] = (DEN + NUM) * both >= NUM * (x[1][i[p]] + y[1][j[p]])
    return out


def traverse(a: Tree, b: Tree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Leaves (of a, of b) that may link, by descending both trees from their roots."""
    width = min(a.levels[0][0].shape[1], b.levels[0][0].shape[1])
    a = a.at_width(width)
    b = a if same else b.at_width(width)
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep = possible(a.levels[la], i, b.levels[lb], j)
        i, j = i[keep], j[keep]
        if not len(i) or la == lb == 0:
            return a.who[i], b.who[j]
        down_a, down_b = la > 0 and la >= lb, lb > 0 and lb >= la
        if down_a:
            la -= 1
            i, j = children(i, j, len(a.levels[la][0]))
        if down_b:
            lb -= 1
            j, i = children(j, i, len(b.levels[lb][0]))
        if same and la == lb:
            keep = i < j if la == 0 else i <= j
            i, j = i[keep], j[keep]


def children(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    c = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    j = np.repeat(j, FANOUT)
    return c[c < n], j[c < n]


def forest(bits: list[bytes], n: np.ndarray, linked: np.ndarray, who: np.ndarray) -> dict[int, Tree]:
    """One tree for each bitmap width."""
    size = np.array([len(x) for x in bits])
    return {int(w): Tree(np.stack([np.frombuffer(bits[k], np.uint8) for k in np.flatnonzero(size == w)]), n[size == w], linked[size == w], who[size == w]) for w in np.unique(size)}


def join_forests(a: dict[int, Tree], b: dict[int, Tree], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents that may link. Widths further apart than a factor of two can't."""
    found = [traverse(ta, tb, same and wa == wb) for wa, ta in a.items() for wb, tb in b.items() if (wa <= wb if same else True) and wa <= 2 * wb and wb <= 2 * wa]
    return np.concatenate([x for x, _ in found] or [np.empty(0, np.int64)]), np.concatenate([y for _, y in found] or [np.empty(0, np.int64)])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from rows sorted by them."""
    held: list[pa.Table] = []
    for b in batches:
        if not len(b):
            continue
        change = np.zeros(len(b), bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
            yield pa.concat_tables(held)
            held = []
        cut = [0, *np.flatnonzero(change).tolist(), len(b)]
        t = pa.Table.from_batches([b])
        for p, q in zip(cut, cut[1:]):
            if p:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(p, q - p))
    if held:
        yield pa.concat_tables(held)


def column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leader, block, lo, hi, shared, linked, bits) of each block: its trees' roots at one width."""
    for t in grouped(batches, ["leader", "block"]):
        bits = t.column("bits").to_pylist()
        width = min(map(len, bits))
        b = np.bitwise_or.reduce(np.stack([folded(np.frombuffer(x, np.uint8)[None], width)[0] for x in bits]))
        n = column(t, "n")
        shared = max(int(k) - int(np.bitwise_count(folded(np.frombuffer(x, np.uint8)[None], width)).sum()) for k, x in zip(n, bits))
        row = [t.column("leader")[0].as_py(), t.column("block")[0].as_py(), int(n.min()), int(n.max()), shared, bool(np.all(column(t, "linked"))), b.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["leader", "block", "lo", "hi", "shared", "linked", "bits"])


def root_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block pairs whose roots don't exclude a link."""
    for b in batches:
        keep = []
        for k, (x, y, need, shared) in enumerate(zip(b.column("bits_a"), b.column("bits_b"), b.column("need").to_pylist(), b.column("shared").to_pylist())):
            x, y = np.frombuffer(x.as_buffer(), np.uint8)[None], np.frombuffer(y.as_buffer(), np.uint8)[None]
            w = min(x.shape[1], y.shape[1])
            if (DEN + NUM) * (int(np.bitwise_count(folded(x, w) & folded(y, w)).sum()) + shared) >= NUM * need:
                keep.append(k)
        yield b.select(["leader", "block_a", "block_b"]).take(pa.array(keep, pa.int64()))


def block_pairs(tops: DataFrame) -> DataFrame:
    """Pairs of a leader's blocks that may hold a link which isn't known. Bitmaps meet at the narrower width, so only what shares a bit at that width counts."""
    x, y = tops.alias("x"), tops.alias("y")
    near = (F.col("x.leader") == F.col("y.leader")) & (F.col("x.block") < F.col("y.block")) & ~(F.col("x.linked") & F.col("y.linked"))
    near &= (DEN * F.col("x.hi") >= NUM * F.col("y.lo")) & (DEN * F.col("y.hi") >= NUM * F.col("x.lo"))
    wide_x, wide_y = F.length("x.bits"), F.length("y.bits")
    shared = F.when(wide_x < wide_y, F.col("x.shared")).when(wide_x > wide_y, F.col("y.shared")).otherwise(F.least("x.shared", "y.shared"))
    two = x.join(y, near).select(
        F.col("x.leader").alias("leader"), F.col("x.block").alias("block_a"), F.col("y.block").alias("block_b"), F.col("x.bits").alias("bits_a"), F.col("y.bits").alias("bits_b"),
        (F.col("x.lo") + F.col("y.lo")).alias("need"), shared.alias("shared"),
    )
    return two.mapInArrow(root_pairs, GROUP_KINDS)


GROUP = ["leader", "block_a", "block_b"]
GROUP_KINDS = "leader long, block_a long, block_b long"
ROOT_KINDS = "leader long, block long, lo long, hi long, shared long, linked boolean, bits binary"


def leaf_pairs(side: np.ndarray, who: np.ndarray, n: np.ndarray, linked: np.ndarray, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may link, of the nodes of one block (side 0) or of one block with another's (sides 0 and 1)."""
    pick = lambda use: forest([bits[k] for k in use], n[use], linked[use], who[use])
    if side.any():
        return join_forests(pick(np.flatnonzero(side == 0)), pick(np.flatnonzero(side == 1)), False)
    f = pick(np.arange(len(who)))
    return join_forests(f, f, True)


def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group's rows (side, node, n, linked, bits) those that are in a pair of leaves which may link."""
    for t in grouped(batches, GROUP):
        side, who, n, linked = (column(t, c) for c in ("side", "node", "n", "linked"))
        if len(who) > 1:
            a, b = leaf_pairs(side, who, n, linked, t.column("bits").to_pylist())
            t = t.filter(pa.array(np.isin(who, np.concatenate([a, b])))).select([*GROUP, "side", "node", "linked"])
            yield from t.to_batches()


def find(root: dict[int, int], k: int) -> int:
    while root[k] != k:
        root[k] = root[root[k]]
        k = root[k]
    return k


def linked_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (leader, root, node) that connect each group, from its rows (side, node, linked, set); the leader is the root where it can be."""
    for t in grouped(batches, GROUP):
        side, who, linked = (column(t, c) for c in ("side", "node", "linked"))
        leader = t.column("leader")[0].as_py()
        sets = {w: np.frombuffer(s.as_buffer(), np.uint64) for w, s in zip(who.tolist(), t.column("set"))}
        a, b = leaf_pairs(side, who, np.array([len(sets[w]) for w in who.tolist()]), linked, [bitmap(sets[w]).tobytes() for w in who.tolist()])
        root = {w: leader if li else w for w, li in zip(who.tolist(), linked.tolist())} | {leader: leader}
        # the leader's pairs first: they settle most others
        order = np.argsort((a != leader) & (b != leader), kind="stable")
        found = set()
        for x, y in zip(a[order].tolist(), b[order].tolist()):
            p, q = find(root, x), find(root, y)
            if p != q:
                u, v = sets[x], sets[y]
                both = len(np.intersect1d(u, v, assume_unique=True))
                if DEN * both >= NUM * (len(u) + len(v) - both):
                    root[p if q == leader else q] = q if q == leader else p
                    found |= {x, y, p, q}
        if found:
            nodes = sorted(found)
            tops = [find(root, k) for k in nodes]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in ([leader] * len(nodes), tops, nodes)], ["leader", "root", "node"])


def verify(docs: DataFrame, ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (leader, root, node) of groups of rows (group, side, node, n, linked, bits). ids: (node, h), the hashed id of one document for each node."""
    spark = docs.sparkSession
    dealt = rows.repartition(*GROUP).sortWithinPartitions(*GROUP)
    near = materialize(dealt.mapInArrow(suspects, GROUP_KINDS + ", side int, node long, linked boolean"), "ngram-suspects")
    words = bit_filter(near.select("node").distinct().join(ids, "node").select("h").distinct())
    sets = docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(wanted_sets(spark.sparkContext.broadcast(words)), "node long, set binary")
    full = near.join(sets.groupBy("node").agg(F.first("set").alias("set")), "node").select(*GROUP, "side", "node", "linked", "set")
    out = full.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(linked_groups, "leader long, root long, node long")
    out = materialize(out, "ngram-links")
    discard(near)
    return out


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(described documents: doc_id, n, node, links (root, node) between nodes that connect all components)."""
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(frequencies(docs))
    told = docs.mapInArrow(describe(weights), "doc_id long, n long, node long, prefix array<long>, bits binary")
    # an empty set is a node of its own id
    told = told.withColumn("node", F.when(F.col("n") > 0, F.col("node")).otherwise(F.xxhash64(F.lit("empty"), F.col("doc_id"))))
    told = materialize(told, "ngram-documents")
    some = told.where("n > 0")
    ids = some.groupBy("node").agg(F.min(F.xxhash64("doc_id")).alias("h"))

    rows = some.select("node", F.explode("prefix").alias("token"))
    led = rows.groupBy("token").agg(F.min("node").alias("leader"), F.max("node").alias("other")).where("leader <> other").select("token", "leader")
    canopy = rows.join(led, "token").select("leader", "node").distinct()
    info = some.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    members = materialize(canopy.join(info, "node"), "ngram-members")

    size = members.groupBy("leader").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"))
    small = (F.col("m") <= BLOCK) & (F.col("all") <= BLOCK_SHINGLES)
    sized = members.join(size.select("leader", small.alias("small")), "leader")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.05)))).cast("long")
    large = sized.where("not small").withColumn("band", band)
    bands = large.groupBy("leader", "band").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("most"))
    parts = F.ceil(F.col("c") / F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.col("most")))))
    large = large.join(bands.select("leader", "band", parts.alias("parts")), ["leader", "band"])
    large = large.withColumn("block", F.col("band") * 1_000_000_000 + F.pmod(F.xxhash64("node"), F.col("parts"))).select("leader", "block", "node", "n", "bits")
    large = materialize(large, "ngram-blocks")
    group = lambda rows, block: rows.select("leader", block.alias("block_a"), block.alias("block_b"), F.lit(0).alias("side"), "node", "n", F.lit(False).alias("linked"), "bits")
    heads = large.where("node <> leader").select("leader", "block").distinct().join(large.where("node = leader").select("leader", "node", "n", "bits"), "leader")
    first = group(sized.where("small"), F.lit(0).cast("long")).unionByName(group(large.where("node <> leader"), F.col("block"))).unionByName(group(heads, F.col("block")))
    one = verify(docs, ids, first)

    # canopies of several blocks with nodes that aren't connected to the leader
    known = one.where("root = leader").select("leader", "node", F.lit(True).alias("is_linked")).distinct()
    marked = large.join(known, ["leader", "node"], "left").withColumn("linked", F.coalesce("is_linked", F.col("node") == F.col("leader"))).drop("is_linked")
    blocks = marked.groupBy("leader").agg(F.min("block").alias("lo"), F.max("block").alias("hi"), F.min("linked").alias("all_linked")).where("lo <> hi and not all_linked").select("leader")
    marked = materialize(marked.join(blocks, "leader"), "ngram-open")
    tops = materialize(marked.repartition("leader", "block").sortWithinPartitions("leader", "block").mapInArrow(roots, ROOT_KINDS), "ngram-roots")
    two = materialize(block_pairs(tops), "ngram-root-pairs")
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("block")) for k, c in enumerate(("block_a", "block_b"))])
    second = two.select(*GROUP, F.explode(sides).alias("s")).select(*GROUP, "s.side", "s.block").join(marked, ["leader", "block"])
    out = one.unionByName(verify(docs, ids, second.select(*GROUP, "side", "node", "n", "linked", "bits"))).select("root", "node").where("root <> node")
    for done in (members, large, marked, tops, two):
        discard(done)
    return told, out


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links, itself included) of each row."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    told, found = links(base)
    # rows of one id are one document
    several = told.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("root"), F.max("node").alias("other")).where("root <> other").select("doc_id", "root")
    same = told.join(several, "doc_id").select("root", "node").distinct()
    parts = connected_components(found.unionByName(same), "root", "node").select(F.col("id").alias("node"), F.col("component").alias("part"))
    copies = told.groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"))
    low = materialize(copies.join(parts, "node", "left").where("part is not null or rows > 1").select("node", "part", "low"), "ngram-nodes")
    least = materialize(low.where("part is not null").groupBy("part").agg(F.min("low").alias("component_id")), "ngram-least")
    named = low.where("part is not null").join(least, "part").select("node", "component_id").unionByName(low.where("part is null").select("node", F.col("low").alias("component_id")))
    named = materialize(named, "ngram-named")
    out = told.select("doc_id", "n", "node").join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def components_sql(documents: str = "documents") -> str:
    """The same rows in DuckDB SQL: all pairs that share a shingle, then reachability."""
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id)::BIGINT AS component_id
    FROM {documents} d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.doc_id"""
