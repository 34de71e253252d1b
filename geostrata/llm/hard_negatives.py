"""Hard-negative mining with vantage-point trees over norm-augmented vectors. Results are exact.

Let M be the greatest norm. A row x becomes (x, sqrt(M^2 - |x|^2)), a query q becomes (q, 0); then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the inner product falls as the distance grows, and a window of scores is
an annulus around the query.

* A top tree of at most MAX_CELLS cells is fitted on a bounded sample: an inner node has a vantage point and a
  radius, rows nearer than that go to its first child. Every row is put into a cell. Of each cell the least and
  greatest distances to the vantage points on its path are known, from all its rows.
* A cell's rows are dealt into blocks of about BLOCK_ROWS, by row number, so copies of one vector fill several
  blocks and no task holds a hot cell. A task builds a vantage-point tree of each block that it gets.
* A query visits the cells whose bounds on the score meet its window. In a block it goes through the leaves nearest
  first, starting at the annulus's inner edge, and stops when k rows are found and no leaf ahead can hold
  a better one. All queries that a task has for a block take these steps together.
* Two rounds: the first visits a few cells only and gives a bound, the second all others that can beat it.

First the positives of each anchor are searched, among rows of its label (blocks of one label each), then for
each anchor and positive the first rows of other labels in the window.

Scores are sums of products of integers, exact to 64 bits and held at the ends of that range beyond.
Order: higher scores, then smaller vec_id. Nulls: rows with a null id, label, vector or anchor mark take no part, nor do
rows with a null component. A shorter vector has zeros at its end; an empty one scores 0 with all. Ties go
by id; rows that repeat an id each count, and none of them is a positive of another. A label without other rows, or a table of one
label, gives no rows; so does an empty table. Columns of the input beyond those named aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.samples import bounded_sample
from geostrata.session import discard, materialize

BLOCK_ROWS, QUERY_ROWS, LEAF_ROWS, MAX_CELLS = 2048, 4096, 64, 512
#: Vectors of the sample for each cell, and the most numbers that the sample holds.
SAMPLE_EACH, SAMPLE_NUMBERS = 16, 1 << 22
#: Cells that a query visits in the first round.
FIRST_CELLS = 2
NONE, LEAST, MOST = -(2**63), -(2**63) + 1, 2**63 - 1
WINDOW = "array<struct<w: int, lo: bigint, hi: bigint, floor: bigint>>"


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column as rows of d doubles, with zeros where a list is shorter."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.float64)
    n = np.diff(off)
    if (n == d).all():
        return values.reshape(-1, d)
    out = np.zeros((len(column), d))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(off[:-1] - off[0], n)] = values
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of q with all rows of x as 64-bit integers."""
    if not len(q) or not len(x) or np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = [[int(v) for v in r] for r in x]
    return np.array([[min(MOST, max(LEAST, sum(a * b for a, b in zip(map(int, r), s)))) for s in whole] for r in q], np.int64)


class Space:
    """Distances in the augmented space: m2 is the greatest squared norm, d the number of components."""

    def __init__(self, m2: float, d: int) -> None:
        self.m2, self.d = m2, d

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of all rows x from all rows y."""
        rest = lambda v: np.sqrt(np.maximum(0, self.m2 - (v * v).sum(1)))
        return np.sqrt(np.maximum(0, 2 * self.m2 - 2 * (x @ y.T + rest(x)[:, None] * rest(y))))

    def from_queries(self, q: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of all queries q from all rows y."""
        return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + self.m2 - 2 * (q @ y.T)))

    def score_bounds(self, q: np.ndarray, away: np.ndarray, paths: list[list[tuple[int, float, float]]]) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest scores of queries with the rows behind each path of (vantage point, least, greatest distance).

        away: distances of the queries from all vantage points. The triangle inequality bounds the distance, hence the score.
        """
        q2 = (q * q).sum(1)
        slack = 1e-9 * (q2 + self.m2) + 1e-3
        low, high = np.full((len(q), len(paths)), -np.inf), np.full((len(q), len(paths)), np.inf)
        for k, path in enumerate(paths):
            near, far = np.zeros(len(q)), np.sqrt(q2) + np.sqrt(self.m2)
            for v, least, most in path:
                near = np.maximum(near, np.maximum(least - away[:, v], away[:, v] - most))
                far = np.minimum(far, away[:, v] + most)
            low[:, k] = (q2 + self.m2 - far * far) / 2 - slack
            high[:, k] = (q2 + self.m2 - near * near) / 2 + slack
        return low, high


def vantage(space: Space, x: np.ndarray, rng: np.random.Generator) -> tuple[int, np.ndarray]:
    """Of a few rows the one from which distances spread most, and the distances of all rows from it."""
    some = rng.choice(len(x), min(len(x), 4), replace=False)
    away = space.between(x, x[some])
    best = int(away.std(0).argmax())
    return int(some[best]), away[:, best]


class TopTree:
    """Inner nodes in heap order: node i has the children 2 i + 1 and 2 i + 2; the cells follow."""

    def __init__(self, space: Space, sample: np.ndarray, cells: int) -> None:
        self.space, self.cells, self.depth = space, cells, cells.bit_length() - 1
        self.points, self.radius = np.zeros((cells - 1, space.d)), np.zeros(cells - 1)
        rows = {0: np.arange(len(sample))}
        for i in range(cells - 1):
            own = rows.pop(i)
            if len(own):
                p, away = vantage(space, sample[own], np.random.default_rng(i))
                self.points[i], self.radius[i] = sample[own[p]], np.median(away)
                inside = away < self.radius[i]
                rows[2 * i + 1], rows[2 * i + 2] = own[inside], own[~inside]
            else:
                rows[2 * i + 1] = rows[2 * i + 2] = own
        #: for each cell (vantage point, least, greatest distance) along its path; set from all rows
        self.paths: dict[int, list[tuple[int, float, float]]] = {}

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and its distances to the vantage points on the way."""
        away = self.space.between(x, self.points)
        at, path = np.zeros(len(x), np.int64), np.zeros((len(x), self.depth))
        for level in range(self.depth):
            path[:, level] = away[np.arange(len(x)), at]
            at = 2 * at + np.where(path[:, level] < self.radius[at], 1, 2)
        return at - (self.cells - 1), path

    def nodes(self, cell: int) -> list[int]:
        """The inner nodes on the way to a cell, from the root."""
        out, at = [], cell + self.cells - 1
        while at:
            at = (at - 1) // 2
            out.append(at)
        return out[::-1]


class Block:
    """A vantage-point tree over the rows of a block; its leaves hold about LEAF_ROWS rows."""

    def __init__(self, space: Space, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.space, self.x, self.ids, self.labels = space, x, ids, labels
        self.leaves: list[np.ndarray] = []
        self.paths: list[list[tuple[int, float, float]]] = []
        points: list[int] = []
        rng, stack = np.random.default_rng(len(x)), [(np.arange(len(x)), [])]
        while stack:
            own, path = stack.pop()
            if len(own) > LEAF_ROWS:
                p, away = vantage(space, x[own], rng)
                inside = away < np.median(away)
                if not inside.any():
                    inside = away <= np.median(away)
                if not inside.all():
                    points.append(own[p])
                    stack += [(own[side], [*path, (len(points) - 1, away[side].min(), away[side].max())]) for side in (inside, ~inside)]
                    continue
            self.leaves.append(own)
            self.paths.append(path)
        self.points = x[points] if points else np.zeros((0, space.d))

    def search(self, q: np.ndarray, labels: np.ndarray, own: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, floor: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores (NONE where there are fewer) and ids of the first k rows of each window, of those that reach floor.

        at: the query (row of q, labels, own) of each window. same: rows of the query's label and another id, else rows of other labels.
        """
        low, high = self.space.score_bounds(q, self.space.from_queries(q, self.points), self.paths)
        low, high = low[at], np.minimum(high[at], hi[:, None].astype(np.float64))
        least = np.maximum(lo, floor).astype(np.float64)
        edge = 1e-9 * np.abs(hi.astype(np.float64)) + 1e-3
        open_ = (low <= (hi + edge)[:, None]) & (high + edge[:, None] >= least[:, None])
        high = np.where(open_, high, -np.inf)
        order = np.argsort(-high, axis=1, kind="stable")
        score, ids = np.full((len(at), k), NONE, np.int64), np.full((len(at), k), MOST, np.int64)
        going = np.arange(len(at))
        for step in range(len(self.leaves)):
            leaf = order[going, step]
            top = high[going, leaf]
            use = (top > -np.inf) & ((score[going, -1] == NONE) | (top + edge[going] >= score[going, -1]))
            going, leaf = going[use], leaf[use]
            if not len(going):
                break
            for f in np.unique(leaf):
                w = going[leaf == f]
                rows = self.leaves[f]
                s = products(q[at[w]], self.x[rows])
                if same:
                    fits = (self.labels[rows] == labels[at[w], None]) & (self.ids[rows] != own[at[w], None])
                else:
                    fits = self.labels[rows] != labels[at[w], None]
                s = np.where(fits & (s >= np.maximum(lo, floor)[w, None]) & (s <= hi[w, None]), s, NONE)
                both = np.concatenate([score[w], s], axis=1)
                named = np.concatenate([ids[w], np.broadcast_to(self.ids[rows], s.shape)], axis=1)
                first = np.lexsort((named, ~both), axis=1)[:, :k]  # ~ falls as the score grows, and has no overflow
                score[w], ids[w] = np.take_along_axis(both, first, 1), np.take_along_axis(named, first, 1)
        return score, ids


HITS = pa.schema([("qid", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def visits(tree: TopTree, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (qid, v, windows): the cells of the first round, or all others that can hold a row of a window."""
    schema = pa.schema([("qid", pa.int64()), ("cell", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.array(sorted(tree.paths))
        paths = [tree.paths[c] for c in cells]
        for b in batches:
            q = matrix(b.column("v"), tree.space.d)
            low, high = tree.space.score_bounds(q, tree.space.from_queries(q, tree.points), paths)
            at, _, lo, hi, floor = windows(b.column("windows"))
            edge = 1e-9 * np.abs(hi.astype(np.float64)) + 1e-3
            near = np.abs((low[at] + high[at]) / 2 - np.minimum(hi[:, None].astype(np.float64), high[at]))
            open_ = (low[at] <= (hi + edge)[:, None]) & (high[at] + edge[:, None] >= np.maximum(lo, floor)[:, None])
            never = (low[at] > (hi + edge)[:, None]) | (high[at] + edge[:, None] < lo[:, None])
            rank = np.argsort(np.where(never, np.inf, near), axis=1, kind="stable")[:, :FIRST_CELLS]
            early = np.zeros((len(b), len(cells)), bool)
            early[np.repeat(at, rank.shape[1]), rank.ravel()] = True
            reached = np.zeros((len(b), len(cells)), bool)
            np.logical_or.at(reached, at, open_)
            row, cell = np.nonzero(early if first else reached & ~early)
            qid = b.column("qid").to_numpy()
            for a in range(0, len(row), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(qid[row[a : a + 100_000]]), pa.array(cells[cell[a : a + 100_000]].astype(np.int32))], schema=schema)

    return run


def windows(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, number, least and greatest score and floor of all windows of a list column."""
    flat = column.flatten()
    at = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return at, *[flat.field(k).to_numpy(zero_copy_only=False) for k in ("w", "lo", "hi", "floor")]


def searches(space: Space, k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows sorted by block, those of the index before the queries: hits of each window."""

    def hits(block: Block, codes: dict, b: pa.RecordBatch) -> pa.RecordBatch:
        q = matrix(b.column("v"), space.d)
        at, w, lo, hi, floor = windows(b.column("windows"))
        labels = np.array([codes.get(x, -1) for x in b.column("label").to_pylist()], np.int64)
        score, ids = block.search(q, labels, b.column("own").to_numpy(), at, lo, hi, floor, k, same)
        n, rank = np.nonzero(score > NONE)
        return pa.RecordBatch.from_arrays([pa.array(b.column("id").to_numpy()[at[n]]), pa.array(w[n].astype(np.int32)), pa.array(score[n, rank]), pa.array(ids[n, rank])], schema=HITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, block, codes = None, [], None, {}
        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in ("part", "cell", "salt", "pack", "is_query")]))
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                if keys[lo][:4] != key:
                    key, rows, block, codes = keys[lo][:4], [], None, {}
                piece = b.slice(lo, hi - lo)
                if not keys[lo][4]:
                    rows.append((matrix(piece.column("v"), space.d), piece.column("id").to_numpy(), [codes.setdefault(x, len(codes)) for x in piece.column("label").to_pylist()]))
                elif rows or block is not None:
                    if block is None:
                        block = Block(space, *[np.concatenate([r[j] for r in rows]) for j in range(3)])
                        rows = []
                    yield hits(block, codes, piece)

    return run


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The first k hits of each query and window, with their rank."""
    order = Window.partitionBy("qid", "w").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(rows: DataFrame, tree: TopTree, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """qid, w, score, vec_id, rank of the first k rows of each window of queries (qid, label, own, v, windows).

    rows: vec_id, label, v, cell, rid. Exact: the second round visits every cell that can hold a better row.
    """
    part = F.col("label") if same else F.lit("")
    rows, queries = rows.withColumn("part", part), queries.withColumn("part", part)
    sizes = rows.groupBy("part", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("salts"))

    def one_round(queries: DataFrame, first: bool) -> DataFrame:
        cells = queries.select("qid", "v", "windows").mapInArrow(visits(tree, first), "qid long, cell int")
        cells = materialize(cells.join(queries.select("qid", "part"), "qid").join(sizes, ["part", "cell"]), "negatives-visits")
        packs = cells.groupBy("part", "cell", "salts").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("int").alias("packs"))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        index = rows.join(packs, ["part", "cell"]).withColumn("salt", F.pmod("rid", "salts").cast("int"))
        index = index.select("part", "cell", "salt", upto("packs").alias("pack"), F.lit(False).alias("is_query"), F.col("vec_id").alias("id"), "label", F.lit(None).cast("long").alias("own"), "v", F.lit(None).cast(WINDOW).alias("windows"))
        asked = cells.drop("part").join(queries, "qid").join(packs.drop("salts"), ["part", "cell"]).withColumn("pack", F.pmod(F.xxhash64("qid"), F.col("packs")).cast("int"))
        asked = asked.select("part", "cell", upto("salts").alias("salt"), "pack", F.lit(True).alias("is_query"), F.col("qid").alias("id"), "label", "own", "v", "windows")
        block = ["part", "cell", "salt", "pack"]
        both = index.unionByName(asked).repartition(*block).sortWithinPartitions(*block, "is_query")
        out = materialize(ranked(both.mapInArrow(searches(tree.space, k, same), "qid long, w int, score long, vec_id long"), k), "negatives-hits")
        discard(cells)
        return out

    early = one_round(queries, True)
    # of windows that are full, only rows that reach the last one's score are of use still
    full = early.where(F.col("rank") == k).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("full"))
    floor = lambda x: F.struct(x.w.alias("w"), x.lo.alias("lo"), x.hi.alias("hi"), F.coalesce(F.element_at("full", x.w), F.lit(LEAST)).alias("floor"))
    again = queries.join(full, "qid", "left").withColumn("windows", F.transform("windows", floor)).drop("full")
    late = one_round(again, False)
    return ranked(early.drop("rank").unionByName(late.drop("rank")), k)


def quantized(vector: Column) -> Column:
    """floor(256 x) of each component, as double; null where the vector, or a component, is null or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~odd, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """Return anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id (long), label, v (array of integers), anchor (boolean). A positive is one of the first rows of the anchor's
    label, by score; its negatives are the first rows of other labels with scores from percent of its score up to it.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("anchor").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("v").cast("array<long>").alias("v"), "anchor")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, m2, d = rows.agg(F.count(F.lit(1)), F.max(norm2), F.max(F.size("v"))).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], out)
    space = Space(float(m2), max(1, int(d)))
    cells = min(MAX_CELLS, 1 << max(0, (n - 1) // BLOCK_ROWS).bit_length())
    want = max(1, min(SAMPLE_EACH * cells, SAMPLE_NUMBERS // space.d))
    sample = bounded_sample(rows.select("v"), want, F.col("v")).toArrow().column("v").combine_chunks() if cells > 1 else None
    tree = TopTree(space, matrix(sample, space.d) if cells > 1 else np.zeros((0, space.d)), cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, path = tree.assign(matrix(b.column("v"), space.d))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * tree.depth, pa.int32()), pa.array(path.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), lists], [*b.schema.names, "cell", "path"])

    placed = rows.mapInArrow(assign, "vec_id long, label string, v array<long>, anchor boolean, cell int, path array<double>")
    placed = materialize(placed.withColumn("rid", F.monotonically_increasing_id()), "negatives-rows")
    ends = [f(F.get("path", F.lit(j))).alias(f"{name}{j}") for j in range(tree.depth) for name, f in (("least", F.min), ("most", F.max))]
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)), *ends).collect():
        tree.paths[r.cell] = [(v, r[f"least{j}"], r[f"most{j}"]) for j, v in enumerate(tree.nodes(r.cell))]
    placed = placed.drop("path")

    anchors = placed.where("anchor").select(F.col("rid").alias("qid"), "label", F.col("vec_id").alias("own"), "v")
    whole = F.array(F.struct(F.lit(0).alias("w"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"), F.lit(LEAST).alias("floor")))
    found = search(placed.drop("anchor"), tree, anchors.withColumn("windows", whole), positives, True)
    pairs = materialize(found.select("qid", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-pairs")
    # percent of s, rounded up, without a product beyond 64 bits: s - floor(s (100 - percent) / 100)
    rest = 100 - percent
    lo = F.expr(f"positive_score - (positive_score div 100) * {rest} - ((positive_score % 100) * {rest}) div 100")
    window = F.struct(F.col("w"), lo.alias("lo"), F.col("positive_score").alias("hi"), F.lit(LEAST).alias("floor"))
    asked = pairs.where("positive_score >= 0").groupBy("qid").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    near = search(placed.drop("anchor"), tree, anchors.join(asked, "qid"), negatives, False)
    near = near.select("qid", "w", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    done = pairs.join(near, ["qid", "w"]).join(anchors.select("qid", F.col("own").alias("anchor_id")), "qid")
    return done.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(embeddings: DataFrame, anchor_each: int = 100, moved_each: int = 7, labels: int = 10) -> DataFrame:
    """The rows of mine() from (vec_id, embedding, label): quantized, every 100th an anchor, every 7th with the next label."""
    moved = F.when(F.col("vec_id") % moved_each == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return embeddings.select("vec_id", moved.alias("label"), quantized(F.col("embedding")).alias("v"), (F.col("vec_id") % anchor_each == 0).alias("anchor"))


def mine_sql(embeddings: str = "embeddings", positives: int = 5, negatives: int = 5, percent: int = 80) -> str:
    """The same rows in DuckDB SQL for the rows of relabelled(), by all pairs of an anchor and a row."""
    return f"""
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
               FROM {embeddings} WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
          FROM e a JOIN e r ON a.vec_id <> r.vec_id AND a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {positives})
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND {percent} * positive_score <= 100 * s.score AND s.score <= positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
    QUALIFY row_number() OVER w <= {negatives}"""
