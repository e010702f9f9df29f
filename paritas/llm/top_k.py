"""Exact top-k inner products: ball trees per shard, branch and bound.

Vectors are dealt to shards of about ``SHARD`` rows by a hash; a task builds the
ball tree of a shard and writes it to the shared folder.  Queries are dealt to
blocks; a block first searches one shard, which gives each of its queries a kth
score to begin with.  Then every (block, group of shards) is a task of its own:
it reads one tree after another and carries each query's current kth score along.
In a tree, nodes are taken in the order of their upper bound
q . centre + |q| * radius, and a node is left out as soon as its bound is under
the kth score (or equals it and all its ids are larger than the kth one's).  The
groups' lists of at most k rows a query are merged by a window.

Components are scaled and floored to whole numbers, so scores are exact integers:
in float64 while products stay under 2**53, in Python integers beyond.

Defined results:
- vectors that are null, empty, or hold null or non-finite components (before or
  after scaling) take no part; null ids take no part; an empty table gives no rows;
- only vectors of one length are compared; each row is a candidate and, if it is
  asked for, a query of its own, also where an id or a row is there more than once;
  a query's own row is never its answer; ties go to the smaller id;
- ranks follow the exact integer, whatever its size; a score that doesn't fit a
  long is given as null;
- other columns aren't read, whatever their names; very long vectors make larger
  trees, one of which a task holds at a time.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paritas.llm.common import arrow_schema, batches_out, shared_folder, stored

K, SCALE = 10, 1024
SHARD, LEAF, BLOCK = 16_384, 128, 128
#: Tasks of (block, group of shards) to aim at, and the most partitions that hold them.
TASKS, MOST_PARTITIONS = 4_096, 50_000
EXACT = float(2**53)
RESULT = "query_id long, rank int, vec_id long, score long"
FOUND = "query long, query_id long, vec_id long, score long, place binary"
_int = np.frompyfunc(int, 1, 1)


def build(ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """A ball tree over rows (their numbers are the ids, if not given); rows of a node are contiguous after reordering, children are 2 nodes or -1."""
    order = np.arange(len(ids))
    centres, radii, spans, children = [], [], [], []

    def add(a: int, b: int) -> int:
        own = vectors[order[a:b]]
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        at = len(radii)
        centres.append(centre)
        radii.append(float(away.max()))
        spans.append((a, b))
        children.append((-1, -1))
        if b - a > LEAF and 0 < radii[at] < np.inf:
            one = own[int(away.argmax())]
            from_one = ((own - one) ** 2).sum(axis=1)
            two = own[int(from_one.argmax())]
            along = own @ (two - one)
            order[a:b] = order[a:b][np.argsort(along, kind="stable")]
            middle = (a + b) // 2
            children[at] = (add(a, middle), add(middle, b))
        return at

    with np.errstate(over="ignore", invalid="ignore"):
        add(0, len(ids))
    rows = ids[order] if rows is None else rows[order]
    ids, vectors = ids[order], vectors[order]
    least = [int(ids[a:b].min()) for a, b in spans]
    return {"ids": ids, "rows": rows, "vectors": vectors, "centres": np.array(centres), "radii": np.array(radii), "spans": np.array(spans), "children": np.array(children), "least": np.array(least)}


class Best:
    """The k best of one query so far, as (-score, id) in order; floor is a score that no answer is under."""

    def __init__(self, k: int, floor: float | int = -np.inf, worst: int = 0):
        self.k, self.rows = k, []
        self.floor, self.worst = floor, worst

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.floor > 1e300:  # beyond what numpy compares with doubles
            scores = _int(scores)
        at = np.flatnonzero(scores >= self.floor)
        if not len(at):
            return
        self.rows = heapq.nsmallest(self.k, [*self.rows, *[(-int(s), int(i)) for s, i in zip(scores[at].tolist(), ids[at].tolist())]])
        if len(self.rows) == self.k and -self.rows[-1][0] >= self.floor:
            score, self.worst = self.rows[-1]
            self.floor = -score


def search(tree: dict[str, np.ndarray], row: int, query: np.ndarray, bounds: np.ndarray, best: Best) -> None:
    """Branch and bound; bounds has the upper bound of every node for this query."""
    spans, children, least, bounds = tree["spans"], tree["children"], tree["least"], bounds.tolist()
    queue = [(-bounds[0], 0)]
    while queue:
        bound, node = heapq.heappop(queue)
        if -bound < best.floor:
            return
        if children[node, 0] < 0:
            a, b = spans[node]
            own = tree["ids"][a:b]
            scores = tree["vectors"][a:b] @ query
            if (other := tree["rows"][a:b] != row).all():
                best.offer(scores, own)
            else:
                best.offer(scores[other], own[other])
            continue
        for child in children[node].tolist():
            if bounds[child] > best.floor or bounds[child] >= best.floor and least[child] < best.worst:
                heapq.heappush(queue, (-bounds[child], child))


def search_all(tree: dict[str, np.ndarray], rows: list[int], queries: np.ndarray, best: list[Best]) -> None:
    """One tree for every query of a block."""
    own, asked, centres = tree["vectors"], queries, tree["centres"]
    with np.errstate(over="ignore", invalid="ignore"):
        if not np.abs(own).max() * np.abs(queries).max() * queries.shape[1] < EXACT:
            tree, asked = tree | {"vectors": _int(own)}, _int(queries)
        norms = np.sqrt((queries**2).sum(axis=1))[:, None]
        bounds = queries @ centres.T + norms * tree["radii"]
        bounds += 1 + 1e-9 * (np.abs(bounds) + norms * (1 + np.sqrt((centres**2).sum(axis=1))))
    bounds[np.isnan(bounds)] = np.inf
    for i, row in enumerate(rows):
        search(tree, row, asked[i], bounds[i], best[i])


def place(score: int) -> bytes:
    """Bytes in the order of the integers, of any size."""
    n = (abs(score).bit_length() + 7) // 8
    if score >= 0:
        return (32768 + n).to_bytes(2, "big") + score.to_bytes(n, "big")
    return (32767 - n).to_bytes(2, "big") + (score + 256**n - 1).to_bytes(n, "big")


def _whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) as doubles; doubles from 2**53 on are whole."""
    def one(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < 2.0**62, F.floor(scaled).cast("double")).otherwise(scaled)

    return F.transform(vector, one)


def _usable(vector: Column, scale: int) -> Column:
    finite = lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < float("inf")) & ~F.isnan(x.cast("double"))
    return (F.size(vector) > 0) & F.forall(vector, finite)


def _put(folder: str, name: str, arrays: dict) -> None:
    from paritas.llm.pfor import put_file

    blob = io.BytesIO()
    np.savez(blob, **arrays)
    put_file(folder, name, blob.getvalue())


def _get(folder: str, name: str) -> dict[str, np.ndarray]:
    from paritas.llm.pfor import get_file

    with np.load(io.BytesIO(get_file(f"{folder}/{name}"))) as z:
        return {n: z[n] for n in z.files}


def _matrix(group: pa.Table, dim: int) -> np.ndarray:
    return np.array(group.column("v").combine_chunks().flatten().to_numpy(), np.float64).reshape(-1, dim)


def _found(spark: SparkSession, rows: DataFrame, n: int, n_queries: int, k: int) -> DataFrame:
    shards, blocks = -(-n // SHARD), -(-n_queries // BLOCK)
    folder = f"{shared_folder(spark)}/trees"

    def plant(key: tuple, group: pa.Table) -> pa.Table:
        shard, dim = key[0].as_py(), key[1].as_py()
        _put(folder, f"tree-{dim}-{shard}.npz", build(group.column("id").to_numpy(), _matrix(group, dim), group.column("row").to_numpy()))
        return pa.table({"shard": pa.array([shard], pa.int32()), "dim": pa.array([dim], pa.int32())})

    dealt = rows.select("row", "id", "v", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"))
    trees: dict[int, list[int]] = {}
    for r in dealt.repartition(min(2 * shards, MOST_PARTITIONS), "shard", "dim").groupBy("shard", "dim").applyInArrow(plant, "shard int, dim int").collect():
        trees.setdefault(r["dim"], []).append(r["shard"])

    def begin(key: tuple, group: pa.Table) -> pa.Table:
        block, dim = key[0].as_py(), key[1].as_py()
        own, queries = group.column("row").to_pylist(), _matrix(group, dim)
        best = [Best(k) for _ in own]
        first = sorted(trees[dim])[block % len(trees[dim])]
        search_all(_get(folder, f"tree-{dim}-{first}.npz"), own, queries, best)
        floors = [str(b.floor) if len(b.rows) == k else "" for b in best]
        _put(folder, f"block-{dim}-{block}.npz", {"rows": np.array(own, np.int64), "ids": group.column("id").to_numpy(), "queries": queries, "floors": np.array(floors), "worst": np.array([b.worst for b in best], np.int64)})
        return pa.table({"block": pa.array([block], pa.int32()), "dim": pa.array([dim], pa.int32())})

    asked = rows.where("q").select("row", "id", "v", F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("dim"))
    begun = asked.repartition(min(2 * blocks, MOST_PARTITIONS), "block", "dim").groupBy("block", "dim").applyInArrow(begin, "block int, dim int")
    begun = stored(begun)
    groups = max(1, min(max(map(len, trees.values())), -(-TASKS // blocks)))
    jobs = begun.select("block", "dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    schema = arrow_schema(FOUND)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dim, part in zip(*(batch.column(c).to_pylist() for c in ("block", "dim", "part"))):
                given = _get(folder, f"block-{dim}-{block}.npz")
                own, ids = given["rows"].tolist(), given["ids"].tolist()
                best = [Best(k, int(f), w) if f else Best(k) for f, w in zip(given["floors"].tolist(), given["worst"].tolist())]
                for b in best:
                    b.worst += b.floor > -np.inf  # the answer that gave the floor may be met again
                for shard in sorted(trees[dim])[part::groups]:
                    search_all(_get(folder, f"tree-{dim}-{shard}.npz"), own, given["queries"], best)
                rows = [(r, q, i, -s if -(2**63) < s <= 2**63 else None, place(-s)) for r, q, b in zip(own, ids, best) for s, i in b.rows]
                if rows:
                    yield batches_out(dict(zip(schema.names, zip(*rows))), schema)

    wanted = blocks * len(trees) * groups
    return jobs.repartition(min(wanted, MOST_PARTITIONS)).mapInArrow(answer, FOUND)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the rows where is_query holds, against all rows."""
    spark = vectors.sparkSession
    rows = stored(vectors.where(F.col(id_col).isNotNull() & _usable(F.col(vector_col), scale)).select(F.col(id_col).cast("long").alias("id"), _whole(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("row")))
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    if not n_queries:
        return spark.createDataFrame([], RESULT)
    order = Window.partitionBy("query").orderBy(F.desc("place"), "vec_id")
    return _found(spark, rows, n, n_queries, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
