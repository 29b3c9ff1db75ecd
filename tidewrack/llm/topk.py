"""Exact search for the highest inner products by aggregation without random access (NRA).

Candidates are dealt to blocks. Each block keeps one list for each dimension: its vectors' components in order. A query
scores a vector by the sum over the dimensions of component times component, so it reads a list from its high end where
its own component is positive, and from its low end where it is negative. Lists are read to one depth after the other,
for many queries at once: what has been read of a vector, with the least that the rest of each list can give, is a lower
bound of its score; with what stands at the depth reached, an upper bound. A query stops as soon as a vector of which
nothing has been read cannot be among its best, and few whose upper bound reaches the k-th lower bound are left; their
scores are then resolved. Blocks after the first begin with the k-th score that each query has found in its first block,
so that most stop early. Nothing is approximate: a bound decides only where it proves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.llm.common import cut

SCALE = 256
BEST = 5
EVERY = 50
#: Vectors of a block, queries that meet a block in one task, and queries whose bounds are held at once.
BLOCK_ROWS, QUERY_ROWS, QUERY_TILE = 4_096, 1_024, 128
#: Parts of a block's lists after which bounds are compared, and the share of a block that may be left to be resolved.
DEPTHS = (1 / 8, 1 / 4, 3 / 8, 1 / 2, 3 / 4)
FEW = 1 / 32
#: Doubles hold whole numbers exactly below this; larger sums are made of Python's integers.
_EXACT = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantized(name: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double; null for vectors that take no part: null, or with null or non-finite components."""
    fine = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(name, lambda x: _floor(x, scale)))


def _floor(x: Column, scale: int) -> Column:
    """floor as a double: Spark's own gives a long, which holds no large numbers."""
    y = x.cast("double") * scale
    near = F.rint(y)
    return F.when(near > y, near - 1.0).otherwise(near)


class BlockLists:
    """The vectors of a block, and for each dimension their places in ascending order."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def read(self, a: int, b: int, low: np.ndarray, high: np.ndarray) -> None:
        """Reads ranks a to b of all lists from both ends. low and high: (values, marks), filled where a vector has been read."""
        n = len(self.vectors)
        columns = np.arange(self.vectors.shape[1])
        for into, part in ((low, slice(a, b)), (high, slice(n - b, n - a))):
            rows = self.order[part]
            into[0][rows, columns] = self.sorted[part]
            into[1][rows, columns] = 1


def block_best(lists: BlockLists, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int = BEST) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places of all vectors of the block that can be among its k best, at least the block's k best of at least floors, and their scores.

    own: the place of the query itself, -1 if it is not in the block. floors: a score that k others reach, or -inf.
    """
    n, d = lists.vectors.shape
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(queries)
    marked = np.zeros((2, 2, n, d))  # low and high ends: values and marks
    reached, live = 0, np.arange(len(queries))
    up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T
    for depth in [*(int(n * x) for x in DEPTHS), n]:
        if depth == reached and depth < n or not len(live):
            continue
        lists.read(reached, depth, marked[0], marked[1])
        reached = depth
        if depth == n:  # all has been read
            known = lists.vectors @ queries[live].T
            upper = lower = known
            unread = np.full(len(live), -np.inf)
        else:
            q_up, q_down = up[:, live], down[:, live]
            part = marked[1, 0] @ q_up + marked[0, 0] @ q_down
            # what the next of each list gives at most, and its last at least
            most_up, most_down = lists.sorted[n - depth, :, None] * q_up, lists.sorted[depth - 1, :, None] * q_down
            least_up, least_down = lists.sorted[0, :, None] * q_up, lists.sorted[n - 1, :, None] * q_down
            unread = (most_up + most_down).sum(axis=0)
            upper = part + unread - marked[1, 1] @ most_up - marked[0, 1] @ most_down
            lower = part + (least_up + least_down).sum(axis=0) - marked[1, 1] @ least_up - marked[0, 1] @ least_down
        at = own[live]
        inside = np.flatnonzero(at >= 0)
        lower = lower.copy()
        lower[at[inside], inside] = -np.inf
        kth = np.partition(lower, n - k, axis=0)[n - k] if n >= k else np.full(len(live), -np.inf)
        bar = np.maximum(kth, floors[live])
        left = upper >= bar
        left[at[inside], inside] = False
        done = (unread < bar) & (left.sum(axis=0) <= max(k, int(n * FEW))) if depth < n else np.ones(len(live), dtype=bool)
        for i in np.flatnonzero(done).tolist():
            rows = np.flatnonzero(left[:, i])
            out[live[i]] = (rows, lists.vectors[rows] @ queries[live[i]])
        live = live[~done]
    return out


def _exact_best(vectors: np.ndarray, query: np.ndarray, own: int) -> tuple[list[int], list[int]]:
    """All scores as Python's integers: for components so large that doubles would round."""
    ints = [int(x) for x in query]
    rows = [r for r in range(len(vectors)) if r != own]
    return rows, [sum(int(x) * y for x, y in zip(vectors[r].tolist(), ints)) for r in rows]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of doubles as rows; shorter ones end in zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
_FOUND_COLUMNS = "query long, query_id long, vec_id long, row long, score long"


def _meet(k: int):
    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        """One group of queries with one block: for each query the block's k best, no lower than its floor."""
        if not queries.num_rows or not block.num_rows:
            return _FOUND.empty_table()
        width = max(1, *(int(pc.max(pc.list_value_length(t)).as_py()) for t in (queries["v"], block["b_v"])))
        q, x = _matrix(queries["v"], width), _matrix(block["b_v"], width)
        rows = block["b_row"].to_numpy()
        ids = np.array([_MOST if i is None else i for i in block["b_vec_id"].to_pylist()], dtype=np.int64)
        absent = np.array([i is None for i in block["b_vec_id"].to_pylist()])
        place = {r: p for p, r in enumerate(rows.tolist())}
        own = np.array([place.get(r, -1) for r in queries["row"].to_pylist()], dtype=np.int64)
        floors = np.array([-np.inf if f is None else float(f) for f in queries["floor"].to_pylist()])
        small = width * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < _EXACT
        out: list[tuple] = []
        lists = BlockLists(x) if small else None
        for a in range(0, len(q), QUERY_TILE):
            part = slice(a, a + QUERY_TILE)
            found = block_best(lists, q[part], own[part], floors[part], k) if small else [_exact_best(x, y, o) for y, o in zip(q[part], own[part].tolist())]
            for i, (at, scores) in enumerate(found, a):
                scores = [min(_MOST, max(_LEAST, int(s))) for s in (scores.tolist() if small else scores)]
                best = sorted(zip(at.tolist() if small else at, scores), key=lambda p: (-p[1], absent[p[0]], ids[p[0]], rows[p[0]]))[:k]
                out += [(queries["row"][i].as_py(), queries["vec_id"][i].as_py(), None if absent[p] else int(ids[p]), int(rows[p]), s) for p, s in best if not small or s >= floors[i]]
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out), _FOUND)], schema=_FOUND) if out else _FOUND.empty_table()

    return run


def top_products(vectors: DataFrame, k: int = BEST, every: int = EVERY, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """vectors: vec_id, embedding. Returns query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query, all if there are fewer.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows but the query's own, ties go to the
    smaller vec_id, null ids last. Components count as floor(scale * x). Vectors that are null or hold null or non-finite
    components take no part; a shorter vector counts as if zeros followed. Repeated rows and ids are rows of their own:
    each asks and answers. Scores beyond a long stop at its ends. Other columns are ignored, an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), quantized("embedding", scale).alias("v")).filter("v IS NOT NULL"))
    asking = F.col("vec_id") % every == 0
    n, asked = rows.agg(F.count("*"), F.count_if(asking)).first()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-asked // query_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    queries = rows.filter(asking).withColumn("group", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)))
    first = F.pmod(F.col("group"), F.lit(blocks))  # the block that a group of queries meets before all others
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    to_first = F.filter(numbers(groups), lambda g: F.pmod(g, F.lit(blocks)) == F.col("block"))
    to_rest = F.filter(numbers(groups), lambda g: F.pmod(g, F.lit(blocks)) != F.col("block"))

    def met(queries: DataFrame, to: Column) -> DataFrame:
        block = dealt.withColumn("group", F.explode(to)).select("group", "block", *[F.col(c).alias(f"b_{c}") for c in ("row", "vec_id", "v")])
        pairs = queries.select("group", "block", "row", "vec_id", "v", "floor").groupBy("group", "block")
        return pairs.cogroup(block.groupBy("group", "block")).applyInArrow(_meet(k), _FOUND_COLUMNS)

    start = cut(met(queries.withColumn("block", first).withColumn("floor", F.lit(None).cast("long")), to_first))
    floors = start.groupBy(F.col("query").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    others = F.filter(numbers(blocks), lambda b: b != F.col("first"))
    after = queries.join(floors, "row", "left").withColumn("first", first).withColumn("block", F.explode(others))
    found = start if blocks == 1 else start.unionByName(met(after, to_rest))
    place = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    best = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB's SQL, over all pairs of queries and rows.
TOP_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.place <> q.place WHERE q.vec_id % {EVERY} = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {BEST}
"""
