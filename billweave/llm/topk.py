"""Exact top-k inner products by norm buckets.

Vectors are grouped by length (number of components, then a geometric bucket of the norm)
and cut into blocks of ``block_rows``. Every query first meets the blocks of the longest
vectors of its kind, which gives a score its k-th best cannot fall below. With this bound
theta a bucket of norm at most b needs a cosine of theta / (|q| b): above one the bucket is
pruned by length. Elsewhere the local threshold chooses the method: a high cosine
threshold prunes by coordinates (a vector of that cosine must be near the query's strongest
coordinate), a low one by length (only vectors with |x| >= theta / |q|). What is left is
verified by exact integer products. Queries travel in blocks too; a query block meets a
candidate block in one task, and only scores that can still be among the best leave it.
Blocks hold components in the narrowest integers that take them all. Every query block goes to every slot of
candidate blocks, so there are as many slots as make the copies about as large as the candidates, and never a broadcast.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.session import cut_lineage

BLOCK_ROWS = 2048
BUCKETS_PER_OCTAVE = 8
COORDINATE_FROM = 0.7
_NO_BOUND = -(1 << 63)
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def integer_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, ints, norm2, one row per input row. A vector takes no part if null, or with a null or non-finite component;

    a null id takes no part. Repeated ids are rows of their own. A component that leaves the range of a long is an error.
    """
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))

    def whole(v: Column) -> Column:
        wide = v.cast("double") * scale
        return F.when(F.abs(wide) < 2.0**63, F.floor(wide)).otherwise(F.raise_error(F.lit("a component leaves the range of a long")).cast("bigint"))

    square = F.aggregate("ints", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    usable = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & finite)
    return usable.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, whole).alias("ints")).withColumn("norm2", square)


def _bucketed(vectors: DataFrame) -> DataFrame:
    """Bucket: an integer that grows with the norm; its exact bounds are taken from the rows."""
    level = F.when(F.col("norm2") > 0, F.floor(F.log2(F.col("norm2")) * (BUCKETS_PER_OCTAVE / 2))).otherwise(-1)
    return vectors.select("vec_id", F.monotonically_increasing_id().alias("row"), "ints", "norm2", F.size("ints").alias("dim"), level.cast("int").alias("bucket"))


def _blocks(rows: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """Blocks of rows of one key as binary matrices, longest vectors first; the rows of a key are spread over its blocks by their numbers.

    ``theta``: the score each row must reach as a query; ``need``: the shortest vector that lets any of them.
    """
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_parts"))
    salted = rows.join(counts, keys).withColumn("_part", F.pmod(F.xxhash64("row"), F.col("_parts")).cast("int"))
    schema = ", ".join(f"{k} int" for k in keys) + ", part int, n int, norm_to double, need double, ids binary, theta binary, vectors binary"

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        theta = table.column("theta").to_numpy()
        norm = np.sqrt(table.column("norm2").to_numpy())
        values = table.column("ints").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.lexsort((ids, -norm))
        need = np.where(theta > 0, np.divide(theta, norm, out=np.full(len(ids), np.inf), where=norm > 0), 0).min()
        row = [table.column(k)[0].as_py() for k in [*keys, "_part"]]
        row += [len(ids), float(norm.max()), float(need) * (1 - 1e-9), ids[order].tobytes(), theta[order].tobytes(), _narrow(values[order]).tobytes()]
        kinds = [pa.int32()] * (len(keys) + 2) + [pa.float64()] * 2 + [pa.binary()] * 3
        return pa.table([pa.array([v], kind) for v, kind in zip(row, kinds)], names=[c.split()[0] for c in schema.split(", ")])

    return salted.groupBy(*keys, "_part").applyInArrow(pack, schema)


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes that hold each of them."""
    low, high = values.min(initial=0), values.max(initial=0)
    return values.astype(next(kind for kind in _WIDTHS if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max))


def _matrix(packed: np.ndarray, rows: int, dim: int) -> np.ndarray:
    """The long integers of a block; how many bytes each has follows from the block's size."""
    width = len(packed) // max(1, rows * dim)
    kind = next((kind for kind in _WIDTHS if np.dtype(kind).itemsize == width), np.int64)
    return packed.view(kind).reshape(rows, dim).astype(np.int64)


def _products(q: np.ndarray, x: np.ndarray, q_ids: np.ndarray, x_ids: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles while every sum stays below 2**53, then long integers, beyond them Python's own.

    A row is no candidate of its own, so its product with itself may leave the range of a long.
    """
    bound = float(np.sqrt((q.astype(float) ** 2).sum(1).max(initial=0)) * np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0)))
    if bound < 2**52:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return q @ x.T
    exact = q.astype(object) @ x.T.astype(object)
    exact[q_ids[:, None] == x_ids[None, :]] = 0
    if exact.size and (exact.max() >= 1 << 63 or exact.min() < -(1 << 63)):
        raise ValueError("an inner product leaves the range of a long")
    return exact.astype(np.int64)


def search_block(q: np.ndarray, q_ids: np.ndarray, theta: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of a block (by score, then id) for each query, of those with a score of theta or more."""
    q_norm, x_norm = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((x.astype(float) ** 2).sum(1))
    longest = x_norm.max(initial=0)
    reach = q_norm * longest
    needed = np.divide(theta, reach, out=np.where(theta > 0, np.inf, -np.inf), where=reach > 0)
    needed = np.where(needed > 0, needed * (1 - 1e-9), needed)
    out: list[tuple] = []
    by_length = np.flatnonzero(needed < COORDINATE_FROM)
    if len(by_length):
        # length pruning: rows are sorted by norm, so what is long enough for the easiest of these queries is a prefix
        floor = np.where(theta[by_length] > 0, theta[by_length] / np.maximum(q_norm[by_length], 1e-300), 0).min() * (1 - 1e-9)
        n = int(np.searchsorted(-x_norm, -floor, "right"))
        out.append(_best(_products(q[by_length], x[:n], q_ids[by_length], x_ids[:n]), by_length, x_ids[:n], q_ids, theta, k))
    for i in np.flatnonzero((needed >= COORDINATE_FROM) & (needed <= 1)):
        # coordinate pruning: unit vectors of cosine t differ by at most sqrt(2 - 2t), hence in each coordinate
        focus = int(np.abs(q[i]).argmax())
        gap = np.sqrt(max(0.0, 2 - 2 * needed[i])) + 1e-9
        unit = x[:, focus] / np.maximum(x_norm, 1e-300)
        # a shorter vector needs a higher cosine than the bucket's threshold, so the bound holds for all of them
        near = np.flatnonzero(np.abs(unit - q[i, focus] / q_norm[i]) <= gap)
        if len(near):
            out.append(_best(_products(q[i : i + 1], x[near], q_ids[i : i + 1], x_ids[near]), np.array([i]), x_ids[near], q_ids, theta, k))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(part) for part in zip(*out))


def _best(scores: np.ndarray, rows: np.ndarray, x_ids: np.ndarray, q_ids: np.ndarray, theta: np.ndarray, k: int):
    a, b, s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    # most queries have nothing left that reaches their bound
    for at in np.flatnonzero((scores >= theta[rows][:, None]).any(axis=1)):
        row, line = rows[at], scores[at]
        ok = np.flatnonzero((line >= theta[row]) & (x_ids != q_ids[row]))
        if len(ok) > k:
            cut = np.partition(line[ok], len(ok) - k)[len(ok) - k]
            ok = ok[line[ok] >= cut]
            ok = ok[np.lexsort((x_ids[ok], -line[ok]))][:k]
        a.append(np.full(len(ok), q_ids[row]))
        b.append(x_ids[ok])
        s.append(line[ok])
    return np.concatenate(a), np.concatenate(b), np.concatenate(s)


def _meet(pairs: DataFrame, k: int) -> DataFrame:
    """Joined rows of a query block and a candidate block to scored pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                read = lambda c, kind: np.frombuffer(columns[c][i].as_buffer(), kind)  # noqa: B023, E731
                q_ids, x_ids = read("q_ids", np.int64), read("ids", np.int64)
                dim = columns["dim"][i].as_py()
                q, x = _matrix(read("q_vectors", np.uint8), len(q_ids), dim), _matrix(read("vectors", np.uint8), len(x_ids), dim)
                found = search_block(q, q_ids, read("q_theta", np.int64), x, x_ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def _kept(scored: DataFrame, k: int) -> DataFrame:
    """The best k of each query; Spark cuts to k in every task before it shuffles."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, query_every: int = 50, block_rows: int = BLOCK_ROWS, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row whose id is divisible by ``query_every``.

    Candidates are all rows of other ids with as many components. Ties go to the smaller id. Rows that share an id are
    candidates each, and one query together. A product that leaves the range of a long is an error.
    An empty table, or a query alone among vectors of its size, gives no rows.
    """
    rows = cut_lineage(_bucketed(integer_vectors(vectors, vec_id=vec_id, embedding=embedding, scale=scale)).withColumn("theta", F.lit(_NO_BOUND)))
    candidates = cut_lineage(_blocks(rows, ["dim", "bucket"], block_rows))
    queries = rows.where(F.col("vec_id") % query_every == 0)

    def as_queries(blocks: DataFrame) -> DataFrame:
        return blocks.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("need", "ids", "theta", "vectors")])

    # a first bound from the longest vectors: one block of the highest bucket of each dimension
    top = Window.partitionBy("dim").orderBy(F.desc("norm_to"), F.desc("n"), "bucket", "part")
    head = candidates.withColumn("_r", F.row_number().over(top)).where("_r = 1").drop("_r")
    first = _meet(as_queries(_blocks(queries, ["dim"], block_rows)).join(head, "dim"), k)
    bound = _kept(first, k).groupBy("query_id").agg(F.min("score").alias("_low"), F.count(F.lit(1)).alias("_n"))
    bound = bound.where(F.col("_n") == k).select(F.col("query_id").alias("vec_id"), "_low")
    queries = queries.join(bound, "vec_id", "left").withColumn("theta", F.coalesce("_low", "theta")).drop("_low")
    # every query block goes once to each slot of candidate blocks, so that no task gets all blocks of a dimension; the copies are
    # made behind the last size Spark can see, so the join must not go by it, and the slots are the partitions: few bytes, much work
    spark = vectors.sparkSession
    asked, offered = rows.agg(F.count_if(F.col("vec_id") % query_every == 0), F.count(F.lit(1))).first()
    slots = max(2 * spark.sparkContext.defaultParallelism, min(int(spark.conf.get("spark.sql.shuffle.partitions")), offered // max(1, asked)))
    blocks = as_queries(_blocks(queries, ["dim", "bucket"], block_rows)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    placed = candidates.withColumn("slot", F.pmod(F.xxhash64("bucket", "part"), F.lit(slots)).cast("int"))
    parts = max(slots, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks, placed = blocks.repartition(parts, "dim", "slot"), placed.repartition(parts, "dim", "slot")
    pairs = blocks.hint("merge").join(placed, ["dim", "slot"]).where(F.col("norm_to") >= F.col("q_need"))
    return _kept(_meet(pairs, k), k).select("query_id", "rank", "vec_id", "score")
