"""Vector search: exact, in blocks of queries, and by an inverted-file index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from foliora.errors import VectorStoreError
from foliora.functions.lineage import cut
from foliora.functions.rows import schema_of
from foliora.functions.vectors import distance_score

#: Queries compared at once with every partition of the vectors; more are taken in further rounds.
BLOCK = 4096
SAMPLE = 20_000  #: vectors on which the cells of an index are fitted, at most


def upsert(stored: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """Rows of ``new``, and those of ``stored`` whose key isn't among them; of repeated new keys any one."""
    fresh = new.dropDuplicates([key])
    return stored.join(fresh.select(key), key, "left_anti").select(stored.columns).unionByName(fresh.select(stored.columns))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _nearest(ids: list, vectors: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, list]]:
    """The ``k`` nearest of some vectors to each query, as (distance, id), ties by id.

    A matrix product picks all that can be among them; their distances are then computed exactly."""
    rough = (vectors**2).sum(1) - 2 * queries @ vectors.T
    margin = 1e-9 * (1 + (vectors**2).sum(1).max() + (queries**2).sum(1).max())
    for q in range(len(queries)):
        if len(ids) > k:
            near = np.flatnonzero(rough[q] <= np.partition(rough[q], k - 1)[k - 1] + margin)
        else:
            near = np.arange(len(ids))
        exact = ((vectors[near] - queries[q]) ** 2).sum(1)
        yield q, sorted(zip(exact.tolist(), (ids[i] for i in near)))[:k]


def search(queries: DataFrame, vectors: DataFrame, top_k: int = 5, query_id: str = "query_id", vec_id: str = "vec_id", group: str | None = None) -> DataFrame:
    """The ``top_k`` vectors nearest each query by squared distance, against all vectors, or those of its ``group``.

    Both sides have a key (``query_id``, ``vec_id``) and an embedding; rows with null key or embedding are left
    out. A query is compared with the vectors of its own width. Queries go in blocks of about ``BLOCK``, by hash
    of their key; each partition of the vectors returns its nearest few of each query, so what is shuffled is
    partitions x queries x top_k."""
    if top_k <= 0:
        raise VectorStoreError("top_k must be above 0.")
    kinds = f"query_id {queries.schema[query_id].dataType.simpleString()}, vec_id {vectors.schema[vec_id].dataType.simpleString()}, distance double"
    part = F.col(group) if group else F.lit(None).cast("string")
    rows = queries.select(F.col(query_id).alias("query_id"), "embedding", part.alias("part")).where("embedding is not null and query_id is not null")
    sides = vectors.select(F.col(vec_id).alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), part.alias("part")).where("embedding is not null and vec_id is not null")
    count = rows.count()
    blocks = -(-count // BLOCK)
    numbered = rows if blocks <= 1 else cut(rows.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))))
    near = vectors.sparkSession.createDataFrame([], schema_of(kinds))
    for b in range(blocks):
        block = (numbered if blocks == 1 else numbered.where(F.col("block") == b)).collect()
        near = _round(block, sides, top_k, schema_of(kinds)) if b == 0 else near.unionByName(_round(block, sides, top_k, schema_of(kinds)))
    order = W.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= top_k).withColumn("vector_score", distance_score(F.col("distance")))


def _round(block, vectors: DataFrame, k: int, schema) -> DataFrame:
    parts: dict = {}
    for r in block:
        parts.setdefault((r["part"], len(r["embedding"])), []).append(r)
    # about BLOCK queries
    held = vectors.sparkSession.sparkContext.broadcast({p: ([r["query_id"] for r in rs], np.array([r["embedding"] for r in rs], float)) for p, rs in parts.items()})

    def run(batches):
        import pyarrow.compute as pc

        arrow = to_arrow_schema(schema)
        best: dict[tuple, list] = {}
        for b in batches:
            ids, widths, of = b.column(0).to_pylist(), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False), np.array(b.column(2).to_pylist(), object)
            for w in set(widths.tolist()):
                of_width = np.flatnonzero(widths == w)
                matrix = _matrix(b.column(1).take(pa.array(of_width)))
                for p, (_, q) in held.value.items():
                    if p[1] != w:
                        continue
                    here = np.arange(len(of_width)) if p[0] is None else np.flatnonzero(of[of_width] == p[0])
                    if len(here):
                        for i, found in _nearest([ids[of_width[x]] for x in here], matrix[here], q, k):
                            best[p, i] = sorted([*best.get((p, i), []), *found])[:k]
        rows = [(held.value[p][0][i], v, d) for (p, i), found in best.items() for d, v in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return vectors.mapInArrow(run, schema)


def fit_cells(vectors: DataFrame, cells: int = 16, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of the cells of an index, by k-means on at most ``SAMPLE`` vectors chosen by hash."""
    rows = vectors.select(F.col("embedding").cast("array<double>")).where("embedding is not null").orderBy(F.xxhash64("embedding")).limit(SAMPLE).collect()
    x = np.array([r[0] for r in rows], float)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1) if len(x) * len(centres) < 2e6 else np.array([((r - centres) ** 2).sum(1).argmin() for r in x])
        centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres


def index(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every vector with the cell of its nearest centre."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)
    schema = schema_of("vec_id bigint, embedding array<double>, cell int")

    def run(batches):
        arrow = to_arrow_schema(schema)
        c = held.value
        for b in batches:
            v = _matrix(b.column(1))
            if len(v):
                cell = ((c**2).sum(1) - 2 * v @ c.T).argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32())], schema=arrow)

    return vectors.where("embedding is not null").select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, schema)


def search_index(queries: DataFrame, indexed: DataFrame, centres: np.ndarray, top_k: int = 5, probes: int = 8) -> DataFrame:
    """Nearest vectors among the ``probes`` cells nearest each query; queries as in ``search``."""
    from foliora.functions.vectors import squared_distance

    held = queries.sparkSession.sparkContext.broadcast(centres)
    schema = schema_of("query_id bigint, q array<double>, cell int")

    def near(batches):
        arrow = to_arrow_schema(schema)
        c = held.value
        for b in batches:
            if len(b):
                v = _matrix(b.column(1))
                cells = np.argsort((c**2).sum(1) - 2 * v @ c.T, axis=1, kind="stable")[:, :probes]
                row = pa.array(np.repeat(np.arange(len(v)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(cells.ravel(), pa.int32())], schema=arrow)

    asked = queries.where("embedding is not null").select(F.col("query_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("q")).mapInArrow(near, schema)
    pairs = indexed.join(asked, "cell").select("query_id", "vec_id", squared_distance(F.col("q"), F.col("embedding")).alias("distance"))
    order = W.partitionBy("query_id").orderBy("distance", "vec_id")
    return pairs.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= top_k).withColumn("vector_score", distance_score(F.col("distance")))


def embed(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 50) -> DataFrame:
    """Key and embedding of every text, in batches of ``batch`` texts for each call of the model."""
    kind = df.schema[key].dataType.simpleString()
    schema = schema_of(f"`{key}` {kind}, embedding array<double>")

    def run(batches):
        arrow = to_arrow_schema(schema)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, arrow.field(1).type)], schema=arrow)

    return df.select(key, text).mapInArrow(run, schema)
