"""Vector search: a hash embedder, cosine, exact top-k, and an inverted file of cells."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.ranking import Best

DIMENSIONS = 256
#: Rows of a block of queries, and of data; a pair of blocks is one small matrix product.
QUERY_BLOCK, DATA_BLOCK = 512, 8_192
#: Bytes of queries that may be sent to all tasks.
MOST_QUERY_BYTES = 32 << 20
_TOKEN = re.compile(r"[a-z$_][a-z0-9$_]*")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, summed in double; 0 where a norm is 0, null where lengths differ."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), zero, lambda s, v: s + v)
    norm = F.sqrt(F.aggregate(x, zero, lambda s, v: s + v * v)) * F.sqrt(F.aggregate(y, zero, lambda s, v: s + v * v))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, zero).otherwise(dot / norm))


#: Tokens whose hash a worker keeps; beyond it the table starts anew.
MOST_HASHED = 1 << 18


class _Cells(dict):
    """The number of each token's cell: its dimension, and more by ``dimensions`` where its sign is negative."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def __missing__(self, token: str) -> int:
        h = hashlib.sha1(token.encode()).digest()
        cell = self[token] = int.from_bytes(h[:2], "big") % self.dimensions + h[2] % 2 * self.dimensions
        return cell


def mock_vectors(rows: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS, keep_empty: bool = False) -> DataFrame:
    """(key, vector array<double>): the normalised hash embedding of each row's text, made inside the row.

    A token goes to the dimension of its SHA-1's first two bytes modulo ``dimensions``, with the sign of the third byte's parity. Texts
    without tokens, and those whose tokens cancel out, give no row, or with ``keep_empty`` a vector of zeros.
    """
    kind = dict(rows.dtypes)[key]

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(dimensions)
        for batch in batches:
            held, counts = [], np.zeros(len(batch), np.int64)
            for i, low in enumerate(batch.column("low").to_pylist()):
                if low:
                    tokens = _TOKEN.findall(low)
                    counts[i] = len(tokens)
                    held.extend(map(cells.__getitem__, tokens))
                    if len(cells) > MOST_HASHED:
                        cells.clear()
            # A cell and its sign are one number: the first half of the numbers adds, the second takes away.
            cell = np.array(held, dtype=np.int64)
            spots = np.repeat(np.arange(len(batch)), counts) * dimensions + cell % dimensions
            # Without any token the counts aren't floats.
            m = np.bincount(spots, np.where(cell < dimensions, 1.0, -1.0), len(batch) * dimensions).astype(np.float64).reshape(len(batch), dimensions)
            has = m.any(axis=1)
            keys = batch.column("key")
            if not keep_empty:
                keys, m = keys.filter(pa.array(has)), m[has]
            ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, pa.array(_normal(m).ravel()))], names=["key", "vector"])

    made = rows.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("low")).mapInArrow(embed, f"key {kind}, vector array<double>")
    return made.withColumnRenamed("key", key)


def mock_embedding(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, value): ``mock_vectors`` without zeros."""
    return mock_vectors(rows, key, text).select(key, F.posexplode("vector").alias("idx", "value")).filter("value <> 0")


def embed_with(rows: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]], most_chars: int = 4_000) -> DataFrame:
    """(key, vector array<float>) by a plugged-in model that embeds lists of texts; runs on Arrow batches."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = embedder([(t or "")[:most_chars] for t in batch[text]])
            yield pd.DataFrame({key: batch[key], "vector": [list(map(float, v)) for v in vectors]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInPandas(embed, f"{key} {kind}, vector array<float>")


def _matrix(rows: list) -> np.ndarray:
    return _normal(np.array(rows, dtype=np.float64))


def _normal(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _by_size(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(size, ids, matrix) of the vectors of each size."""
    long = pc.list_value_length(vectors)
    for size in pc.unique(long).to_pylist():
        has = pc.equal(long, size)
        own = vectors.filter(has)
        yield size, ids.filter(has), own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), size)


def _best(queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, scores) of the ``k`` best rows for each query; ties go to the lesser id."""
    order = np.array(sorted(range(len(ids)), key=ids.__getitem__))
    scores = np.round(queries @ data[order].T, 9)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return order[best], np.take_along_axis(scores, best, axis=1)


def top_k(data: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 20, query_key: str = "query") -> DataFrame:
    """(query, key, score, rank): the ``k`` nearest rows by cosine to each row of ``queries(query, vector)``, exactly.

    Queries that fit ``MOST_QUERY_BYTES``, which is counted first, travel to the data, which never moves: each partition keeps its ``k``
    best rows for each query, and only these are shuffled. More queries are packed into blocks as the data is, and every pair
    of blocks is one matrix product in a task of its own. No pair of rows is materialised. Null vectors are left out, zero
    vectors score 0, ties go to the lesser key. Rows of a dimension other than the query's are not compared.
    """
    kind, query_kind = dict(data.dtypes)[key], dict(queries.dtypes)[query_key]
    schema = f"{query_key} {query_kind}, {key} {kind}, score double"
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(query_key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n, numbers = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    if n * 64 + numbers * 8 > MOST_QUERY_BYTES:
        found = _block_pairs(data, queries, key, vector, k, query_key, schema)
    else:
        rows = asked.toArrow().combine_chunks()
        by_size = {size: (ids, _normal(m)) for size, ids, m in _by_size(rows["id"].combine_chunks(), rows["v"].combine_chunks())}
        shared = data.sparkSession.sparkContext.broadcast(by_size)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[tuple[int, int], Best] = {}
            for batch in batches:
                for size, ids, m in _by_size(batch.column("id"), batch.column("v")):
                    if size not in shared.value:
                        continue
                    asked, parts = shared.value[size][1], -(-len(m) // DATA_BLOCK)
                    for ids_of, block in zip(np.array_split(np.arange(len(m)), parts), np.array_split(_normal(m), parts)):
                        for first in range(0, len(asked), QUERY_BLOCK):
                            q = asked[first : first + QUERY_BLOCK]
                            own = kept.setdefault((size, first), Best(k, len(q)))
                            own.add(q @ block.T, ids.slice(ids_of[0], len(block)))
            for (size, first), own in kept.items():
                names = shared.value[size][0].take(pa.array(own.query + first))
                yield pa.RecordBatch.from_arrays([names, own.keys, pa.array(own.near)], names=[query_key, key, "score"])

        rows = data.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        found = rows.mapInArrow(nearest, schema)
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block_pairs(data: DataFrame, queries: DataFrame, key: str, vector: str, k: int, query_key: str, schema: str) -> DataFrame:
    """The best rows of each pair of a block of queries and a block of data."""

    def packed(df: DataFrame, name: str, size: int, out: str) -> DataFrame:
        rows = df.filter(F.col(vector).isNotNull()).select(F.col(name).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        n = max(1, -(-rows.count() // size))
        return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(f"{out}_block")).agg(F.collect_list(F.struct("id", "v")).alias(out))

    # Every query against all rows, in blocks.
    pairs = packed(data, key, DATA_BLOCK, "d").crossJoin(packed(queries, query_key, QUERY_BLOCK, "q")).select("q", "d")

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_rows, d_rows in zip(batch["q"], batch["d"]):
                by_size: dict[int, tuple[list, list]] = {}
                for side, rows in enumerate((q_rows, d_rows)):
                    for row in rows:
                        by_size.setdefault(len(row["v"]), ([], []))[side].append(row)
                for qs, ds in by_size.values():
                    if qs and ds:
                        ids = np.array([r["id"] for r in ds], dtype=object)
                        places, scores = _best(_matrix([r["v"] for r in qs]), ids, _matrix([r["v"] for r in ds]), k)
                        yield pd.DataFrame({query_key: [r["id"] for r in qs for _ in range(places.shape[1])], key: ids[places].ravel(), "score": scores.ravel()})

    return pairs.mapInPandas(nearest, schema)


#: Cells of an inverted file: about the square root of the rows, at most so many; rows of the sample that they are fitted on, and rounds.
MOST_CELLS, SAMPLE, FIT_ROUNDS = 4_096, 20_000, 10


def fit_cells(data: DataFrame, key: str, vector: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 42) -> np.ndarray:
    """Centroids of a coarse partition of the vectors, fitted by k-means on at most ``sample`` rows, those of the least hashes."""
    rows = data.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.xxhash64(key).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    points = [r["v"] for r in rows.orderBy("h").limit(sample).collect()]
    if not points:
        return np.zeros((0, 0))
    width = Counter(map(len, points)).most_common(1)[0][0]
    m = _matrix([p for p in points if len(p) == width])
    count = min(cells or max(1, int(np.sqrt(n))), MOST_CELLS, len(m))
    centres = m[np.random.default_rng(seed).choice(len(m), count, replace=False)]
    for _ in range(FIT_ROUNDS):
        near = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        filled = np.bincount(near, minlength=count) > 0
        centres = np.where(filled[:, None], sums, centres)
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def in_cells(data: DataFrame, key: str, vector: str, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """(key, vector, cell): each row in its nearest cells, one of them or ``probes``; every row with a vector of the fitted width is covered."""
    kind = dict(data.dtypes)[key]
    shared = data.sparkSession.sparkContext.broadcast(centres)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for batch in batches:
            batch = batch[batch["vector"].map(len) == c.shape[1]]
            if len(batch):
                near = np.argsort(-(_matrix(list(batch["vector"])) @ c.T), axis=1, kind="stable")[:, :probes]
                yield batch.loc[batch.index.repeat(near.shape[1])].assign(cell=near.ravel().astype(np.int32))

    rows = data.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.mapInPandas(placed, f"key {kind}, vector array<double>, cell int").withColumnRenamed("key", key)


#: Queries, those of the least hashes, by which the number of cells to probe is chosen, and the share of true neighbours that these must hold.
PROBED, WANTED = 100, 0.95


def choose_probes(data: DataFrame, queries: DataFrame, centres: np.ndarray, key: str, vector: str, k: int = 20, query_key: str = "query", wanted: float = WANTED) -> int:
    """The least number of cells whose rows hold ``wanted`` of the true neighbours of at most ``PROBED`` queries, found by brute force."""
    sample = queries.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(query_key)).limit(PROBED)
    exact = top_k(data, sample, key, vector, k, query_key).select(query_key, key)
    both = exact.join(sample.select(query_key, F.col(vector).alias("_q")), query_key).join(data.select(key, F.col(vector).alias("_d")), key)
    # At most PROBED * k pairs.
    pairs = [(r["_q"], r["_d"]) for r in both.select("_q", "_d").collect() if len(r["_d"]) == centres.shape[1]]
    if not pairs:
        return 1
    own = (_matrix([d for _, d in pairs]) @ centres.T).argmax(axis=1)
    order = np.argsort(-(_matrix([q for q, _ in pairs]) @ centres.T), axis=1, kind="stable")
    places = np.sort((order == own[:, None]).argmax(axis=1))
    return int(places[min(len(places) - 1, int(np.ceil(wanted * len(places))) - 1)]) + 1


def top_k_in_cells(celled: DataFrame, queries: DataFrame, centres: np.ndarray, key: str, vector: str, k: int = 20, probes: int = 16, query_key: str = "query") -> DataFrame:
    """(query, key, score, rank): as ``top_k`` but each query is compared with the rows of its ``probes`` nearest cells only.

    Rows and queries meet by (cell, slice): a cell is cut into slices of bounded size by the hash of its rows, so a crowded one is no single task.
    """
    kind, query_kind = dict(celled.dtypes)[key], dict(queries.dtypes)[query_key]
    slices = celled.groupBy("cell").agg(F.ceil(F.count("*") / DATA_BLOCK).cast("int").alias("slices"))
    # At most MOST_CELLS rows.
    slices = F.broadcast(slices)
    data = celled.join(slices, "cell").select("cell", F.pmod(F.xxhash64(key), F.col("slices")).cast("int").alias("slice"), F.struct(F.col(key).alias("id"), F.col("vector").alias("v")).alias("r"))
    asked = in_cells(queries, query_key, vector, centres, probes).join(slices, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.struct(F.col(query_key).alias("id"), F.col("vector").alias("v")).alias("r")
    )
    packed_data = data.groupBy("cell", "slice").agg(F.collect_list("r").alias("d"))
    block = F.pmod(F.xxhash64("r.id"), F.lit(max(1, -(-asked.count() // QUERY_BLOCK)))).alias("block")
    packed_asked = asked.groupBy("cell", "slice", block).agg(F.collect_list("r").alias("q"))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qs, ds in zip(batch["q"], batch["d"]):
                ids = np.array([r["id"] for r in ds], dtype=object)
                places, scores = _best(_matrix([r["v"] for r in qs]), ids, _matrix([r["v"] for r in ds]), k)
                yield pd.DataFrame({query_key: [r["id"] for r in qs for _ in range(places.shape[1])], key: ids[places].ravel(), "score": scores.ravel()})

    found = packed_data.join(packed_asked, ["cell", "slice"]).select("q", "d").mapInPandas(nearest, f"{query_key} {query_kind}, {key} {kind}, score double")
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def matches_filters(kinds: list[str] | None = None, path_prefix: str | None = None, language: str | None = None) -> Column:
    """Filters of vector search: kind in a list, a folder that is an ancestor (column ``dirs``), and language."""
    keep = F.lit(True)
    if kinds:
        keep = keep & F.lower("kind").isin([k.lower() for k in kinds])
    if path_prefix:
        keep = keep & F.array_contains("dirs", path_prefix.rstrip("/"))
    if language:
        keep = keep & (F.col("language") == language)
    return keep
