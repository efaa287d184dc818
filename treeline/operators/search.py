"""Exact inner-product search over stored vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, Window, functions as F, types as T

from treeline.functions import paths, text
from treeline.session import materialize

MIN_QUERY_CHARS = 3
MAX_K = 50
_SPACE = " \t\n\r\f\v"
_KNOWN_TERMS = 1 << 18
_STRIPE = 8  # tiles of vectors that a tile of queries meets at once

Encoder = Callable[[list[str]], np.ndarray]


def hashed_terms(width: int = 256) -> Encoder:
    """Encoder that counts lower-cased, space-separated terms in hash buckets.

    A term's bucket is the first 32 bits of its md5 modulo ``width``; buckets of
    frequent terms are kept, up to a bound.
    """
    known: dict[str, int] = {}
    spaces = str.maketrans(_SPACE, " " * len(_SPACE))

    def bucket(term: str) -> int:
        found = known.get(term)
        if found is None:
            found = int.from_bytes(hashlib.md5(term.encode("utf-8")).digest()[:4], "big") % width
            if len(known) < _KNOWN_TERMS:
                known[term] = found
        return found

    def encode(texts: list[str]) -> np.ndarray:
        vectors = np.zeros((len(texts), width))
        for vector, one in zip(vectors, texts):
            buckets = [bucket(term) for term in one.lower().translate(spaces).split(" ") if term]
            vector += np.bincount(buckets, minlength=width) if buckets else 0
        return vectors

    return encode


def indexable(
    files: DataFrame, exclude_third_party: bool = True, exclude_tests: bool = True
) -> DataFrame:
    """Files admitted to the index: known extension, more than 20 characters of text."""
    path = F.col("path")
    return files.where(
        F.lower(paths.extension(path)).isin(*paths.SEARCH_EXTENSIONS)
        & paths.keep_path(path, exclude_third_party, exclude_tests)
    ).where(text.stripped_length(F.col("content")) > 20)


def embed(
    docs: DataFrame, id_col: str, text_col: str, encode: Encoder | None = None
) -> DataFrame:
    """``id, embedding``: unit vectors from a batch encoder, hashed terms by default.

    A text without any term keeps a zero vector.
    """
    encode = encode or hashed_terms()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.asarray(encode(batch.column("t").to_pylist()), dtype=np.float64)
            norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
            offsets = np.arange(len(unit) + 1, dtype=np.int32) * unit.shape[1]
            lists = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(unit.ravel().astype(np.float32))
            )
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "embedding"])

    schema = T.StructType([
        T.StructField("id", source.schema["id"].dataType),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ])
    return source.mapInArrow(run, schema)


def embed_with_model(
    docs: DataFrame, id_col: str, text_col: str, load: Callable[[], Encoder], batch_rows: int = 64
) -> DataFrame:
    """``id, embedding``: unit vectors from a model that every Python worker loads once.

    ``load`` builds or reads the model where it runs and returns the function that turns
    an array of texts into a matrix with a row per text; it gets up to ``batch_rows``
    texts at a time. A null text reads as empty; a zero vector stays one.
    """
    predict = predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch_rows)
    rows = docs.select(F.col(id_col).alias("id"), predict(F.coalesce(F.col(text_col), F.lit(""))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    unit = F.transform("v", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0).cast("float"))
    return rows.withColumn("norm", norm).select("id", unit.alias("embedding"))


def _packed(rows: DataFrame, id_col: str, size: int, name: str) -> DataFrame:
    """``rows (id, embedding)`` as tiles of up to ``size``: ``tile, ids, matrix, width``; rows stay where they lie."""
    source = rows.select(F.col(id_col).alias("id"), "embedding")
    kind = source.schema["id"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, count = TaskContext.get().partitionId() << 33, [], [], 0

        def tile() -> pa.RecordBatch:
            names, matrix = pa.concat_arrays(ids), np.concatenate(held)
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                pa.array([matrix.tobytes()], pa.binary()), pa.array([matrix.shape[1]], pa.int32()),
            ], ["tile", "ids", "matrix", "width"])

        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                lists = part.column("embedding")
                matrix = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)
                if count + len(matrix) > size:
                    yield tile()
                    number, ids, held, count = number + 1, [], [], 0
                ids.append(part.column("id"))
                held.append(matrix)
                count += len(matrix)
        if count:
            yield tile()

    schema = T.StructType([
        T.StructField("tile", T.LongType()), T.StructField("ids", T.ArrayType(kind)),
        T.StructField("matrix", T.BinaryType()), T.StructField("width", T.IntegerType()),
    ])
    return materialize(source.mapInArrow(pack, schema), name)


def _best(names: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores of every row with their names, ties to smaller names."""
    order = np.lexsort((names, -scores), axis=1)[:, :k]
    return np.take_along_axis(names, order, axis=1), np.take_along_axis(scores, order, axis=1)


def _cell_scores(cells: DataFrame, kind: T.DataType, k: int) -> DataFrame:
    """``query_id, id, score``: the best ``k`` of every query in the cells of a task that follow one another."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = asked = names = scores = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(asked, scores.shape[1]), pa.int64()), pa.array(names.ravel().tolist()), pa.array(scores.ravel()),
            ], ["query_id", "id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                query_tile, width = batch.column("query_tile")[i].as_py(), batch.column("width")[i].as_py()
                if query_tile != current:
                    if current is not None:
                        yield out()
                    current, names = query_tile, None
                    asked = np.array(batch.column("query_ids")[i].as_py(), np.int64)
                queries = np.frombuffer(batch.column("query_matrix")[i].as_py()).reshape(-1, width)
                here = np.frombuffer(batch.column("matrix")[i].as_py()).reshape(-1, width)
                ids = np.array(batch.column("ids")[i].as_py())
                order = np.argsort(ids, kind="stable")
                found = (queries @ here[order].T).round(6)
                top = np.argsort(-found, axis=1, kind="stable")[:, :k]
                better = ids[order][top], np.take_along_axis(found, top, axis=1)
                if names is not None:
                    better = _best(np.hstack([names, better[0]]), np.hstack([scores, better[1]]), k)
                names, scores = better
        if current is not None:
            yield out()

    schema = T.StructType([
        T.StructField("query_id", T.LongType()), T.StructField("id", kind), T.StructField("score", T.DoubleType()),
    ])
    return cells.select("query_tile", "query_ids", "query_matrix", "ids", "matrix", "width").mapInArrow(score, schema)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, query_tile: int = 512, vector_tile: int = 4096, max_k: int = MAX_K
) -> DataFrame:
    """The ``k`` best vectors of every query: ``query_id, id, score, rank``.

    ``queries`` has ``query_id, embedding``; a ``query_id`` names one query, and
    rows without id or vector are left out on either side. Vectors and queries are
    written as tiles, and every tile of queries meets every tile of vectors in a
    join on the numbers of stripes of vector tiles: a cell is one matrix product,
    and tasks keep ``k`` rows per query. Neither side passes through the driver or is
    held by one task. Ties rank by id. ``max_k`` is the largest ``k`` that a caller
    may ask for.
    """
    if not 1 <= k <= max_k:
        raise ValueError(f"k must lie in 1..{max_k}")
    asked = queries.select("query_id", "embedding").where("query_id is not null and embedding is not null").dropDuplicates(["query_id"])
    asking = _packed(asked.withColumn("query_id", F.col("query_id").cast("long")), "query_id", query_tile, "query-tiles")
    tiles = _packed(vectors.where("id is not null and embedding is not null"), "id", vector_tile, "vector-tiles")
    stripes = tiles.count() // _STRIPE + 1
    met = asking.select(
        F.col("tile").alias("query_tile"), F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"),
        F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"),
    ).join(tiles.withColumn("stripe", F.pmod(F.xxhash64("tile"), F.lit(stripes)).cast("int")), "stripe")
    found = _cell_scores(met, vectors.schema["id"].dataType, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def judged_queries(asked: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Queries that can be asked, and ``query_id, reason`` of those that cannot."""
    short = F.coalesce(F.length(text_col) < MIN_QUERY_CHARS, F.lit(True))
    reason = F.concat(F.lit("a query needs at least "), F.lit(MIN_QUERY_CHARS), F.lit(" characters"))
    return asked.where(~short), asked.where(short).select(F.col(id_col).alias("query_id"), reason.alias("reason"))


def search_text(
    vectors: DataFrame, query: str, k: int = 10, encode: Encoder | None = None
) -> DataFrame:
    """Search with one query text of at least three characters."""
    if len(query) < MIN_QUERY_CHARS:
        raise ValueError(f"a query needs at least {MIN_QUERY_CHARS} characters")
    spark = vectors.sparkSession
    asked = spark.createDataFrame([(0, query)], "query_id bigint, text string")
    queries = embed(asked, "query_id", "text", encode).withColumnRenamed("id", "query_id")
    return search(vectors, queries, k).drop("query_id")
