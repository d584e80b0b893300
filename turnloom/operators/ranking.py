"""Passages by similarity to questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import cut, map_batches

#: Bytes of the vectors of a block of queries; a block is sent to all executors.
BLOCK_BYTES = 32 << 20
#: Scores that a task holds at a time.
TILE = 1 << 22


def _unit(vectors: list[list[float] | None]) -> np.ndarray:
    """Rows of length one; a null vector and one of zeros have no direction (nan)."""
    dims = max((len(v) for v in vectors if v is not None), default=0)
    out = np.full((len(vectors), dims), np.nan)
    for k, v in enumerate(vectors):
        if v is not None and len(v) == dims:
            out[k] = v
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, np.nan)


def similar_vectors(queries: DataFrame, corpus: DataFrame, k: int = 5, query: str = "query_id", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query, key, score, nth``: the k nearest rows of the corpus to each query by cosine, ties by key.  Queries go in
    blocks over all rows of the corpus, each as one matrix product for a batch; a task keeps k rows for a query and
    batch before anything is shuffled.  Vectors without a direction or of another length are near to nothing."""
    spark = corpus.sparkSession
    sized = queries.where(F.col(vector).isNotNull()).agg(F.count("*"), F.max(F.size(vector))).first()
    blocks = max(1, -(-(sized[0] * (sized[1] or 1) * 8) // BLOCK_BYTES))
    kinds = {c: d.schema[c].dataType.simpleString() for c, d in ((query, queries), (key, corpus))}
    rows = corpus.select(key, vector).where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    out = None
    for b in range(blocks):
        block = queries.select(query, vector).where(F.col(vector).isNotNull() & (F.pmod(F.xxhash64(query), F.lit(blocks)) == b)).toArrow()  # bounded by BLOCK_BYTES, about
        shared = spark.sparkContext.broadcast((block.column(0).combine_chunks(), _unit(block.column(1).to_pylist())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                step = max(1, TILE // max(len(ids), 1))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    v = _unit(part.column(1).to_pylist())
                    if not len(ids) or not len(v) or v.shape[1] != q.shape[1]:
                        continue
                    scores = np.round(v @ q.T, 6)
                    scores[np.isnan(scores)] = -np.inf
                    least = -np.partition(-scores, k - 1, axis=0)[k - 1] if len(v) > k else np.full(len(ids), -2.0)
                    row, col = np.nonzero((scores >= least) & np.isfinite(scores))  # ties at the border stay
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(col)), part.column(0).take(pa.array(row)), pa.array(scores[row, col])], names=[query, key, "score"])

        near = map_batches(rows, run, f"`{query}` {kinds[query]}, `{key}` {kinds[key]}, score double")
        out = near if out is None else out.unionByName(near)
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return out.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def words_and_pairs(text: Column) -> Column:
    """As ``words``, but a run of Chinese characters gives its pairs of neighbours (a single one itself): a segmenter
    for text without blanks that needs no dictionary."""
    runs = words(F.regexp_replace(text, r"(\p{IsHan}+)", " $1 "))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substr(r, k, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^\p{IsHan}{2,}\z"), pairs(r)).otherwise(F.array(r))))


#: Different terms of all queries that are sent to every executor; more are joined by shuffling.
SENT_TERMS = 500_000


def bm25(queries: DataFrame, corpus: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75, query: str = "query_id", key: str = "doc_id", text: str = "text", segment: Callable[[Column], Column] = words) -> DataFrame:
    """``query, key, score, nth`` by BM25 with idf ln(1 + (n - df + 0.5) / (df + 0.5)), ties by key.  Counts come from all
    documents, but only terms that are asked for are counted and shuffled.  ``segment``: from text to its terms."""
    docs = corpus.where(F.col(text).isNotNull()).select(key, segment(F.col(text)).alias("w"))
    asked = queries.select(query, F.explode(F.array_distinct(segment(F.col(text)))).alias("term"))
    terms = cut(asked.select("term").distinct())
    few = terms.count() <= SENT_TERMS
    sized = docs.select(key, F.size("w").alias("len"), F.explode("w").alias("term")).join(F.broadcast(terms) if few else terms, "term", "left_semi")
    tf = sized.groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avg"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    hits = asked.join(df, "term").join(tf, "term").join(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scored = hits.groupBy(query, key).agg(F.round(F.sum(score), 6).alias("score"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scored.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def fused(first: DataFrame, second: DataFrame, k: int = 5, weights: tuple[float, float] = (0.5, 0.5), c: float = 2.0, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Weighted rank fusion of two rankings: the sum of weight / (c + rank)."""
    part = lambda d, w: d.select(query, key, (F.lit(w) / (c + F.col("nth"))).alias("s"))
    both = part(first, weights[0]).unionByName(part(second, weights[1]))
    scored = both.groupBy(query, key).agg(F.round(F.sum("s"), 6).alias("score"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scored.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def with_passages(queries: DataFrame, ranking: DataFrame, corpus: DataFrame, query: str = "query_id", key: str = "doc_id", text: str = "text", none: str = "") -> DataFrame:
    """Each query with its passages in order of rank; a query without any has an empty list and the message ``none``."""
    found = ranking.join(corpus.select(key, F.col(text).alias("_t")), key).groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "_t"))), lambda x: x["_t"]).alias("passages"))
    out = queries.join(found, query, "left")
    return out.withColumn("message", F.when(F.col("passages").isNull(), none)).withColumn("passages", F.coalesce("passages", F.array().cast("array<string>")))
