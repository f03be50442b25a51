"""Exact vector search, thresholds and text-first retrieval with fallback.

Records: (vec_id, modality, embedding), with document_id where a query searches its own document.
Over all records, queries go in blocks of bounded size to where the records are; no record travels.
Within documents, blocks of records and blocks of queries meet in a join by document, salted so
that a large document is many tasks.  Every block returns its best k per query and modality and a
window merges them; no pair is written out that cannot be in a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: results per modality, thresholds and caps of the default profile
CANDIDATES = {"text": 15, "table": 5, "image": 5}
THRESHOLDS = {"text": 0.70, "table": 0.65, "image": 0.55}
CAPS = {"table": 4, "image": 3}
LEAST_TEXT = 6
#: Queries in one block; with 1,024 doubles each a block is about 16 MB.
QUERIES_PER_BLOCK = 2048
#: Records scored at once; the score matrix stays at 32 MB.
ROWS_PER_STEP = 2048
#: Records and queries of one document in a block, and the parts into which a document's records fall.
RECORD_BLOCK, QUERY_BLOCK, PARTS = 1024, 256, 16


def topk(records: DataFrame, queries: DataFrame, candidates: dict[str, int] = CANDIDATES, within: bool = False) -> DataFrame:
    """(query_id, modality, vec_id, score, rank): the best records of each modality for every query.

    ``within`` lets a query search the records of its ``document_id`` only; a query without one, or
    of a document without records, has no hits.

    Scores are inner products in double precision; ties go to the smaller id.  A null or empty
    vector on either side gives no result; a query of another width than the records is an error.
    """
    if within:
        return _ranked(_scan_within(records, queries, candidates), candidates)
    total = queries.where(F.size("embedding") > 0).count()
    blocks = max(1, -(-total // QUERIES_PER_BLOCK))
    spark = records.sparkSession
    part = None
    for number in range(blocks):
        mine = queries.where((F.size("embedding") > 0) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)).select("query_id", "embedding").collect()
        shipped = spark.sparkContext.broadcast(([r.query_id for r in mine], [list(r.embedding) for r in mine]))
        found = _scan(records, shipped, candidates)
        part = found if part is None else part.unionByName(found)
    return _ranked(part, candidates)


def _ranked(part: DataFrame, candidates: dict[str, int]) -> DataFrame:
    order = Window.partitionBy("query_id", "modality").orderBy(F.col("score").desc(), "vec_id")
    most = F.create_map(*[F.lit(x) for pair in candidates.items() for x in pair])[F.col("modality")]
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _best(matrix, block, most: int) -> tuple:
    """(query, record, score) of everything that can be among the best ``most`` records of a query."""
    import numpy as np

    if block.shape[1] != matrix.shape[1]:
        raise ValueError(f"vectors of width {block.shape[1]} searched by queries of width {matrix.shape[1]}")
    # a fast product finds what can be among the best, with room for its rounding
    rough = matrix @ block.T
    if rough.shape[1] > most:
        bar = np.partition(rough, rough.shape[1] - most, axis=1)[:, rough.shape[1] - most]
        q, r = np.nonzero(rough >= bar[:, None] - 1e-9 * (1 + np.abs(bar[:, None])))
    else:
        q, r = (x.ravel() for x in np.indices(rough.shape))
    # those few are added up from the left, so that equal vectors have equal scores
    exact = np.zeros(len(q))
    for d in range(matrix.shape[1]):
        exact += matrix[q, d] * block[r, d]
    return q, r, exact


def _blocked(frame: DataFrame, key: str, names: list[str], size: int) -> DataFrame:
    """Rows of the same ``names`` put together in blocks of at most ``size``: (names, keys, vectors)."""
    rows = frame.where(F.size("embedding") > 0).select(*names, F.col(key).cast("bigint").alias("key"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, list[int]] = {}
            for i, group in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(names))))):
                held.setdefault(group, []).append(i)
            for group, at in held.items():
                for start in range(0, len(at), size):
                    part = batch.take(pa.array(at[start : start + size], pa.int64()))
                    columns = [pa.array([v], pa.string()) for v in group]
                    vectors = pa.array([part.column(len(names) + 1).to_pylist()], pa.list_(pa.list_(pa.float64())))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([part.column(len(names)).to_pylist()], pa.list_(pa.int64())), vectors], names=[*names, "keys", "vectors"])

    return rows.mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", keys array<bigint>, vectors array<array<double>>")


def _scan_within(records: DataFrame, queries: DataFrame, candidates: dict[str, int]) -> DataFrame:
    asked = queries.where(F.col("document_id").isNotNull())
    mine = records.where(F.col("modality").isin(*candidates)).join(asked.select("document_id").distinct(), "document_id", "left_semi")
    stored = _blocked(mine, "vec_id", ["document_id", "modality"], RECORD_BLOCK).withColumn("part", F.pmod(F.xxhash64("keys"), F.lit(PARTS)))
    wanted = _blocked(asked, "query_id", ["document_id"], QUERY_BLOCK).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    pairs = stored.join(wanted.select("document_id", "part", F.col("keys").alias("query_keys"), F.col("vectors").alias("query_vectors")), ["document_id", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for n in range(batch.num_rows):
                kind, keys, vectors, asked_keys, asked_vectors = (batch.column(k)[n].as_py() for k in range(5))
                q, r, exact = _best(np.array(asked_vectors, dtype=np.float64), np.array(vectors, dtype=np.float64), candidates[kind])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(asked_keys)[q]), pa.array([kind] * len(q), pa.string()), pa.array(np.array(keys)[r]), pa.array(exact)], names=["query_id", "modality", "vec_id", "score"])

    return pairs.select("modality", "keys", "vectors", "query_keys", "query_vectors").mapInArrow(run, "query_id bigint, modality string, vec_id bigint, score double")


def validate(records: DataFrame, queries: DataFrame, modality: str) -> None:
    """Raises where a search cannot be made: an unknown modality, a blank query, a document without such records."""
    if modality not in CANDIDATES:
        raise ValueError(f"{modality} is no modality; there are {', '.join(CANDIDATES)}")
    if not queries.where(F.coalesce(F.trim("query"), F.lit("")) == "").isEmpty():
        raise ValueError("a query is empty")
    held = records.where(F.col("modality") == modality).select("document_id").distinct()
    lacking = queries.select("document_id").where("document_id IS NOT NULL").join(held, "document_id", "left_anti").first()
    if lacking:
        raise ValueError(f"document {lacking.document_id} has no {modality} index")


def _scan(records: DataFrame, shipped, candidates: dict[str, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ids, vectors = shipped.value
        if not ids:
            return
        matrix = np.array(vectors, dtype=np.float64)
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        best: dict[str, tuple] = dict.fromkeys(candidates, empty)
        for batch in batches:
            kinds = np.array(batch.column(1).to_pylist(), dtype=object)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            rows = batch.column(2).to_pylist()
            sound = np.array([bool(r) for r in rows], dtype=bool)
            for kind, most in candidates.items():
                all_ = np.flatnonzero((kinds == kind) & sound)
                for at in (all_[k : k + ROWS_PER_STEP] for k in range(0, len(all_), ROWS_PER_STEP)):
                    q, r, exact = _best(matrix, np.array([rows[i] for i in at], dtype=np.float64), most)
                    q, names, exact = (np.concatenate(x) for x in zip(best[kind], (q, keys[at][r], exact)))
                    order = np.lexsort((names, -exact, q))
                    q, names, exact = q[order], names[order], exact[order]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    best[kind] = q[place < most], names[place < most], exact[place < most]
        queries = np.array(ids, dtype=np.int64)
        for kind, (q, names, exact) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array([kind] * len(q), pa.string()), pa.array(names.astype(np.int64)), pa.array(exact)], names=["query_id", "modality", "vec_id", "score"])

    return records.select(F.col("vec_id").cast("bigint"), "modality", "embedding").mapInArrow(run, "query_id bigint, modality string, vec_id bigint, score double")


def _of(values: dict, modality: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[modality]


def with_thresholds(hits: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Hits with threshold and ``passed``; compared before rounding, ranks are not closed up."""
    limit = _of(thresholds, F.col("modality"))
    return hits.withColumn("threshold", limit).withColumn("passed", F.col("score") >= limit)


def passing(hits: DataFrame, thresholds: dict[str, float] = THRESHOLDS, include_below: bool = False) -> DataFrame:
    marked = with_thresholds(hits, thresholds)
    kept = marked if include_below else marked.where("passed")
    return kept.withColumn("score", F.round("score", 6))


def retrieve(hits: DataFrame, queries: DataFrame, thresholds: dict[str, float] = THRESHOLDS, least_text: int = LEAST_TEXT, caps: dict[str, int] = CAPS) -> DataFrame:
    """(query_id, mode, modality, vec_id, rank, score, passed): what each query's answer may use.

    Enough text above its threshold: all of that text (``text_only``).  Else the text, tables and
    images above theirs, the latter two capped (``multimodal``).  Nothing above any threshold: everything, uncapped
    (``raw_fallback``).  A query without any record is ``multimodal`` with a row of nulls.
    """
    marked = with_thresholds(hits, thresholds)
    per = marked.groupBy("query_id").agg(F.count_if(F.col("passed") & (F.col("modality") == "text")).alias("texts"), F.count_if("passed").alias("any"), F.count("*").alias("raw"))
    enough = F.col("texts") >= least_text
    mode = F.when(enough, "text_only").when((F.col("any") == 0) & (F.col("raw") > 0), "raw_fallback").otherwise("multimodal")
    modes = queries.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce(mode, F.lit("multimodal")).alias("mode"))
    ranked = marked.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "modality").orderBy(~F.col("passed"), "rank")))
    cap = F.coalesce(_of(caps, F.col("modality")), F.lit(1 << 30))
    keep = (
        ((F.col("mode") == "text_only") & (F.col("modality") == "text") & F.col("passed"))
        | ((F.col("mode") == "multimodal") & F.col("passed") & (F.col("place") <= cap))
        | (F.col("mode") == "raw_fallback")
    )
    chosen = ranked.join(modes, "query_id").where(keep).select("query_id", "modality", "vec_id", "rank", F.round("score", 6).alias("score"), "passed")
    return modes.join(chosen, "query_id", "left")


def trace(retrieved: DataFrame) -> DataFrame:
    """(query_id, mode, fallback_triggered, threshold_fallback, texts, tables, images, total, below): counts of each retrieval."""
    return retrieved.groupBy("query_id", "mode").agg(
        F.count_if(F.col("modality") == "text").alias("texts"), F.count_if(F.col("modality") == "table").alias("tables"), F.count_if(F.col("modality") == "image").alias("images"),
        F.count("vec_id").alias("total"), F.count_if(F.col("passed") == F.lit(False)).alias("below"),
    ).withColumn("fallback_triggered", F.col("mode") != "text_only").withColumn("threshold_fallback", F.col("mode") == "raw_fallback")
