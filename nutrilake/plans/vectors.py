"""Vector queries on ``embeddings``: exact and inverted-file nearest
neighbour, top-k retrieval, label imputation and its completion report.

Rows with ``vec_id % 5 = 0`` have their label hidden (they are the rows to
complete, FIXTURES B.3); all other rows are the reference.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nutrilake.operators import embed, knn
from nutrilake.plans import misc
from nutrilake.session import materialize, shared_path, spread
from nutrilake.sources import tables

# Threshold for the test vectors (the reference's 0.55 accepts nothing on
# near-random vectors; it is kept as the library default).
THRESHOLD = 0.35
DEFAULT_THRESHOLD = 0.55
NPROBE = 16
TOP_K = 5
# Fixed value: what a search without a document says.
NOTHING_FOUND = "Aucune information trouvée dans le dataset."


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = tables.read_table(spark, sf_dir, "embeddings")
    hidden = F.col("vec_id") % 5 == 0
    return e.where(hidden), e.where(~hidden)


def _with_label(res: DataFrame, refs: DataFrame) -> DataFrame:
    return res.join(refs.select(F.col("vec_id").alias("rid"), F.col("label").alias("neighbour_label")), "rid")


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6e: the nearest of all references. One cell is probed, then all those that its score does not rule out."""
    q, r = _split(spark, sf_dir)
    res = knn.ivf_knn(q, "vec_id", "embedding", r, "vec_id", "embedding", k=1, nprobe=1)
    return _with_label(res, r).select(F.col("qid").alias("vec_id"), F.col("rid").alias("neighbour_id"),
                                      "score", "neighbour_label")


def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = _split(spark, sf_dir)
    res = knn.ivf_knn(q, "vec_id", "embedding", r, "vec_id", "embedding", k=1, nprobe=NPROBE)
    return _with_label(res, r).select(F.col("qid").alias("vec_id"), F.col("rid").alias("neighbour_id"),
                                      "score", "neighbour_label")


def knn_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 + J6: the index written to the shared folder, read again and searched."""
    q, r = _split(spark, sf_dir)
    path = knn.save_vector_index(knn.build_index(r, "vec_id", "embedding"), shared_path(spark, "indexes", uuid.uuid4().hex))
    res = knn.ivf_search(q, "vec_id", "embedding", knn.load_vector_index(spark, path), k=TOP_K, nprobe=4)
    return res.select(F.col("qid").alias("vec_id"), "rank", F.col("rid").alias("neighbour_id"), "score")


def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = _split(spark, sf_dir)
    res = knn.ivf_knn(q, "vec_id", "embedding", r, "vec_id", "embedding", k=TOP_K, nprobe=NPROBE)
    return res.select(F.col("qid").alias("vec_id"), "rank", F.col("rid").alias("neighbour_id"), "score")


def embed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6/U4: every product name and category through the model UDF, 64 tokens at most. Equal texts are embedded once."""
    import public_tokenizers  # only this query needs it
    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    udf = embed.model_embedder(lambda: embed.TokenModel(vocabulary, pattern))
    p = tables.products(spark, sf_dir).select("row_id", F.concat_ws(" ", "product_name", "categories_en").alias("embedded"))
    texts = p.select("embedded").distinct().withColumn("vector", udf("embedded"))
    return p.join(texts, "embedded").select("row_id", "embedded", "vector")


def index_folder(spark: SparkSession, sf_dir: str, name: str, tables_read: tuple[str, ...]) -> str:
    """A folder of the shared storage that belongs to the present files of the tables: new files, another index."""
    sc, seen = spark.sparkContext, []
    for table in tables_read:
        where = sc._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{table}.parquet")
        fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
        whole = fs.getFileStatus(where)
        seen.append(f"{whole.getPath()} {whole.getModificationTime()} {fs.getContentSummary(where).getLength()}")
    return shared_path(spark, "indexes", f"{name}-{hashlib.md5(' '.join(seen).encode()).hexdigest()}")


def document_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: the context of each question from its ``TOP_K`` closest product documents by embedding.

    The index over the documents is read if it is there, else built and saved. Equal questions are asked once."""
    docs = misc.product_documents(tables.products(spark, sf_dir)).select("row_id", "page_content")

    def embedded() -> DataFrame:
        return embed.add_hashing_embedding(spread(docs, "row_id"), F.col("page_content"), "v").select("row_id", "v")
    index = knn.load_or_build(spark, index_folder(spark, sf_dir, "product-documents", ("part", "nation")), embedded, "row_id", "v")
    q = tables.questions(spark, sf_dir).select("q_id", F.concat_ws(" ", "question", "indice_produit").alias("asked"))
    texts = materialize(q.groupBy("asked").agg(F.min("q_id").alias("tid")))
    queries = embed.add_hashing_embedding(spread(texts, "tid"), F.col("asked"), "v").select("tid", "v")
    found = knn.ivf_search(queries, "tid", "v", index, k=TOP_K, nprobe=NPROBE)
    # Texts grow out of short columns: sides that Spark takes for small are not.
    context = found.join(docs.hint("merge"), F.col("rid") == F.col("row_id")).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "rid", "page_content"))).alias("found"))
    context = texts.join(context.hint("merge"), F.col("tid") == F.col("qid"), "left").select(
        F.col("asked").alias("_asked"), F.array_join(F.transform("found", lambda d: d["rid"]), ",").alias("documents"),
        F.array_join(F.transform("found", lambda d: d["page_content"]), "\n\n").alias("contexte"))
    return q.join(context.hint("merge"), F.col("asked") == F.col("_asked")).select("q_id", F.coalesce("documents", F.lit("")).alias("documents"),
                                                                     F.coalesce("contexte", F.lit(NOTHING_FOUND)).alias("contexte"))


def impute(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """Q2/Q3 on the vectors: a hidden label is filled with the nearest
    reference's label when the cosine reaches ``threshold``, else ''."""
    e = tables.read_table(spark, sf_dir, "embeddings")
    q, r = _split(spark, sf_dir)
    best = knn.ivf_knn(q, "vec_id", "embedding", r, "vec_id", "embedding", k=1, nprobe=NPROBE)
    best = _with_label(best, r).select(F.col("qid").alias("vec_id"), "score", "neighbour_label")
    todo = F.col("vec_id") % 5 == 0
    accepted = todo & F.col("score").isNotNull() & (F.col("score") >= threshold)
    return (e.select("vec_id", "label").join(best, "vec_id", "left")
            .select("vec_id",
                    F.when(todo, F.when(accepted, F.coalesce(F.col("neighbour_label").cast("string"), F.lit("")))
                           .otherwise(F.lit(""))).otherwise(F.col("label").cast("string")).alias("label_completed"),
                    todo.alias("to_complete"), accepted.alias("completed"),
                    F.when(todo, F.col("score")).alias("score")))


def impute_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute(spark, sf_dir)


def completion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to complete, rows completed, percentage."""
    i = impute(spark, sf_dir)
    agg = i.agg(F.count_if("to_complete").alias("to_complete"), F.count_if("completed").alias("completed"))
    return agg.select("to_complete", "completed",
                      F.try_divide(F.col("completed") * 100.0, F.col("to_complete")).alias("pct_completed"))
