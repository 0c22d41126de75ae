"""Statistical key words of documents."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions.text import words
from scriptorium.session import parts_of

SPLITS = 2  # a word of very many documents is that many tasks' work


def word_counts(docs):
    """``(doc_id, word, tf)``. Texts are placed by document once, which costs less than
    exchanging their words; counting within rows by array functions took four times as long.
    """
    placed = docs.repartition(parts_of(docs), "doc_id")
    exploded = placed.select("doc_id", F.explode(words(F.col("text"))).alias("word"))
    return exploded.groupBy("doc_id", "word").agg(F.count("*").alias("tf"))


def keyword_topk(docs, k=3):
    """The ``k`` words with the highest TF-IDF of each document, ties by word.

    ``docs`` has one row per document. Every exchange of words has parts of bounded size, so that no
    task's sort grows with the table.
    """
    parts = parts_of(docs)
    split = F.pmod(F.xxhash64("doc_id"), F.lit(SPLITS)).cast("int").alias("split")
    tf = word_counts(docs).select("*", split).repartition(parts, "word", "split")
    df = (
        docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("df"))
    )
    splits = F.explode(F.array(*(F.lit(i) for i in range(SPLITS)))).alias("split")
    df = df.select("*", splits).repartition(parts, "word", "split")
    n_docs = docs.select(F.count("*").alias("n")).scalar()
    scored = tf.join(df, ["word", "split"]).withColumn(
        "score", F.round(F.col("tf") * F.log(n_docs / F.col("df")), 6)
    ).repartition(parts, "doc_id")
    best_first = Window.partitionBy("doc_id").orderBy(F.desc("score"), "word")
    ranked = scored.withColumn("rank", F.row_number().over(best_first))
    return ranked.where(F.col("rank") <= k).select("doc_id", "rank", "word", "score")
