"""The registered queries of the corpus operators, one per operator.

Each applies its operator with production parameters to its whole table and
derives the digest columns of the result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, bpe, chat, decontam, exact_dedup, hardneg, htmltext, importance, langid, sharding, simhash, toxicity, urlfilter
from .common import table

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "kept")


def op2_url_filter(spark, sf_dir):
    j = urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return j.withColumn("host_words", F.array_join("host_words", " "))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    p = langid.predict(docs, langid.train(docs, ~held))
    return p.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op6_bpe(spark, sf_dir):
    return bpe.tokenize(table(spark, sf_dir, "documents"), vocabulary())


def op7_html_text(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_decontamination(spark, sf_dir):
    m = decontam.document_marks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return m.select(
        "doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
    return chat.read_back(chat.format_examples(turns.unionByName(probe)))


def op11_importance_resampling(spark, sf_dir):
    d = importance.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_features", "weight", "score", "rank")


def op12_hard_negatives(spark, sf_dir):
    vecs, label = table(spark, sf_dir, "embeddings"), F.col("label")
    noisy = F.when(F.col("vec_id") % 7 == 0, (label.cast("bigint") + 1) % 10).otherwise(label)
    m = hardneg.mine(vecs, F.col("id") % 100 == 0, label=noisy)
    return m.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_nearest_neighbours(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES = {f.__name__: f for f in (
    op1_simhash_dedup, op2_url_filter, op3_exact_dedup, op4_sharding, op5_language_id, op6_bpe, op7_html_text,
    op8_decontamination, op9_toxicity, op10_chat_format, op11_importance_resampling, op12_hard_negatives,
    op13_nearest_neighbours)}
