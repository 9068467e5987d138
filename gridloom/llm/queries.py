"""The registered queries of this subpackage: thin views of the operators, over whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chat_format, decontaminate, hmm_lm, mixing, omh_dedup, phrases, quality_ledger, sharding, token_counts, toxicity, url_reputation, vector_codes, warc
from gridloom.llm._shared import table
from gridloom.llm.oracles import oracle_sql  # noqa: F401  part of the registry


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_ledger.ledger(table(spark, sf_dir, "documents"))
    base = quality_ledger.passes("base")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), (base & quality_ledger.passes("v1")).alias("kept"), "failed_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger.ablations(quality_ledger.ledger(table(spark, sf_dir, "documents")))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select(warc.page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id(F.col("refers_to")).alias("refers_to"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # labels.quality marks good (1) and bad (0) pages by number; it is the only outcome the tables have.
    outcomes = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("bad"))
    judged = url_reputation.judge(table(spark, sf_dir, "pages"), outcomes)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    return chat_format.digest(chat_format.examples(rows.unionByName(more)))


def op10_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_counts, op2_quality_ledger, op3_warc_salvage, op4_benchmark_decontamination, op5_url_reputation, op6_source_mixing, op7_order_minhash, op8_toxicity_nnpu, op9_chat_format, op10_balanced_sharding, op11_phrase_collocations, op12_vector_codes, op13_hmm_scores, quality_ablations]
    return {f.__name__: f for f in own}
