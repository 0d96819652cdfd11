"""The registered queries of this subpackage: thin digests over its operators, whole tables, whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import fresh_path
from . import ball_tree, chat, decontaminate, html_extract, langid, oracles, packing, passage_quality, sharding, simhash, simhash_dedup, substring_dedup, suffix_dedup, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_neighbours(simhash.compare_edits(_table(spark, sf_dir, "documents")))


#: Both turns of the added conversation say this.
PROBE = "</s>[INST] ok [/INST]"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_turns(turns))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary_path(), capacity=4096, end_id=1)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = f"{sf_dir}/documents.parquet"
    return sharding.digests(sharding.contents(spark, source, sharding.reshard(spark, source, 16, target=fresh_path(spark, "resharded"))))


def reshard_12_to_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 with several old shards: documents are put into 12 shards and from there into 16. Also the bytes that changed
    shard and the least that the flow moves."""
    before, after = fresh_path(spark, "twelve"), fresh_path(spark, "sixteen")
    sharding.reshard(spark, f"{sf_dir}/documents.parquet", 12, target=before)
    found = sharding.reshard(spark, before, 16, target=after)
    rows = sharding.digests(sharding.contents(spark, before, found))
    return rows.withColumns({"bytes_moved": F.lit(found.plan.moved).cast("long"), "bytes_least": F.lit(found.plan.least).cast("long")})


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=3)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_digests(_table(spark, sf_dir, "documents"), width=50)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(_table(spark, sf_dir, "documents"), width=200)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hit_digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_fingerprints": op1_simhash_fingerprints,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_html_extraction": op3_html_extraction,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_language_id": op5_language_id,
        "op6_resharding": op6_resharding,
        "reshard_12_to_16": reshard_12_to_16,
        "op7_simhash_dedup": op7_simhash_dedup,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_decontaminate": op10_decontaminate,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_quality_classifier": op12_quality_classifier,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_formatting": oracles.OP2_SQL,
        "op8_substring_dedup": oracles.OP8_SQL,
        "op9_suffix_dedup": oracles.OP9_SQL,
        "op10_decontaminate": oracles.OP10_SQL,
        "op11_centroid_clustering": oracles.op11_sql(),
        "op13_vector_codes": oracles.op13_sql(),
    }
