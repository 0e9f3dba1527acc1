"""The operators' queries, opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from talkmill.llm import sql
from talkmill.llm.decontam import contamination
from talkmill.llm.lm import score_texts
from talkmill.llm.near_dup import near_dup
from talkmill.llm.pu_quality import score_quality
from talkmill.llm.resample import resample
from talkmill.llm.shared import prepare, read_table
from talkmill.llm.sharding import rendezvous_shards
from talkmill.llm.spm_fst import encode
from talkmill.llm.substring_dedup import remove_repeats
from talkmill.llm.token_counts import count_tokens
from talkmill.llm.token_files import read_digests, write_token_files
from talkmill.llm.topk import top_k
from talkmill.llm.url_filter import filter_urls
from talkmill.llm.vector_codes import vector_codes

SHARDS = [1.0] * 40


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed ``public_tokenizers`` package."""
    return str(Path(find_spec("public_tokenizers").origin).with_name(name))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dup(read_table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous_shards(read_table(spark, sf_dir, "documents"), SHARDS, 1.0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return encode(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), digest=True)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder, manifest = write_token_files(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return read_digests(folder, manifest)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return top_k(read_table(spark, sf_dir, "embeddings"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return score_texts(read_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return remove_repeats(read_table(spark, sf_dir, "documents"), window=13)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return vector_codes(read_table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_minhash_near_dedup,
    op2_url_filter,
    op3_rendezvous_sharding,
    op4_token_counts,
    op5_sentencepiece,
    op6_decontamination,
    op7_token_files,
    op8_exact_top_k,
    op9_lm_scoring,
    op10_quality_classifier,
    op11_substring_dedup,
    op12_importance_resampling,
    op13_vector_codes,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": sql.NEAR_DUP,
    "op2_url_filter": sql.URL_FILTER,
    "op3_rendezvous_sharding": sql.SHARDING,
    "op6_decontamination": sql.DECONTAM,
    "op8_exact_top_k": sql.TOP_K,
    "op11_substring_dedup": sql.SUBSTRING_DEDUP,
    "op12_importance_resampling": sql.RESAMPLE,
    "op13_vector_codes": sql.VECTOR_CODES,
}
