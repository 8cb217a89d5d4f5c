"""The queries opN_<name> of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import chat_tools, conversation_trie, embedding_dedup, interpolation, language_id, lloyd, minhash, packing, sentencepieces, sharding, topk, toxicity, url_filter


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by nearest centroid."""
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op2_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards, equal texts together, row counts at most one apart."""
    return sharding.assign(table(spark, sf_dir, "documents"), shards=40)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of vectors at a cosine of 0.9 or more, and their components."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as tool calls and results: linked, ordered, validated, serialised."""
    return chat_tools.formatted(table(spark, sf_dir, "conversations"))


def op5_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows with the highest inner products for every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_sentencepiece_suffix_array(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """The tokens of every document and the text that they decode to, as counts and digests.

    The model file is read on the driver; its path is the parameter, or else the session's boardlake.sentencepiece.model.
    """
    model = model or spark.conf.get("boardlake.sentencepiece.model", "/opt/tokenizers/piece_bpe_32k.model")
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), sentencepieces.model_pieces(model))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents at a Jaccard similarity of 0.85 or more on 5-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in token-budget batches of optimal length buckets."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and a Bloom filter cascade over every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document under a model of deleted interpolation, and under single tokens."""
    return interpolation.score(table(spark, sf_dir, "documents"))


def op12_dimension_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors after ten rounds in integers."""
    return lloyd.clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10)


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations, with totals of its subtree."""
    return conversation_trie.prefixes(conversation_trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_balanced_sharding": op2_balanced_sharding,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_tool_call_linking": op4_tool_call_linking,
    "op5_bit_sliced_top_k": op5_bit_sliced_top_k,
    "op6_sentencepiece_suffix_array": op6_sentencepiece_suffix_array,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_length_bucket_packing": op8_length_bucket_packing,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_dimension_sharded_lloyd": op12_dimension_sharded_lloyd,
    "op13_conversation_prefix_trie": op13_conversation_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op4_tool_call_linking": chat_tools.ORACLE,
    "op8_length_bucket_packing": packing.oracle(),
    "op9_url_filter": url_filter.ORACLE,
    "op12_dimension_sharded_lloyd": lloyd.oracle(),
    "op13_conversation_prefix_trie": conversation_trie.ORACLE,
}
