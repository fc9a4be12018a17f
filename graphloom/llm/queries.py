"""The registered queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import oracles
from .conversation_repair import conversation_digests, damaged, repair_conversations
from .decontaminate import decontaminate, digest
from .language_id import fit, identify, training_rows
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .media import stored_text_media
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .piece_codec import piece_codec
from .resampling import resample
from .token_counts import token_counts
from .token_output import token_output
from .url_filter import judge_urls


def vocabulary_file(name: str) -> str:
    """A public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, 80 of 100, 64 bands of 8 minima."""
    return near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80, bands=64, rows=8)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten item words."""
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest(F.col("item_ids")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates in three documents or more (of 50 tokens or more: in two); what is kept of each text by its length and digest."""
    out = dedup_lines(_table(spark, sf_dir, "documents"), min_docs=3, long_docs=2, long_tokens=50)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word_bpe_49k ids with end id 2."""
    return token_output(_table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"), end_id=2)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 3, 1, 2 in turn, 150 % of all words, at most twice each source."""
    mixed = mix_sources(_table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as 8-bit samples in NPY tiles of 24 x 24."""
    return stored_text_media(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """byte_bpe_50k pieces, limit 512."""
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), limit=512)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from four folds of five; predicts every document."""
    docs = _table(spark, sf_dir, "documents")
    return identify(docs, fit(training_rows(docs)))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known licences and notices of ``license_texts``."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


#: Verdicts and rules of the query, in no order of precedence.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL_RULES first, the classifier for the rest."""
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """piece_bpe_32k ids with begin and end, and what they decode to."""
    coded = piece_codec(_table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_differ")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of a hundred documents of 20 words, towards the benchmark."""
    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, repaired."""
    conversations = _table(spark, sf_dir, "conversations")
    heads = conversation_digests(repair_conversations(damaged(conversations), conversations))
    return heads.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_dedup, op2_decontaminate, op3_line_dedup, op4_token_output, op5_mixing, op7_media, op8_token_counts, op6_language_id, op9_license_scan, op10_url_filter, op11_piece_codec, op12_resampling, op13_conversation_repair)}
ORACLES: dict[str, str] = oracles.ORACLES
