"""The thin queries over this subpackage's operators: fixed result columns, production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.chat_quotes import thread_conversations
from larkspur.llm.common import Workspace, table
from larkspur.llm.decontaminate import find_leaks
from larkspur.llm.language_id import identify
from larkspur.llm.line_dedup import dedup_lines
from larkspur.llm.media_columns import figure_html, interleave, media_features, media_store
from larkspur.llm.minhash_dedup import near_duplicates
from larkspur.llm.quality_pu import score_quality, train
from larkspur.llm.secret_scan import find_secrets
from larkspur.llm.sentencepiece_fst import encode_documents
from larkspur.llm.suffix_dedup import remove_repeats


def piece_model() -> str:
    """Path of the public SentencePiece model that the queries use."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids; round_trip tells whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents")
    out = encode_documents(docs, piece_model())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = thread_conversations(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "parent_turn", "depth", "branch_turn", "n_quoted", "n_linked", F.sha2(F.encode("chat", "UTF-8"), 256).alias("chat_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item, with the item; others have no row."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as the payload of a one-figure page that refers to it by digest."""
    workspace = Workspace(spark, "media")
    store = media_store(table(spark, sf_dir, "documents"), workspace, id_col="doc_id", raw_col="text")
    pages = store.select("doc_id", "n_bytes", figure_html(F.col("digest"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias("html"))
    features = workspace.store(media_features(store))
    items = interleave(pages.withColumn("_key", F.struct("doc_id", "n_bytes")), features, id_col="_key", html_col="html").filter("kind = 'media'")
    return items.select("_key.doc_id", "_key.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, text=F.col("text"), declared=F.col("lang"), host=F.col("source"))
    return out.select("doc_id", F.col("_language").alias("language"), F.round("_confidence", 6).alias("confidence"), F.col("_accepted").alias("accepted"))


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(docs, labels.filter(~held_out), id_col="doc_id", text_col="text", label_col="quality")
    out = score_quality(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(joined("base"), "UTF-8"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, similarity=(80, 100))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_sentencepiece, op3_chat_quotes, op4_decontaminate, op5_line_dedup, op6_media_columns,
        op7_language_id, op8_quality_pu, op9_secret_scan, op10_minhash_dedup,
    )
}

#: Line dedup is plain SQL: keys by line, documents and largest document by key, lines joined again.
LINE_DEDUP_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split),
common AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT d.doc_id, d.i, d.line, c.top IS NULL OR c.top = d.doc_id AS kept FROM keyed d LEFT JOIN common c ON d.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT kept) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kept), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

ORACLES: dict[str, str] = {"op5_line_dedup": LINE_DEDUP_SQL}
