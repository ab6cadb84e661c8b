"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages are joined by written tables.  All but the last
return the columns of documents, and any others that docs has.

Odd tables: an empty one passes all stages.  Null and empty texts hold no language, so the first stage drops them; given
one, the others keep it.  Rows that repeat an id are judged by their own texts, but share one place among near copies, so
all of them stay or go there.  Rows with a null id stay there.  Ties are broken by the id.  Texts of any length are
processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Workspace, table
from larkspur.llm.decontaminate import drop_leaks
from larkspur.llm.language_id import identify
from larkspur.llm.line_dedup import dedup_lines
from larkspur.llm.minhash_dedup import near_duplicates
from larkspur.llm.queries import piece_model
from larkspur.llm.sentencepiece_fst import encode_documents


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the evidence settles; lang becomes that language."""
    found = identify(docs, text=F.col("text"), declared=F.col("lang"), host=F.col("source"))
    return found.filter("_accepted").select(*(F.col("_language").alias("lang") if c == "lang" else F.col(c) for c in docs.columns))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go, except from the largest document that holds them; n_chars follows."""
    cleaned = dedup_lines(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text", "n_chars")])
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return cleaned.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, the smallest doc_id."""
    gone = near_duplicates(docs, shingle=5, similarity=(80, 100)).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the ids decoded again."""
    out = encode_documents(docs, piece_model())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_common_lines),
    ("minhash_dedup", drop_near_copies),
    ("decontaminate", drop_leaked),
    ("sentencepiece", tokenize),
]

#: Language models, similarity components, tilings and shortest paths are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = workspace.store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
