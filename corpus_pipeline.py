"""A training corpus in five stages: quality rules, near copies, repeated passages, source mixture, token ids.

Each stage works on what its predecessor kept, written as Parquet and read again. All but the last return the columns
of `documents`; the last returns each document's ids and the text they decode to.

Rows keep their ids. The mixture repeats a document that it takes twice, and the document on the border of a source's
target keeps only the words that are taken, so a later stage sees exactly the mixed words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm import jaccard, mixing, pieces, quality, suffixes
from meshlake.llm.common import BLANK, shared_path
from meshlake.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sized(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule of the table go."""
    return quality.passing(docs.select(*COLUMNS))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word shingles, the one with the smallest id stays, and
    of rows with one id one. Rows without an id stay."""
    found = jaccard.jaccard_join(docs, k=5, num=80, den=100)
    # rows of one id and text are copies too: one of them stays
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    rest = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)
    # rows without an id are no copies of one another by it
    return rest.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(rest.filter("doc_id IS NULL"))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of passages of 50 words or more that repeat, the first occurrence stays; documents left without words go."""
    return _sized(suffixes.cut_out(docs.select(*COLUMNS), suffixes.repeated_passages(docs, least=50)))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time that the curriculum takes a document, with the words that it takes, in training order."""
    taken = mixing.curriculum(mixing.mix(docs, keep=("text", "lang", "n_chars")))
    words = F.regexp_extract_all("text", F.lit(f"([{BLANK}]*[^{BLANK}]+)"), 1)
    first = F.array_join(F.slice(words, 1, F.greatest(F.col("words"), F.lit(1)).cast("int")), "")
    return _sized(taken.withColumn("text", F.when(F.col("words") < F.col("size"), first).otherwise(F.col("text"))))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids (little-endian unsigned 32-bit integers), their number and decoded text of every row."""
    out = pieces.transcode(docs.select("doc_id", "source", "text"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("suffix-array dedup", passage_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: SQL has no SentencePiece encoder; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
