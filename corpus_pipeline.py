"""The corpus pipeline: toxic documents go, copies go, personal data is masked, sources are mixed, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeframe.llm import bpe, jaccard, mixing, pii, toxicity
from fringeframe.llm.common import shared_folder



def packed(docs: DataFrame) -> DataFrame:
    """A stage's rows as a struct beside the columns that operators read, so that their results can't clash with inputs."""
    return docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), *(c for c in ("doc_id", "text", "source") if c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones of the stage's input, scores 0.5 or more go.

    Rows without a text or key are scored like others; columns of any name keep their values.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(packed(docs), model).where("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, by smallest id, then by a hash of its text.

    The rule for pipeline stages holds: links are pairs whose sets of five-word shingles have a Jaccard similarity of
    0.8 or more. No radius of fingerprint bits finds them all (README), so MinHash bands propose beside the fingerprints
    within 4 bits, and whole sets confirm. Rows without a key stay if no row of their group has one;
    columns of any name keep their values.
    """
    return jaccard.survivors(packed(docs), width=5).select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Likely spans are replaced by their kind; n_chars, where there is one, follows the text. Null texts stay null."""
    found = pii.scan(packed(docs))
    kept = F.col("row").withField("text", F.col("pii_masked"))
    if "n_chars" in docs.columns:
        kept = kept.withField("n_chars", F.length("pii_masked").cast(docs.schema["n_chars"].dataType))
    return found.select(kept.alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; columns of any name keep their values."""
    return mixing.emit(mixing.mix(packed(docs))).select("row.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text in its place, with the hashes of the ids and of what they decode to.

    The results (n_tokens, ids_sha256, decoded_sha256, token_ids) replace inputs of their name.
    """
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.drop("text")


STAGES = [("toxicity", drop_toxic), ("simhash", drop_copies), ("pii", mask_personal_data), ("mixing", mix_sources), ("bpe", encode_texts)]

#: A classifier, regular-expression scans and an encoder have no SQL; tests hold the rows against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read as the next one's input."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
