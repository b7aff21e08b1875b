"""Corpus preparation as a chain of stages, each written as Parquet and read again by the next.

Defined results, for every stage: an empty table gives an empty one; rows that are repeated
are each judged, and kept or dropped, alike; other columns of documents than COLUMNS are left
out. A null or empty text has the score of a text without votes, is nobody's near duplicate,
holds no benchmark item and no personal data (null stays null), and has no ids. A row with a
null doc_id goes through all stages but is never a near duplicate. Without labels the
toxicity stage uses the voters' priors; an empty benchmark drops nothing. Of near duplicates
the least doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen.llm import decontamination, near_dedup, pii, sentencepiece_codec, toxicity
from docscreen.llm.common import materialize, sized, table
from docscreen.llm.queries import model_path, pii_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least Jaccard index, in percent, of shingles that makes two documents near duplicates; op7's contract of 85 binds that query alone.
NEAR_PERCENT = 80
#: Documents for a task that writes them.
TASK_ROWS = 20_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, COLUMNS, score_col="toxicity_score")
    return scored.where(F.col("toxicity_score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    gone = near_dedup.near_duplicates(docs, percent=NEAR_PERCENT).where("not kept").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)
    return sized(kept, docs.count() / TASK_ROWS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark"), tuple(c for c in COLUMNS if c != "text"))
    return found.where(F.size("matches") == 0).select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms for personal data."""
    hidden = pii.pseudonymize(docs, pii_key(spark), keep=tuple(c for c in COLUMNS if c not in ("text", "n_chars")))
    return hidden.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Subword ids of each document and the text that they decode to."""
    return sentencepiece_codec.encode_decode(docs, model_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", hide_personal_data),
    ("sentencepiece", encode),
]

#: SQL can't express a learned classifier, a signature join or a subword model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
