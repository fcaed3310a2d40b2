"""The corpus pipeline: language ID, near-duplicate removal, secret scan, source mix, token ids.

STAGES are applied in order to the documents table; each stage's rows are written as Parquet and read again as the next
one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm import bpe, jaccard, langid, mixing, secrets
from seriesloom.llm.common import piece_pattern, stored, table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in none of the learned languages, or has no letter, go; lang becomes what was found.

    Null and empty texts have no letter and go; of a table without labelled rows nothing is learned and all go. Rows with
    a null doc_id or lang are judged like others but not learned from; repeated rows fare alike; an empty table gives none.
    """
    found = langid.identify(docs, langid.fit(docs)).where(~F.col("rejected"))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more one row stays: of the least doc_id, then text (by its hash),
    then other columns.

    Rows without a doc_id or without words link with nothing and all stay, repeated ones as well; two rows of one doc_id
    whose texts are not linked both stay, while repeated rows are a group. An empty table gives none.
    """
    rows = docs.withColumn("text_key", F.xxhash64("text"))
    kept = jaccard.groups(docs).where("`group` is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select("k.doc_id", "k.text_key")
    first = Window.partitionBy("doc_id", "text_key").orderBy(*[c for c in COLUMNS if c not in ("doc_id", "text")])
    one = rows.join(kept, ["doc_id", "text_key"]).withColumn("place", F.row_number().over(first)).where("place = 1")
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(mixing.WORD)
    return one.select(*COLUMNS).union(docs.where(alone).select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret is replaced by its kind; no document goes.

    Null texts stay null; repeated rows and rows without a doc_id stay and are treated like others; an empty table gives none.
    """
    found = secrets.find_secrets(docs)
    text = secrets.redacted(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes most of it, whole, in ascending order of training position.

    Texts without words are never taken; rows without a doc_id and repeated rows are mixed like others; a null source is
    a source; an empty table gives none.
    """
    taken = mixing.mix(docs, ordered=False).withColumn("times", F.round(F.try_divide("taken", "size")).cast("int"))
    copies = taken.withColumn("position", F.explode(F.slice("positions", 1, F.coalesce("times", F.lit(0)))))
    return copies.repartitionByRange(F.col("position")).sortWithinPartitions("position").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, whatever its doc_id and however often it comes; exact says that decoding gives the text back.

    Null and empty texts have no ids; an empty table gives none.
    """
    ids = bpe.encode(docs, vocabulary("byte_bpe_50k.tiktoken"), piece_pattern())
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return ids.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("exact"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: A fitted language model and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs
