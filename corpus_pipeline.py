"""The corpus pipeline: five operators over ``documents``, each stage written as Parquet and read again as the next one's input."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import packing, secret_scan, simhash, substring, toxicity
from textloom.llm.common import documents, shared_dir, text_digest
from textloom.llm.queries import tokenizer_path


#: Column names that no input has.
_CHANGE, _ID, _TEXT = "_textloom_change", "_textloom_id", "_textloom_text"


def _decided(docs: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to decisions (doc_id, text_sha256 and others) about rows: each row meets those of its own id, null too, and text alone."""
    decisions = decisions.dropDuplicates(["doc_id", "text_sha256"]).withColumnsRenamed({"doc_id": _ID, "text_sha256": _TEXT})
    return docs.join(decisions, docs["doc_id"].eqNullSafe(decisions[_ID]) & (text_digest(docs["text"]) == decisions[_TEXT]), how)


def _retext(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``docs`` with the texts of ``changed`` (doc_id, text_sha256, new_text, emptied). Rows without a new text stay as they are, emptied ones go."""
    changed = changed.select("doc_id", "text_sha256", F.struct("new_text", "emptied").alias(_CHANGE))
    out = _decided(docs, changed, "left").where(~F.coalesce(F.col(_CHANGE)["emptied"], F.lit(False)))
    new = F.col(_CHANGE)["new_text"]
    count = F.when(new.isNull(), F.col("n_chars")).otherwise(F.char_length(new).cast("long"))
    return out.select(*[F.coalesce(new, "text").alias("text") if c == "text" else count.alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic.

    Each row is judged by its own id and text: a null id is like any other, rows that repeat an id with other texts are judged apart,
    equal rows stay or go together. A null or empty text is judged as one without a match; an empty table stays empty. Without labels of both
    kinds a fixed lexicon decides. Other columns, whatever their names, are kept as they are.
    """
    scores = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keyed=True)
    toxic = scores.where("predicted = 1").select("doc_id", "text_sha256")
    return _decided(docs, toxic, "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of the smallest doc_id. Documents without an id stay.

    A group is what links of near fingerprints reach; its smallest doc_id is its own, so there are no ties. Null and empty texts link like
    any other (fingerprint zero). Equal rows stay or go together, an empty table stays empty, other columns are kept as they are.
    Texts under one doc_id are judged each by its own fingerprint: an unrelated one stays where a near copy of an earlier document goes.
    """
    gone = simhash.near_duplicates(docs, keyed=True).where("doc_id <> component_id").select("doc_id", "text_sha256")
    return _decided(docs, gone, "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that an earlier document has. A document of which nothing is left goes.

    Only a smaller doc_id is earlier, so rows of one id never cut each other, and a row without an id is neither cut nor cuts. Rows that repeat
    an id with other texts are cut by their own windows alone, equal rows alike. Null, empty and short texts stay as they are, as do
    other columns but n_chars, which follows a cut text. An empty table stays empty.
    """
    cut = substring.dedup_substrings(docs, with_text=True).where("n_removed > 0")
    return _retext(docs, cut.select("doc_id", "text_sha256", F.col("text").cast("string").alias("new_text"), (F.col("n_removed") == F.col("n_words")).alias("emptied")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret's value replaced by a mark.

    Every row is redacted by its own text, with or without an id and however often the id repeats. Overlapping values become one
    mark. Null and empty texts stay, as do other columns but n_chars, which follows a redacted text. An empty table stays empty.
    """
    found = secret_scan.scan(docs, with_text=True).where("redacted is not null")
    return _retext(docs, found.select("doc_id", "text_sha256", F.col("redacted").alias("new_text"), F.lit(False).alias("emptied")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids.

    Each row is packed, with a null id or a repeated one too; a null or empty text is its end token alone. Equal lengths are packed in the
    order of their rows. An empty table gives no pieces. Columns besides doc_id and text don't come back.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

#: Trained models, components and byte-level tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them a table in the shared folder."""
    docs = documents(spark, sf_dir)
    home = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            schema = docs.schema
            docs.write.parquet(f"{home}/{i}-{name}")
            docs = spark.read.schema(schema).parquet(f"{home}/{i}-{name}")
    return docs
