"""The corpus pipeline: quality rules, three kinds of deduplication, packing.

Each stage is one operator over all rows that its predecessor kept. The result of a stage
must be written and read again before the next one is called, as ``run`` does: the next
call deletes the tables that the result was made from, so the disk holds one stage's work.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import key_filter, with_filter
from tideline.llm.exact_dedup import exact_groups
from tideline.llm.packing import pack
from tideline.llm.quality import quality
from tideline.llm.simhash import near_duplicates
from tideline.llm.suffix_dedup import remove_repeats
from tideline.scratch import delete_path, materialise, scratch_list, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[2:]


#: Tables that the last stage made on its way; its result needs them until it is written.
_MADE: list[str] = []


def _frugal(stage):
    """The stage; when it is called, the tables that the stage before it made are deleted."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _MADE:
            delete_path(spark, _MADE.pop())
        with scratch_list(_MADE):
            return stage(spark, docs, sf_dir)

    return run


def _document(frame: DataFrame, **own) -> DataFrame:
    """The columns of documents from a frame with ``_id``, ``_text`` and ``_<name>``."""
    names = {"doc_id": "_id"} | {c: f"_{c}" for c in COLUMNS[1:]}
    return frame.select(*[own.get(c, F.col(names[c])).alias(c) for c in COLUMNS])


@_frugal
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null texts are empty and go."""
    return _document(quality(docs, keep=REST, with_text=True).where("kept"))


@_frugal
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest identifier."""
    return _document(exact_groups(docs, keep=REST, with_text=True).where("kept"))


@_frugal
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest identifier.

    Documents link if the fingerprints of their shingles of four words differ in at most
    four bits. Rows that share the smallest identifier of a group all stay, as do groups
    without any identifier.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("second"), text)})
    groups = near_duplicates(keyed, words=4, radius=4, keep=("k1", "k2"))
    gone = groups.where("_id is not null and _id != component_id")
    gone = materialise(
        gone.select(F.col("_id").alias("doc_id"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2")).distinct(),
        "gone",
    )
    # Only rows that a filter of fixed size cannot rule out are joined, so few texts move.
    key = ["doc_id", "k1", "k2"]
    filtered = with_filter(keyed, materialise(key_filter(gone, *key), "filter"), *key)
    stay = filtered.where("not _maybe").select(*COLUMNS)
    return stay.union(filtered.where("_maybe").join(gone, key, "left_anti").select(*COLUMNS))


@_frugal
def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere too.

    A cut may fall inside a character; what is left of it becomes a replacement mark.
    Documents of which nothing is left stay, with an empty text.
    """
    cut = remove_repeats(docs, with_text="text", keep=REST)
    return _document(cut.withColumnRenamed("_kept", "_text"), n_chars=F.char_length("_text").cast("long"))


@_frugal
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens."""
    from tideline.llm.queries import tokenizer_path

    return pack(docs, tokenizer_path("byte_bpe_50k.json")).withColumnRenamed("_id", "doc_id")


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("passage dedup", passage_stage),
    ("packing", packing_stage),
]

#: Fingerprints and tokens are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over the written result of the one before.

    Nulls, empty and repeated rows, and empty tables are treated as by the operator of each
    stage; only the columns of ``documents`` are read, so further ones cannot clash.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        found, path = stage(spark, docs.select(*COLUMNS), sf_dir), scratch_path(spark, "stage")
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if before is not None:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs.select(*COLUMNS), sf_dir)
