"""From documents to an ordered training mix, stage by stage.

Every stage takes and returns the columns of documents, whatever else these are; the last adds its own. Documents with a null text pass
the first four (they have no words), rows that share a doc_id are one document and stay or go together, repeated rows count each, very
long texts are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.llm.common import shared_dir
from quarry.llm.decontam import contamination
from quarry.llm.minhash import near_duplicates
from quarry.llm.mixing import mix
from quarry.llm.substring import remove_repeats
from quarry.llm.toxicity import toxicity


def _packed(docs, *more):
    """doc_id and text, and all other columns (with `more` among them) in one struct, whose name none of an operator's results has."""
    others = [*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")), *more]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(0).alias("none")])).alias("row_of_documents"))


def _unpacked(packed, columns, **new):
    """The columns of documents again, in their order; new ones in place of the old."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), **new}
    return packed.select(*(own.get(c, F.col(f"row_of_documents.`{c}`")).alias(c) for c in columns))


def toxicity_stage(spark, docs, sf_dir):
    """Documents that the model calls toxic go; without labels of both kinds none is toxic, or all are that the only kind says."""
    return _unpacked(toxicity(_packed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=True).where("predicted = 0"), docs.columns)


def near_dedup_stage(spark, docs, sf_dir):
    """Of each group of near copies the document with the smallest doc_id stays; one with a null doc_id is nobody's copy."""
    gone = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def substring_stage(spark, docs, sf_dir):
    """Passages that occur in a document with a smaller doc_id are cut (a null doc_id counts as the greatest); a text that loses nothing stays as it is."""
    whole = "text_as_it_was" + "_" * sum(c.startswith("text_as_it_was") for c in docs.columns)  # a name no column has
    out = remove_repeats(_packed(docs, F.col("text").alias(whole)))
    new = {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"row_of_documents.`{whole}`"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("row_of_documents.n_chars"))
    return _unpacked(out, docs.columns, **new)


def decontamination_stage(spark, docs, sf_dir):
    """Contaminated documents go; with an empty benchmark none does."""
    return _unpacked(contamination(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True).where(~F.col("contaminated")), docs.columns)


def mixing_stage(spark, docs, sf_dir):
    """Every document with its size, the words the mix takes of it and its positions in training, in order of position."""
    return mix(docs, keep=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Toxicity is a fitted model, which SQL cannot express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply STAGES to documents; each result is written as Parquet in the shared folder and read again."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    to = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{to}/{name}")
        docs = spark.read.parquet(f"{to}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
