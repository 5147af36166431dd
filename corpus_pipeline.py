"""A training corpus from the table ``documents``, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; ``run``
writes it as Parquet into the shared folder and reads it again for the next. All
stages but the last keep the columns of ``documents``, and every stage keeps further
columns, whatever their names; of an empty table each stage makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, language, mixing, nearcopies, pii
from pagewright.llm._shared import materialise, named, scratch, table


def _packed(docs: DataFrame) -> DataFrame:
    """(__doc, text): a text goes through Python once, beside a struct of the other columns."""
    return docs.select(F.struct(*(named(c) for c in docs.columns if c != "text")).alias("__doc"), "text")


def _unpacked(found: DataFrame, like: DataFrame, held: str = "__doc") -> DataFrame:
    """The columns of ``like`` from a packed table."""
    return found.select(*(F.col("text") if c == "text" else F.col(held).getField(c).alias(c) for c in like.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is certain; those without a letter go, and the ambiguous.

    Null and empty texts have no letter and go. Repeated rows are judged alike, and all
    count in learning. Null languages teach nothing; without any language nothing is kept.
    """
    model = language.fit(docs, "text", "lang")
    found = language.predict(_packed(docs), model, "text", ("__doc",), with_text=True)
    return _unpacked(found.where((F.col("lang_pred") != language.UND) & ~F.col("ambiguous")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, 0.8), that of the smallest id.

    Null and empty texts are one group. Of rows with the smallest id, as of repeated rows, one
    stays; a null id comes last.
    """
    return nearcopies.deduplicate(docs, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no window of a benchmark item, exactly or as a proximity match.

    Null and empty texts hold none and stay, repeated rows stay or go together, and an
    empty benchmark leaves every document.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it; n_chars follows the text.

    Every row stays. Null and empty texts stay as they are, and so does the n_chars, null
    or not, of a text that isn't changed.
    """
    found = pii.sanitise(_packed(docs), "__doc", "text")
    if "n_chars" in docs.columns:
        found = found.withColumn("id", _counted(docs))
    return _unpacked(found, docs, "id")


def _counted(docs: DataFrame):
    """The other columns with n_chars as the new text has it, where the text has changed."""
    n = F.length("text").cast(docs.schema["n_chars"].dataType)
    return F.col("id").withField("n_chars", F.when(F.size("spans") > 0, n).otherwise(F.col("id.n_chars")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's target asks for.

    A null source is one of its own. Documents without words are copied by their source's
    rate like others, repeated rows and rows with a null id each as often as the first.
    """
    return mixing.mix(docs, "doc_id", "text", "source")


STAGES = [
    ("language id", language_id),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("pii", personal_data),
    ("source mixing", source_mixing),
]

#: Language identification and the trie join aren't expressed in SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` after all stages; what a stage wrote for itself is deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return docs
