"""Documents to packed training sequences: language ID, line dedup, near-dedup, personal data, packing.

Each stage takes all that the one before kept, as tables of the columns of documents (and any others, which stay as they
are whatever their names); the last gives the pieces of sequences. Texts of any length are read whole. An empty
table stays empty in each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import disclosure, language, lines, packing, simhash
from tidemark.storage import discard, materialize, scratch

#: Least score of a language that is kept.
LEAST_SCORE = 0.5


def _packed(docs: DataFrame, *beside: str) -> DataFrame:
    """Each row as one struct, so that no column of a stage can clash with one of the documents."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), *beside)


def _unpacked(rows: DataFrame, columns: list[str], **new) -> DataFrame:
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a recognisable language; a null ``lang`` becomes the predicted one.

    Null and empty texts, and those without a letter, have no language and go, as do all if no row has a ``lang`` to learn
    from. Rows without a doc_id take part in the learning. Repeated rows are judged alike, each for itself; a score
    of just ``LEAST_SCORE`` stays."""
    model = language.fit(docs.filter(~F.coalesce(language.held_out(F.col("doc_id")), F.lit(False))))
    found = language.predict(_packed(docs, "text"), model)
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _unpacked(kept, docs.columns, lang=F.coalesce("doc.lang", "lang_pred"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines of each source.

    A null text stays null, a text of boilerplate only becomes empty; rows all stay, repeated ones too, and pages with equal
    texts count once. A null source is a source like any other; a line at just the ratio stays."""
    found = lines.drop_boilerplate(_packed(docs), "doc.source", "doc.text")
    return _unpacked(found, docs.columns, text=F.col("kept"), n_chars=F.length("kept").cast("bigint"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that of the smallest doc_id (null is the largest).

    Null and empty texts are one group, repeated rows another each. Rows that share a doc_id, or have none, are told apart
    by a key of their own; ties are broken by hashes of the text and the row."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it.

    Rows all stay: null and empty texts as they are, repeated rows with equal texts, those without a doc_id too."""
    return disclosure.sanitise(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; a row for each piece of a document.

    Null and empty texts have their end id only; repeated rows are packed as often as they occur, those without a doc_id
    first."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", sequences),
]

#: Naive Bayes, XXH64 and tokenizers have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of sequences of ``documents``. A stage's documents and tables are deleted once the next stage's are written, so the
    result is the only table that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as tables:
        for name, stage in STAGES:
            with scratch(spark) as made:
                after = made.keep(materialize(stage(spark, docs, sf_dir), name))
            discard(docs)
            docs = after
        return tables.keep(docs)
