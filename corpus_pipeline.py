"""A corpus pipeline of training-data operators: each stage works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import decontaminate, jaccard, lang_id, line_dedup, packing
from strataq.llm.common import cut, table


def folded(docs: DataFrame, *own: str) -> DataFrame:
    """docs with its other columns in one struct, whose name and theirs an operator's own columns can't clash with."""
    rest = [c for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("_")).alias("_rest"))


def unfolded(found: DataFrame, names: list[str], **own) -> DataFrame:
    """The columns `names` again: those in `own` as given there, the others from the struct."""
    return found.select(*((own[c] if c in own else F.col(f"_rest.`{c}`")).alias(c) for c in names))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: those whose text is null or has no letter go, and lang is the predicted one.

    Null ids, languages and sources stay as rows; repeated rows stay; long texts are read whole; ties of languages go to
    the one that sorts first; an empty table, or one without any labelled text, gives an empty result; extra columns are
    carried along whatever their names.
    """
    found = lang_id.identify_language(folded(docs, "doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model"), keep=("text", "_rest"))
    return unfolded(found.where(F.col("lang_pred") != "und"), docs.columns, doc_id=F.col("doc_id"), text=F.col("text"), lang=F.col("lang_pred"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many different pages of their source hold; copies are left to the next stage.

    No row goes: a text whose lines all go is empty, a null text stays null (n_chars too), a null source is a source of
    its own. Repeated rows stay and count as one page; long texts are read whole; a line's share must exceed the ratio, so
    a tie stays; an empty table gives an empty result; extra columns are carried along whatever their names.
    """
    found = line_dedup.dedup_lines(folded(docs, "doc_id", "text", "source"), copies_once=True)
    return unfolded(found, docs.columns, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source"),
                    n_chars=F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id; see jaccard.keep_one.

    Null and empty texts link with nothing and stay, rows with a null id stay, rows that repeat id and text are one; long
    texts are read whole; an empty table gives an empty result; extra columns are carried along whatever their names.
    """
    return jaccard.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no test item; see decontaminate.clean.

    Null and empty texts stay, rows with a null id and repeated rows are judged by their text like all others; long texts
    are read whole; an empty table gives an empty result, an empty benchmark leaves docs as it is; extra columns are
    carried along whatever their names.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row for each piece of a document; see packing.pack_documents.

    Null and empty texts are one piece of one id, repeated rows are packed each, only texts that don't fit a sequence are
    cut, equal lengths are ranked by task and then by id, an empty table gives an empty result, and other columns are not read.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontaminate", leaks),
    ("best_fit_packing", pack),
]

# Language models, alignments and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
