"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of ``documents``; ``n_chars`` follows the
text.  Null texts count as empty and stay; a document whose text goes to
nothing stays with an empty text.  Very long texts are taken whole.  An empty
table stays empty.  Other columns, whatever their names, are carried along
untouched: an operator sees each row as an id, a text and one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources.tables import read_table

CARRIED = "carried"


def carried(docs: DataFrame) -> DataFrame:
    """(doc_id, text, carried): every column under a name of its own in one
    struct, so that none can clash with an operator's."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return docs.select("doc_id", "text", row.alias(CARRIED))


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the text that ``rows`` have now."""
    length = F.length(F.coalesce("text", F.lit(""))).cast("long")
    now = {"text": F.col("text"), "n_chars": length}
    return rows.select(*[now.get(c, F.col(CARRIED)[f"c{i}"]).alias(c) for i, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is too low go; those
    that stay keep their row as it is.  The model is fitted on the rated
    documents of the stage's input; without any, all stay.  Rows with a null
    id are judged by their text; repeated rows share their fate."""
    from marquee.llm import quality

    rows = carried(docs)
    model = quality.train(rows, quality.ratings_of(read_table(spark, sf_dir, "labels")), quality.N_GRADES)
    chosen = quality.score(rows, model).where(quality.keep())
    return chosen.select(*[F.col(CARRIED)[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id
    stays.  Documents with a null id are no duplicates; of rows with equal id
    and text one stays, the first by its other columns; texts without words
    are one class."""
    from marquee.llm.minhash import near_duplicates

    rows = carried(docs)
    stay = near_duplicates(rows.select("doc_id", "text")).where("doc_id = class_id").select("doc_id").distinct()
    with_id = rows.where("doc_id is not null").join(stay, "doc_id", "left_semi")
    once = with_id.groupBy("doc_id", F.xxhash64("text").alias("digest")).agg(F.min(CARRIED).alias(CARRIED)).select(CARRIED)
    both = once.unionByName(rows.where("doc_id is null").select(CARRIED))
    return both.select(*[F.col(CARRIED)[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 100-byte strings go from the texts; all rows stay.
    Rows with equal id and text are one document; null ids come last."""
    from marquee.llm.suffix_dedup import dedup

    return restored(dedup(carried(docs), clean=True), docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all rows stay."""
    from marquee.llm.secret_scan import redact

    return restored(redact(carried(docs)), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the texts that are left, one row per piece.  Rows with a
    null or a repeated id are documents of their own; an empty text is its end
    id alone."""
    import public_tokenizers

    from marquee.llm.packing import pack

    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("repeats", repeats_stage), ("secrets", secrets_stage), ("packing", packing_stage)]
