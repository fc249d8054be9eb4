"""A training-data pipeline over `documents`: quality, near duplicates, benchmark leaks, personal data, SentencePiece
ids. Each stage reads what its predecessor wrote; all but the last return the columns of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, jaccard_join, pii, quality, sentencepiece
from weftgraph.llm._tables import scratch, stored
from weftgraph.llm.queries import PIECES, remainder, table, text_batches


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score below 0.3 go. Null and empty texts have the score of a text without features; each row is judged
    by its own text, so repeated rows and null ids stay or go alike. An empty table stays empty. Columns may have any names."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    # The score is computed beside the row, so nothing is joined.
    return quality.kept(docs, model, 0.3)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, stored, with a key of its own for each row, and the name of that column, which docs has not. Keys are dense, as bitmaps take their low bits."""
    key = "_row"
    while key in map(str.lower, docs.columns):
        key += "_"
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    part = F.shiftright(key, 33)
    parts = (rows.agg(F.max(part)).first()[0] or 0) + 1
    return rows.withColumn(key, F.expr(f"({key} & {(1 << 33) - 1}L) * {parts}L") + part), key


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) one row stays, that with the smallest doc_id, null
    ids last; of rows with the same doc_id and texts in one group any one. Texts without words, null ones among them, are in no group; of those that repeat an id and
    text, one stays. An empty table stays empty. Other columns may have any names."""
    text_batches(spark)
    rows, key = keyed(docs)
    groups = jaccard_join.jaccard_components(rows, words=5, percent=80, id_col=key)
    blank = F.expr("n_shingles = 0 and doc_id is not null")
    # A row's group: its component, or id and text where that has no words.
    group = [F.when(~blank, F.col("component_id")).alias("g"), F.when(blank, F.col("doc_id")).alias("i"), F.when(blank, F.col("text")).alias("t")]
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", key)
    kept = groups.join(rows.select(key, "doc_id", F.expr("if(text rlike '[^ \\\\x09-\\\\x0D]', null, text)").alias("text")), key).select(*group, least.alias("r")).groupBy("g", "i", "t").agg(F.min("r").alias("r"))
    return rows.join(kept.select(f"r.{key}"), key, "left_semi").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, whatever their ids: null ones and repeated rows each by its own text. Null and empty texts stay, and so
    does all where the benchmark is empty. Other columns may have any names."""
    rows, key = keyed(docs)
    gone = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=key).select(key).distinct()
    return rows.join(gone, key, "left_anti").select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that give it away are replaced in the texts; n_chars follows. No row goes. Null texts stay null with a null n_chars, empty ones
    empty; null and repeated ids are kept, equal rows get equal texts. An empty table stays empty. Columns may have any names."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, round_trip, ids): the piece ids of each whole text, decoded again as a check. A null or empty text has no pieces
    and counts as decoded. A row for each row, null and repeated ids too; an empty table gives none."""
    text_batches(spark)
    pieces = sentencepiece.load_pieces(PIECES)
    out = sentencepiece.encode(docs.select("doc_id", "text"), pieces, decode_to="decoded")
    same = F.coalesce("decoded", F.lit("")) == F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), same.alias("round_trip"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: No SQL: training, the singular vectors and the best paths can't be stated in it; tests/llm/test_pipeline.py has each stage on planted and awkward rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # What a stage writes for itself goes when its result is written.
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
    return docs
