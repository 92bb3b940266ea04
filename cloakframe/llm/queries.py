"""Queries of problems 2 to 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import canon, lookalike, mixing, names, packing, pii, subjects
from cloakframe.llm.sql import SQL  # noqa: F401
from cloakframe.llm.tokens import token_counts
from cloakframe.sources.tables import settle, table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.canonical(table(spark, d, "pupil_records"), table(spark, d, "canon_values"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """How many entries of each field came out under each code, unmatched ones included."""
    return p5_found(spark, d).groupBy("field_name", "code").agg(F.count("*").alias("entries"))


def p4_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """Every name and response that was not in its consistent form, with that form."""
    names = table(spark, d, "pupil_records").select(F.lit("pupil_records").alias("origin"), F.col("record_id").alias("row_id"), F.col("pupil_name").alias("text"))
    texts = table(spark, d, "responses").select(F.lit("responses").alias("origin"), F.col("response_id").alias("row_id"), "text")
    both = names.unionByName(texts)
    counts = lookalike.count_characters(both.select("text"))
    return lookalike.consistent(both, ["origin", "row_id"], "text", counts).select("origin", "row_id", F.col("after").alias("text")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_rewritten(spark, d).select("origin", "row_id").distinct()


def _spans(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "pupil_records")
    return pii.personal_spans(records, "record_id", "comments", records, "pupil_name")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.numbered(_spans(spark, d), "record_id")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every comment with placeholders in place of the personal information."""
    rows = table(spark, d, "pupil_records").select("record_id", "comments")
    return pii.redact(rows, "record_id", "comments", _spans(spark, d)).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "pupil_records")
    spelled = names.Spellings(records)
    pupils = names.same_pupils(spelled).select(F.lit("pupil_name").alias("field_name"), "left_id", "right_id")
    staff = names.staff_named(records, table(spark, d, "staff"), spelled.own)
    return pupils.unionByName(staff.select(F.lit("comments").alias("field_name"), F.col("record_id").alias("left_id"), F.col("staff_id").alias("right_id")))


def p3_people(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling of a class that is linked to another, with the person meant."""
    spelled = names.Spellings(table(spark, d, "pupil_records"))
    return spelled.keys.select("id", "class_id", F.col("key").alias("spelling")).join(names.linked_spellings(spelled), "id").drop("id")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the number of tokens of their whole text."""
    return settle(token_counts(table(spark, d, "documents"), ["doc_id", "source"], "text"), "sizes")


def p6_containers_512(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d).select("doc_id", "n_tokens"), "doc_id", 512)


def p6_containers_2048(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d).select("doc_id", "n_tokens"), "doc_id", 2048)


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    sizes = _sizes(spark, d).select("doc_id", "n_tokens")
    return packing.usage(packing.pack(sizes, "doc_id", 512), 512).unionByName(packing.usage(packing.pack(sizes, "doc_id", 2048), 2048))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, wanted = _sizes(spark, d), table(spark, d, "mix_targets")
    return mixing.shares_reached(sizes, wanted, mixing.mix(sizes, wanted))


def _subjects(spark: SparkSession, d: str) -> subjects.Subjects:
    return subjects.Subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).found()


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject; documents without one count under ``none``."""
    docs = table(spark, d, "documents").select("doc_id").distinct()
    return docs.join(p8_found(spark, d), "doc_id", "left").groupBy(F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.count("*").alias("docs"))


def p8_leaves(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).leaf_labels()


QUERIES = {
    "p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p3_people": p3_people, "p4_found": p4_found, "p4_rewritten": p4_rewritten,
    "p5_found": p5_found, "p5_report": p5_report, "p6_containers_512": p6_containers_512, "p6_containers_2048": p6_containers_2048, "p6_usage": p6_usage,
    "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_counts": p8_counts, "p8_leaves": p8_leaves,
}
