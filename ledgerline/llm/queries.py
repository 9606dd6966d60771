"""Queries of the problems that belong to training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import history, langid, mixing, names, neardup, packing, tokens
from ledgerline.llm.sql import SQL
from ledgerline.sources.lineage import written
from ledgerline.sources.tables import once, table

#: Similarity of two contents, for problems 1 and 2: runs of three words, at least a half in common.
WORDS, LEAST = 3, 0.5


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    out = history.check_deliveries(table(spark, folder, "article"), table(spark, folder, "article_batch"), words=WORDS, least=LEAST, at_once=6)
    return out.select(F.col("id").alias("id_a"), F.col("of").alias("id_b")).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def _p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, folder, "article"), "id", "content", words=WORDS, least=LEAST)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.pairs_within(_p2_groups(spark, folder), "id")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each grouped item with the least id of its group and the group's size."""
    g = _p2_groups(spark, folder)
    head = g.groupBy("group").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("members"))
    return g.join(head, "group").select("id", "group_id", "members")


#: A part of an education entry that names an institution; a qualification such as "Pre-University" names none.
_SCHOOL = r"(?i)(?:^|·)\s*([^·]*(?<![\w-])(?:university|college|institute|school|academy)(?!\w)[^·]*?)\s*(?:·|$)"


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    doctor = once(table(spark, folder, "doctor"), "id", "name", "nationality", "education", "facility")
    entries = F.filter(F.split("education", r"\|"), lambda e: F.contains(F.lower(e), F.lit("graduated")))
    studies = doctor.select("id", "name", "nationality", F.explode(entries).alias("e"))
    block = [F.nullif(F.trim(c), F.lit("")) for c in (F.col("nationality"), F.regexp_extract("e", _SCHOOL, 1), F.regexp_extract("e", r"(?i)(?:^|·)\s*Graduated\s+(\d{4})\s*(?:·|$)", 1))]
    persons = names.person_pairs(studies, "id", "name", block)
    links = names.facility_links(doctor, table(spark, folder, "facility"))
    return persons.select(F.lit("person").alias("kind"), "key_a", "key_b").union(links.select(F.lit("facility").alias("kind"), "key_a", "key_b"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    out = langid.identify(table(spark, folder, "documents"), "doc_id", "text", "lang")
    wrong = (F.col("segments") > 1) | ~F.col("given").eqNullSafe(F.col("seg_lang"))
    return out.where(F.col("seg_no").isNotNull() & wrong).select("doc_id", "seg_no", F.col("seg_lang").alias("lang"))


def p8_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and stretch with its language and confidence."""
    return langid.identify(table(spark, folder, "documents"), "doc_id", "text", "lang")


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return written(tokens.counted(table(spark, folder, "documents"), ["doc_id", "source"], "text"), "sizes")


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_sizes(spark, folder), table(spark, folder, "pack_limit"), "doc_id", "source")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, folder))


def p6_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return packing.mixture_report(written(p6_packed(spark, folder), "places"))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    sizes = _sizes(spark, folder)
    places = packing.packed(sizes, table(spark, folder, "pack_limit"), "doc_id", "source")
    return packing.place_checks(written(places, "places"), sizes, "doc_id")


def p6_target_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """As p6_mixture, for containers filled towards the shares of mix_target as long as its sources have documents."""
    targets = table(spark, folder, "mix_target").select("source", "weight")
    return packing.mixture_report(written(packing.packed(_sizes(spark, folder), table(spark, folder, "pack_limit"), "doc_id", "source", targets=targets), "places"))


def p7_drawn(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.drawn(_sizes(spark, folder), table(spark, folder, "mix_target"), "doc_id")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    sizes, targets = _sizes(spark, folder), table(spark, folder, "mix_target")
    return mixing.share_report(written(mixing.drawn(sizes, targets, "doc_id"), "draws"), sizes, targets)


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    sizes, targets = _sizes(spark, folder), table(spark, folder, "mix_target")
    return mixing.draw_checks(written(mixing.drawn(sizes, targets, "doc_id"), "draws"), sizes, targets, "doc_id")


__all__ = ["QUERIES", "SQL"]

QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_groups, p4_found, p6_packed, p6_fill, p6_mixture, p6_checks, p6_target_mixture, p7_drawn, p7_shares, p7_checks, p8_found, p8_labels)}
