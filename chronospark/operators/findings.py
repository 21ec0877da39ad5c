"""Findings: matches explained, alone or merged by rule, with technique mappings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.correlation import confidence_level

ENGINES = {"correlation": "Correlation", "sigma": "Sigma", "yara_x": "YARA-X"}
RANKS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "informational": 1}
DEFAULT_CONFIDENCE = 0.5


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANKS.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def severity_of(match_type: Column, score_base: Column, level: Column) -> Column:
    """By the score's base for sequence matches, else the rule's level, else medium."""
    own = F.when(level.isin(*RANKS), level).otherwise("medium")
    by_score = F.when(score_base < 0.5, "low").when(score_base < 0.8, "medium").otherwise("high")
    return F.when((match_type == "correlation") & score_base.isNotNull(), by_score).otherwise(own)


def _engine(match_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in ENGINES.items():
        out = F.when(match_type == k, v).otherwise(out)
    return out


def single(matches: DataFrame) -> DataFrame:
    """One finding for each match. Optional columns of ``matches``: score, score_base, level."""
    m = matches
    for name, kind in (("score", "double"), ("score_base", "double"), ("level", "string")):
        m = m if name in m.columns else m.withColumn(name, F.lit(None).cast(kind))
    engine, rule = _engine(F.col("match_type")), F.col("rule_id")
    reasons = F.when(F.size("reasons") == 0, "no details").otherwise(F.array_join("reasons", "; "))
    where = F.when(F.col("match_type") == "yara_x", " in file contents: ").otherwise(" in events: ")
    severity = severity_of(F.col("match_type"), F.col("score_base"), F.col("level"))
    confidence = F.coalesce("score", F.lit(DEFAULT_CONFIDENCE))
    listed = lambda name: F.when(F.size(name) > 0, F.concat(F.lit(f"{name}=["), F.array_join(F.array_sort(name), ","), F.lit("]")))
    observed = F.filter(F.concat(F.array(F.concat(F.lit("rule_id="), rule), F.concat(F.lit("rule_sha256="), "rule_sha256"), F.concat(F.lit("match_type="), "match_type"), listed("event_ids"), listed("evidence_ids")), F.transform("reasons", lambda r: F.concat(F.lit("reason: "), r))), lambda x: x.isNotNull())
    inference = F.concat(F.lit("What "), rule, F.lit(" describes may have happened; severity "), severity, F.lit("."))
    return m.select(
        ids.finding_id(F.col("match_type"), F.array(ids.rule_content(F.col("match_type"), rule, F.col("rule_sha256"))), F.col("event_ids"), F.col("evidence_ids")).alias("finding_id"),
        F.concat(engine, F.lit(" match: "), rule).alias("title"), F.concat(rule, F.lit(" ("), engine, F.lit(")"), where, reasons).alias("description"),
        severity.alias("severity"), confidence.alias("confidence"), confidence_level(confidence).alias("confidence_level"), F.array_sort("event_ids").alias("event_ids"), F.array_sort("evidence_ids").alias("evidence_ids"), F.array("match_id").alias("match_ids"), F.array("rule_id").alias("rule_refs"), observed.alias("observed_evidence"), F.array(inference).alias("inference"),
    )


@dataclass
class MergeRule:
    """Matches of these rules become one finding."""

    group_id: str
    rule_ids: list[str]
    title: str
    severity: str = "medium"


def build(matches: DataFrame, rules: list[MergeRule]) -> DataFrame:
    """Merged findings for matches of the merge rules, single ones for the rest. The first group by name takes a match.

    A group is gathered from partial sets, so that a group with many matches is pre-aggregated where they are; its ids are
    its result and grow with it.
    """
    if not rules:
        return single(matches)
    spark = matches.sparkSession
    pairs = spark.createDataFrame([(r.group_id, x, r.title, r.severity) for r in rules for x in r.rule_ids], "group_id string, g_rule string, g_title string, g_severity string")
    first = pairs.withColumn("n", F.row_number().over(Window.partitionBy("g_rule").orderBy("group_id"))).where("n = 1").drop("n")
    tagged = matches.join(F.broadcast(first), matches.rule_id == first.g_rule, "left")  # as many rows as the rules name
    alone = single(tagged.where("group_id IS NULL").select(*matches.columns))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    merged = tagged.where("group_id IS NOT NULL").groupBy("group_id", "g_title", "g_severity").agg(
        union("event_ids").alias("event_ids"), union("evidence_ids").alias("evidence_ids"), F.array_sort(F.collect_set("match_id")).alias("match_ids"), F.array_sort(F.collect_set("rule_id")).alias("rule_refs"), F.array_sort(F.collect_set("rule_sha256")).alias("shas"), F.collect_set(ids.rule_content(F.col("match_type"), F.col("rule_id"), F.col("rule_sha256"))).alias("contents"), F.array_sort(F.collect_set("match_type")).alias("types"), F.count("*").alias("n"),
        F.array_sort(F.flatten(F.collect_set(F.transform("reasons", lambda r: F.concat(F.lit("reason ("), F.col("rule_id"), F.lit("): "), r))))).alias("why"),
    )
    listed = lambda label, c: F.concat(F.lit(f"{label}=["), F.array_join(c, ","), F.lit("]"))
    made = merged.select(
        ids.finding_id(F.lit("merged"), F.col("contents"), F.col("event_ids"), F.col("evidence_ids")).alias("finding_id"), F.col("g_title").alias("title"), F.concat(F.col("n").cast("string"), F.lit(" matches taken as one")).alias("description"), F.col("g_severity").alias("severity"),
        F.lit(DEFAULT_CONFIDENCE).alias("confidence"), confidence_level(F.lit(DEFAULT_CONFIDENCE)).alias("confidence_level"), "event_ids", "evidence_ids", "match_ids", "rule_refs",
        F.concat(F.array(listed("rule_ids", "rule_refs"), listed("rule_sha256_list", "shas"), listed("match_ids", "match_ids"), listed("match_types", "types")), F.col("why")).alias("observed_evidence"),
        F.array(F.concat(F.col("n").cast("string"), F.lit(" matches belong together; severity "), F.col("g_severity"), F.lit("."))).alias("inference"),
    )
    return made.unionByName(alone)


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")).desc(), "finding_id")


def lost(matches: DataFrame, findings: DataFrame) -> DataFrame:
    """Match ids that no finding refers to; empty if none is lost."""
    return matches.select("match_id").subtract(findings.select(F.explode("match_ids").alias("match_id")))


# Techniques

#: Rows of a technique dataset (some 200 bytes each) up to which it is broadcast.
BROADCAST_TECHNIQUES = 50_000
TECHNIQUE = r"^T[0-9]{4}(\.[0-9]{3})?$"


def technique_of_tag(tag: Column) -> Column:
    """attack.t1059.001 as T1059.001; null for other tags."""
    found = F.regexp_extract(F.lower(tag), r"^attack\.(t[0-9]{4}(?:\.[0-9]{3})?)$", 1)
    return F.when(found != "", F.upper(found))


def stix_techniques(bundle: DataFrame) -> DataFrame:
    """(technique_id, name, tactic) of a STIX bundle read as JSON; of equal ids the last in the file."""
    objects = bundle.where(F.col("type") == "bundle").select(F.posexplode("objects").alias("n", "o")).where("o.type = 'attack-pattern'")
    reference = F.element_at(F.filter("o.external_references", lambda r: r["source_name"] == "mitre-attack"), 1)["external_id"]
    named = objects.select("n", reference.alias("technique_id"), F.col("o.name").alias("name"), F.get(F.col("o.kill_chain_phases"), 0)["phase_name"].alias("tactic")).where("technique_id IS NOT NULL")
    return named.groupBy("technique_id").agg(F.max_by("name", "n").alias("name"), F.max_by("tactic", "n").alias("tactic"))


def map_techniques(wanted: DataFrame, dataset: DataFrame, strict: bool = False) -> DataFrame:
    """``wanted``'s technique_id with the dataset's name and tactic, and whether it is known.

    With ``strict`` an id that the dataset lacks is an error when its row is read, and so is a dataset without techniques. The dataset
    is broadcast up to BROADCAST_TECHNIQUES rows, after counting.
    """
    n = dataset.limit(BROADCAST_TECHNIQUES + 1).count()
    if strict and not n:
        raise ValueError("the dataset has no techniques")
    own = dataset.withColumn("known", F.lit(True))
    out = wanted.join(F.broadcast(own) if n <= BROADCAST_TECHNIQUES else own, "technique_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    if strict:
        out = out.withColumn("known", F.when(F.col("known") | F.col("technique_id").isNull(), F.col("known")).otherwise(F.raise_error(F.concat(F.lit("unknown technique "), F.col("technique_id")))))
    return out
