"""Sequence rules over several events, compiled to a chain of bucketed range joins."""

from __future__ import annotations

import functools
import hashlib
import operator
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from . import yaml
from .fields import Field, equals, equals_field, resolve, stringified

OPERATORS = ("eq", "neq", "contains", "starts_with", "ends_with", "regex", "exists", "in")
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
MAX_WINDOW_SECONDS = 86_400
SEVERITIES = ("informational", "low", "medium", "high", "critical")


class RuleError(ValueError):
    pass


def within_ms(text: str) -> int:
    m = re.fullmatch(r"([1-9][0-9]*)(ms|s|m|h|d)", str(text))
    if not m:
        raise RuleError(f"within {text!r}")
    return int(m[1]) * UNITS[m[2]]


def java_pattern(pattern: str) -> str | None:
    """The pattern for Java's engine with Unicode classes, LF line ends and an absolute $; None if it isn't in the linear-time subset."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\(\?>|[*+?}]\+", pattern):
        return None
    out, at, inside = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(r"\z" if c == "$" and not inside else c)
        at += 1
    try:
        re.compile(pattern)
    except re.error:
        return None
    return "(?Ud)" + "".join(out)


@dataclass
class Predicate:
    field: str
    operator: str
    value: Any = None
    variable: str | None = None
    case_sensitive: bool = False

    def column(self, bound: dict[str, Field] | None = None) -> Column:
        f = resolve(self.field)
        if self.operator == "exists":
            return f.present
        if self.variable is not None:
            other = (bound or {}).get(self.variable)
            if other is None:
                return F.lit(self.operator == "neq")
            if self.operator in ("eq", "neq"):
                same = equals_field(f, other, self.case_sensitive)
                return same if self.operator == "eq" else ~same
            right: Any = other.text
        else:
            if self.operator in ("eq", "neq"):
                same = equals(f, self.value, self.case_sensitive)
                return same if self.operator == "eq" else ~same
            if self.operator == "in":
                return functools.reduce(operator.or_, [equals(f, v, self.case_sensitive) for v in self.value], F.lit(False)) if isinstance(self.value, list) else F.lit(False)
            text = stringified(self.value)
            if text is None:
                return F.lit(False)
            if self.operator == "regex":
                pattern = java_pattern(text)
                return F.coalesce(f.present & f.text.rlike(pattern), F.lit(False)) if pattern else F.lit(False)
            right = F.lit(text)
        if self.operator in ("regex", "in"):
            return F.lit(False)
        left = f.text
        if not self.case_sensitive:
            left, right = F.lower(left), F.lower(right)
        test = {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[self.operator]
        return F.coalesce(f.present & test(left, right), F.lit(False))


@dataclass
class Step:
    event_type: str
    source: str | None = None
    assertion: str | None = None
    where: list[Predicate] = field(default_factory=list)
    bind: dict[str, str] = field(default_factory=dict)

    def static(self) -> Column:
        """What can be tested without earlier steps."""
        tests = [F.col("event_type") == self.event_type]
        tests += [F.col("source") == self.source] if self.source else []
        tests += [F.col("assertion") == self.assertion] if self.assertion else []
        tests += [p.column() for p in self.where if p.variable is None]
        tests += [resolve(path).present for path in self.bind.values()]
        return functools.reduce(operator.and_, tests)


@dataclass
class Rule:
    rule_id: str
    title: str
    sha256: str
    severity: str
    steps: list[Step]
    within: int
    partition_by: list[str]
    base: float
    adjustments: list[tuple[str, float]]
    allow_uncertain: bool = False
    max_uncertainty_ms: int | None = None
    max_matches: int | None = 100_000
    attack: list[str] = field(default_factory=list)

    def score(self) -> float:
        return min(1.0, max(0.0, self.base + sum(v for _, v in self.adjustments)))


def confidence_level(score: Column) -> Column:
    return F.when(score < 0.5, "low").when(score < 0.8, "medium").otherwise("high")


def compile_rule(source: str | bytes, max_window_seconds: int = MAX_WINDOW_SECONDS) -> Rule:
    raw = source.encode() if isinstance(source, str) else source
    try:
        doc = yaml.parse(raw.decode())
    except (yaml.YamlError, UnicodeDecodeError) as e:
        raise RuleError(str(e)) from e

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise RuleError(what)

    known = {"id", "version", "title", "description", "enabled", "severity", "sequence", "within", "partition_by", "allow_uncertain_time", "max_uncertainty_ms", "max_matches", "score", "mitre_attack", "tags", "references"}
    need(isinstance(doc, dict) and set(doc) <= known, "unknown keys")
    need({"id", "version", "title", "severity", "sequence", "within", "partition_by", "score"} <= set(doc), "keys are missing")
    need(re.fullmatch(r"TF-CORR-[0-9]{3,}", str(doc["id"])) is not None, "id")
    need(re.fullmatch(r"[0-9]+\.[0-9]+\.[0-9]+", str(doc["version"])) is not None, "version")
    need(doc["severity"] in SEVERITIES, "severity")
    need(isinstance(doc["sequence"], list) and 1 <= len(doc["sequence"]) <= 16, "sequence")
    parts = doc["partition_by"]
    need(isinstance(parts, list) and parts and len(set(parts)) == len(parts) and set(parts) <= {"case_id", "hostname", "user"}, "partition_by")
    within = within_ms(doc["within"])
    need(within <= max_window_seconds * 1000, "within is too long")
    most = doc.get("max_matches", 100_000)
    need(isinstance(most, int) and 1 <= most <= 1_000_000, "max_matches")
    steps, bound = [], set()
    for s in doc["sequence"]:
        need(isinstance(s, dict) and set(s) <= {"event_type", "source", "assertion", "where", "bind"} and bool(s.get("event_type")), "step")
        where = []
        for p in s.get("where") or []:
            need(isinstance(p, dict) and set(p) <= {"field", "operator", "value", "variable", "case_sensitive", "normalization_profile"} and p.get("operator") in OPERATORS and bool(p.get("field")), "predicate")
            given = ("value" in p) + ("variable" in p)
            need(given == (p["operator"] != "exists"), "a predicate takes a value or a variable; exists takes neither")
            need("variable" not in p or p["variable"] in bound, "a variable is used before it is bound")
            where.append(Predicate(p["field"], p["operator"], p.get("value"), p.get("variable"), bool(p.get("case_sensitive", False))))
        bind = s.get("bind") or {}
        bound |= set(bind)
        steps.append(Step(s["event_type"], s.get("source"), s.get("assertion"), where, bind))
    score = doc["score"]
    need(isinstance(score, dict) and isinstance(score.get("base"), (int, float)) and 0 <= score["base"] <= 1 and isinstance(score.get("adjustments"), list), "score")
    return Rule(doc["id"], doc["title"], hashlib.sha256(raw).hexdigest(), doc["severity"], steps, within, parts, float(score["base"]), [(a["reason"], float(a["value"])) for a in score["adjustments"]], bool(doc.get("allow_uncertain_time", False)), doc.get("max_uncertainty_ms"), most, list(doc.get("mitre_attack") or []))


def certain(rule: Rule) -> Column:
    """An instant whose uncertainty is unknown to be anything, or at most the rule's bound."""
    u = F.col("time.uncertainty_ms")
    bound = F.lit(False) if rule.max_uncertainty_ms is None else u <= rule.max_uncertainty_ms
    return (F.col("time.type") == "utc_instant") & (u.isNull() | F.coalesce(bound, F.lit(False)))


def match(events: DataFrame, rule: Rule) -> DataFrame:
    """All sequences of the rule: match_id, rule_id, rule_sha256, event_ids, evidence_ids, ordered_event_ids, score,
    confidence_level, used_uncertain, reasons, truncated.

    ``events`` are event rows with columns sec and nano (null without a usable instant, see ``with_instants``). Each
    step is joined to the sequence so far on the partition keys and a time bucket as wide as the window plus one
    millisecond, so that a candidate can only lie in the start's bucket or the next.
    """
    sure = certain(rule)
    rows = events.withColumn("__sure", sure)
    rows = rows if rule.allow_uncertain else rows.where("__sure")
    keys = [k for k in rule.partition_by if k != "case_id"]
    wide = rule.within + 1

    def projected(step: Step, k: int) -> DataFrame:
        bound = [c for var, path in step.bind.items() for f in [resolve(path)] for c in (f.present.alias(f"p_{var}"), f.kind.alias(f"k_{var}"), f.text.alias(f"t_{var}"), f.json.alias(f"j_{var}"))]
        return rows.where(step.static()).select(
            F.col("sec").alias(f"sec{k}"), F.col("nano").alias(f"nano{k}"), F.col("event_id").alias(f"id{k}"), F.col("provenance.evidence_id").alias(f"ev{k}"), F.col("__sure").alias(f"sure{k}"),
            *[F.col(key).alias(f"{key}{k}") for key in keys], *bound, *([F.struct("*").alias(f"row{k}")] if any(p.variable for p in step.where) else []),
        )

    found = projected(rule.steps[0], 0)
    if len(rule.steps) > 1:
        found = found.where("sec0 IS NOT NULL").withColumn("bucket", F.floor((F.col("sec0") * 1000 + F.floor(F.col("nano0") / 1_000_000)) / wide))
    variables = list(rule.steps[0].bind)
    for k, step in enumerate(rule.steps[1:], 1):
        ms = F.col(f"sec{k}") * 1000 + F.floor(F.col(f"nano{k}") / 1_000_000)
        later = projected(step, k).where(f"sec{k} IS NOT NULL").withColumn("bk", F.explode(F.array(F.floor(ms / wide), F.floor(ms / wide) - 1)))
        before = F.struct(F.col(f"sec{k - 1}"), F.col(f"nano{k - 1}"), F.col(f"id{k - 1}"))
        now = F.struct(F.col(f"sec{k}").alias(f"sec{k - 1}"), F.col(f"nano{k}").alias(f"nano{k - 1}"), F.col(f"id{k}").alias(f"id{k - 1}"))
        elapsed = F.floor(((F.col(f"sec{k}") - F.col("sec0")) * 1_000_000_000 + F.col(f"nano{k}") - F.col("nano0")) / 1_000_000)
        on = [F.col("bucket") == F.col("bk"), *[F.col(f"{key}0") == F.col(f"{key}{k}") for key in keys], now > before, elapsed <= rule.within]
        found = found.join(later, functools.reduce(operator.and_, on)).drop("bk")
        if any(p.variable for p in step.where):
            bound = {v: Field(F.col(f"p_{v}"), F.col(f"k_{v}"), F.col(f"t_{v}"), F.col(f"j_{v}")) for v in variables}
            flat = found.select(*[F.col(c) for c in found.columns if c != f"row{k}"], f"row{k}.*")
            tests = [p.column(bound) for p in step.where if p.variable]
            found = flat.where(functools.reduce(operator.and_, tests)).select(*[c for c in found.columns if c != f"row{k}"])
        variables += [v for v in step.bind if v not in variables]

    n = len(rule.steps)
    ordered = F.array(*[F.col(f"id{k}") for k in range(n)])
    used = functools.reduce(operator.or_, [~F.col(f"sure{k}") for k in range(n)])
    total = F.lit(rule.score())
    names = ", then ".join(s.event_type for s in rule.steps)
    parts = [F.lit(f"{rule.title}: seen in this order: {names}"), F.concat(F.lit(f"severity {rule.severity}, confidence "), confidence_level(total)), F.when(used, F.lit("at least one time is uncertain"))]
    summary = [F.concat(F.lit(f"{s.event_type} "), ids.short_id(F.col(f"id{k}"))) for k, s in enumerate(rule.steps)]
    parts.append(F.concat_ws("; ", *summary))
    # The cap orders matches by their start and then by each step. A global order needs one task; it sees at most
    # max_matches + 1 rows, which a top-k takes from each partition first.
    order = [c for k in range(n) for c in (F.asc_nulls_first(f"sec{k}"), F.asc_nulls_first(f"nano{k}"), F.asc(f"id{k}"))]
    # Without a cap (None) nothing is ordered.
    if rule.max_matches is None:
        out = found.withColumn("truncated", F.lit(False))
    else:
        top = found.orderBy(*order).limit(rule.max_matches + 1)
        ranked = top.withColumn("__r", F.row_number().over(Window.orderBy(*order)))
        truncated = F.count("*").over(Window.partitionBy()) > rule.max_matches
        out = ranked.withColumn("truncated", truncated).where(F.col("__r") <= rule.max_matches)
    return out.select(
        ids.match_id(F.lit(rule.rule_id), F.lit(rule.sha256), ordered).alias("match_id"), F.lit("correlation").alias("match_type"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.sha256).alias("rule_sha256"),
        F.array_sort(ordered).alias("event_ids"), F.array_sort(F.array_distinct(F.array(*[F.col(f"ev{k}") for k in range(n)]))).alias("evidence_ids"), ordered.alias("ordered_event_ids"),
        total.alias("score"), F.lit(rule.base).alias("score_base"), confidence_level(total).alias("confidence_level"), used.alias("used_uncertain"), F.filter(F.array(*parts), lambda x: x.isNotNull()).alias("reasons"), "truncated",
    )
