"""The registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import analysis
from ..functions import ids, text, times
from ..operators import export, findings, scan, timeline, usn
from ..sources import evidence
from ..sources.parsers import parse_contents
from ..ship import ship
from . import correlation, sigma
from .correlation import Predicate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as event rows, with sec and nano beside the time."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    micros, user = F.unix_micros("ts"), F.col("user_id").cast("string")
    path = F.concat(F.lit("C:\\Users\\"), user, F.lit("\\"), "event_type", F.lit(".exe"))
    none = F.lit(None).cast("string")
    k = F.get_json_object("props", "$.k")
    channel = F.when(F.col("user_id") % 2 == 0, '"Security"').otherwise('"System"')
    attributes = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ("k", "evtx.event_id", "evtx.channel", "score", "note"))), F.array(k, k, channel, F.when(F.col("user_id") % 3 == 0, F.round(F.col("value")).cast("long").cast("string")), F.when(F.col("user_id") % 4 == 0, "null"))), lambda _, v: v.isNotNull())
    path_struct = F.struct(path.alias("original"), F.lower(path).alias("comparison_key"), F.lit("windows-path-v1").alias("normalization_profile"))
    return e.select(
        F.concat(F.lit("ev-"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("event_id"),
        F.struct(F.lit("utc_instant").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("value"), none.alias("timezone"), none.alias("start"), none.alias("end"), F.lit("event_logged").alias("kind"), F.when(F.col("event_id") % 10 == 0, F.lit(5000)).cast("long").alias("uncertainty_ms")).alias("time"),
        F.lit("evtx").alias("source"), "event_type", F.lit("observed").alias("assertion"), F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("HOST"), (F.col("user_id") % 7).cast("string"))).alias("hostname"), user.alias("user"), none.alias("program"), path_struct.alias("path"),
        F.struct(F.col("user_id").alias("pid"), F.lit(None).cast("long").alias("ppid"), F.concat(F.lit("run.exe --"), "event_type", F.lit(" "), k).alias("command_line"), path_struct.alias("image_path")).alias("process"),
        F.concat(F.lit("=user "), user, F.lit(" did <"), "event_type", F.lit(">, \"k\"="), k).alias("message"), attributes.alias("attributes"), F.struct(F.concat(F.lit("evd-"), (F.col("user_id") % 16).cast("string")).alias("evidence_id")).alias("provenance"),
        F.floor(micros / 1_000_000).alias("sec"), (F.pmod(micros, F.lit(1_000_000)) * 1000).cast("int").alias("nano"),
    )


EV = r"""ev AS (SELECT 'ev-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS id, event_id AS n, ts, user_id AS u, CAST(user_id AS VARCHAR) AS usr, event_type AS et, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
CASE WHEN user_id % 5 <> 0 THEN 'HOST' || CAST(user_id % 7 AS VARCHAR) END AS host, 'evd-' || CAST(user_id % 16 AS VARCHAR) AS evd, CASE WHEN user_id % 3 = 0 THEN CAST(round_even(value, 0) AS BIGINT) END AS score,
'C:\Users\' || CAST(user_id AS VARCHAR) || '\' || event_type || '.exe' AS path, 'run.exe --' || event_type || ' ' || json_extract_string(props, '$.k') AS cmd,
'=user ' || CAST(user_id AS VARCHAR) || ' did <' || event_type || '>, "k"=' || json_extract_string(props, '$.k') AS message FROM events)"""
EV = EV.replace("CAST(round_even(value, 0) AS BIGINT)", "CAST(CASE WHEN value >= 0 THEN floor(value + 0.5) ELSE ceil(value - 0.5) END AS BIGINT)")


def lp(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN unhex('FFFFFFFF') ELSE unhex(lpad(to_hex(octet_length(encode({x}))), 8, '0')) || encode({x}) END)"


def sql_id(kind: str, *parts: str) -> str:
    return f"'tf-{kind}-v1:' || sha256({' || '.join(parts)})"


def sql_match_id(rule_id: str, sha: str, event_ids: list[str]) -> str:
    return sql_id("match", lp(f"'{rule_id}'"), lp(f"'{sha}'"), lp(f"'{len(event_ids)}'"), *map(lp, event_ids))


def _rule(title: str, detection: str, logsource: str = "product: windows") -> str:
    return f"title: {title}\nid: rule-{title}\nlevel: high\ntags:\n  - attack.t1059.001\nlogsource:\n  {logsource}\ndetection:\n{detection}"


#: name: (rule text, the same test in SQL).
SINGLE: dict[str, tuple[str, str]] = {
    "sigma_exact": (_rule("exact", "  sel:\n    User: '7'\n  condition: sel\n"), "usr = '7'"),
    "sigma_number_text": (_rule("number", "  sel:\n    EventID: [3, 5]\n  condition: sel\n"), "k IN (3, 5)"),
    "sigma_contains_all": (_rule("contains", "  sel:\n    CommandLine|contains|all:\n      - '--CLICK'\n      - ' 1'\n  condition: sel\n"), "contains(lower(cmd), '--click') AND contains(cmd, ' 1')"),
    "sigma_startswith_endswith": (_rule("affix", "  a:\n    TargetFilename|startswith: 'c:\\users\\1'\n  b:\n    Image|endswith: '\\view.exe'\n  condition: a and b\n"), r"starts_with(lower(path), 'c:\users\1') AND ends_with(lower(path), '\view.exe')"),
    "sigma_cased": (_rule("cased", "  sel:\n    CommandLine|contains|cased: 'RUN'\n  other:\n    CommandLine|contains|cased: '--error'\n  condition: sel or other\n"), "contains(cmd, 'RUN') OR contains(cmd, '--error')"),
    "sigma_exists_null": (_rule("exists", "  has:\n    score|exists: true\n  nothing:\n    Computer: null\n  condition: has and nothing\n"), "score IS NOT NULL AND host IS NULL"),
    "sigma_glob": (_rule("glob", "  sel:\n    Image: 'C:\\Users\\?\\*s*.exe'\n  condition: sel\n"), r"regexp_full_match(lower(path), 'c:\\users\\.\\.*s.*\.exe', 's')"),
    "sigma_condition_nested": (_rule("nested", "  a:\n    k: 1\n  b:\n    User|startswith: '2'\n  c:\n    CommandLine|contains: purchase\n  condition: (a or b) and not c\n"), "(k = 1 OR starts_with(usr, '2')) AND NOT contains(cmd, 'purchase')"),
    "sigma_one_of_wildcard": (_rule("oneof", "  sel_a:\n    k: 2\n  sel_b:\n    User: '11'\n  other:\n    User: '12'\n  condition: 1 of sel_*\n"), "k = 2 OR usr = '11'"),
    "sigma_all_of_them": (_rule("allof", "  a:\n    CommandLine|contains: view\n  b:\n    - Computer: HOST1\n    - Computer: host2\n  condition: all of them\n"), "contains(cmd, 'view') AND host IN ('HOST1', 'HOST2')"),
    "sigma_logsource_routing": (_rule("routed", "  sel:\n    CommandLine|contains: error\n  condition: sel\n", "product: windows\n  service: security"), "contains(cmd, 'error') AND u % 2 = 0"),
}

PREDICATES: dict[str, tuple[Predicate, str]] = {
    "pred_eq": (Predicate("attributes.k", "eq", 4), "k = 4"),
    "pred_eq_type_strict": (Predicate("user", "in", [4, "5"]), "usr = '5'"),
    "pred_neq_absent": (Predicate("attributes.score", "neq", 50), "score IS NULL OR score <> 50"),
    "pred_in": (Predicate("event_type", "in", ["VIEW", "signup"]), "et IN ('view', 'signup')"),
    "pred_regex": (Predicate("process.command_line", "regex", r"^run\.exe --[a-e]\w+ 1?[0-5]$"), r"regexp_matches(cmd, '^run\.exe --[a-e]\w+ 1?[0-5]$')"),
    "pred_exists": (Predicate("attributes.note", "exists"), "u % 4 = 0"),
    "pred_starts_with": (Predicate("user", "starts_with", 12), "starts_with(usr, '12')"),
    "pred_ends_with": (Predicate("path.original", "ends_with", "CLICK.EXE"), "ends_with(lower(path), 'click.exe')"),
    "pred_contains": (Predicate("message", "contains", "<view>", case_sensitive=True), "contains(message, '<view>')"),
    "pred_absent_field": (Predicate("hostname", "neq", "HOST1"), "host IS NULL OR host <> 'HOST1'"),
}

SEQ2 = """id: TF-CORR-001
version: 1.0.0
title: View then purchase
severity: high
sequence:
  - event_type: view
  - event_type: purchase
within: 6h
partition_by: [user]
score: {base: 0.6, adjustments: [{reason: quick, value: 0.25}]}
"""
SEQ3 = """id: TF-CORR-002
version: 1.0.0
title: Same k thrice
severity: medium
sequence:
  - event_type: view
    bind: {kk: attributes.k}
  - event_type: click
  - event_type: purchase
    where:
      - {field: attributes.k, operator: neq, variable: kk}
within: 24h
partition_by: [user]
score: {base: 0.4, adjustments: []}
"""
HOSTS = SEQ2.replace("001", "003").replace("[user]", "[hostname]").replace("6h", "5m").replace("view", "error").replace("View", "Error")
CAPPED = SEQ2.replace("001", "004").replace("score:", "max_matches: 25\nscore:")
UNSURE = SEQ2.replace("001", "005").replace("score:", "max_uncertainty_ms: 100\nscore:")
BOUNDED = SEQ2.replace("001", "006").replace("score:", "max_uncertainty_ms: 5000\nscore:")
SEQUENCES = {"corr_seq2_user": SEQ2, "corr_seq3_bind": SEQ3, "corr_partition_null": HOSTS, "corr_max_matches": CAPPED, "corr_uncertain": UNSURE, "corr_uncertain_bounded": BOUNDED}


def _sequence_sql(source: str, steps: list[str], within_us: int, key: str, extra: str = "true", sure: str = "e.n % 10 <> 0", cap: int | None = None) -> str:
    r = correlation.compile_rule(source)
    frm = f"FROM (SELECT * FROM ev e WHERE {sure}) e0"
    for k in range(1, len(steps)):
        frm += f" JOIN (SELECT * FROM ev e WHERE {sure}) e{k} ON e{k}.{key} = e0.{key} AND (e{k}.ts, e{k}.id) > (e{k - 1}.ts, e{k - 1}.id) AND floor((epoch_us(e{k}.ts) - epoch_us(e0.ts)) / 1000) * 1000 <= {within_us}"
    where = " AND ".join([f"e{k}.et = '{s}'" for k, s in enumerate(steps)] + [extra])
    n = len(steps)
    order = ", ".join(f"e{k}.ts, e{k}.id" for k in range(n))
    limit = f" ORDER BY {order} LIMIT {cap}" if cap else ""
    chosen = " || ',' || ".join(f"e{k}.id" for k in range(n))
    return f"WITH {EV} SELECT {sql_match_id(r.rule_id, r.sha256, [f'e{k}.id' for k in range(n)])} AS match_id, {chosen} AS ordered_ids, CAST({r.score()} AS DOUBLE) AS score, '{'low' if r.score() < 0.5 else 'medium' if r.score() < 0.8 else 'high'}' AS confidence_level {frm} WHERE {where}{limit}"


SEQUENCE_SQL = {
    "corr_seq2_user": _sequence_sql(SEQ2, ["view", "purchase"], 6 * 3_600_000_000, "usr"),
    "corr_seq3_bind": _sequence_sql(SEQ3, ["view", "click", "purchase"], 24 * 3_600_000_000, "usr", "e2.k <> e0.k"),
    "corr_partition_null": _sequence_sql(HOSTS, ["error", "purchase"], 300_000_000, "host"),
    "corr_max_matches": _sequence_sql(CAPPED, ["view", "purchase"], 6 * 3_600_000_000, "usr", cap=25),
    "corr_uncertain": _sequence_sql(UNSURE, ["view", "purchase"], 6 * 3_600_000_000, "usr"),
    "corr_uncertain_bounded": _sequence_sql(BOUNDED, ["view", "purchase"], 6 * 3_600_000_000, "usr", sure="true"),
}


def sequence(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """All matches, as in the SQL; a cap holds only where the rule's text names one."""
    rule = correlation.compile_rule(source)
    if source != CAPPED:
        rule.max_matches = None
    found = correlation.match(event_rows(spark, sf_dir), rule)
    return found.select("match_id", F.array_join("ordered_event_ids", ",").alias("ordered_ids"), "score", "confidence_level")


def single_matches(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return sigma.match(event_rows(spark, sf_dir), [sigma.compile_rule(SINGLE[n][0]) for n in names])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule texts to matches in one pass, matches to findings, findings in order."""
    rules = [sigma.compile_rule(SINGLE[n][0]) for n in ("sigma_condition_nested", "sigma_contains_all", "sigma_logsource_routing")]
    made = findings.single(sigma.match(event_rows(spark, sf_dir), rules))
    return findings.ordered(made).select("finding_id", "title", "severity", "confidence", "confidence_level", F.array_join("event_ids", ",").alias("event_ids"))


def mixed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows of which four tenths have local, ranged or unknown times."""
    e = event_rows(spark, sf_dir).withColumn("d", F.substring("event_id", -1, 1))
    t, none = F.col("time"), F.lit(None).cast("string")
    naive = F.substring(t["value"], 1, 19)
    made = lambda kind, value, zone, start, end: F.struct(F.lit(kind).alias("type"), value.alias("value"), zone.alias("timezone"), start.alias("start"), end.alias("end"), t["kind"].alias("kind"), t["uncertainty_ms"].alias("uncertainty_ms"))
    mixed = F.when(F.col("d") == "1", made("local_time", naive, none, none, none)).when(F.col("d") == "2", made("local_time", naive, F.lit("America/New_York"), none, none)).when(F.col("d") == "3", made("range", none, none, t["value"], none)).when(F.col("d") == "4", made("unknown", none, none, none, none)).otherwise(t)
    return e.withColumn("time", mixed).drop("sec", "nano", "d")


MIXED = """mx AS (SELECT *, CASE n % 10 WHEN 1 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 1 END AS g, CASE n % 10 WHEN 2 THEN date_trunc('second', ts) + INTERVAL 5 HOUR ELSE ts END AS tt FROM ev)"""


def timeline_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.numbered(mixed_times(spark, sf_dir)).select("event_id", "time_group", "place")


def _documents_as_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit("")).cast("binary")
    return d.select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_locator"), F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("sha256"), body.alias("content"))


SCAN_RULES = r"""
rule license_or_token : text legal {
  strings:
    $lic = "licensed under" nocase
    $tok = /token = "[0-9a-f]{8}/
  condition:
    any of them
}
rule two_of_three {
  strings:
    $a = "the "
    $b = { 61 6e 64 ?? }
    $c = "zzz" fullword
  condition:
    2 of ($a, $b, $c) and filesize < 2KB
}
"""


def byte_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = scan.compile_file(SCAN_RULES)
    contents = _documents_as_evidence(spark, sf_dir).select(F.col("doc_id").cast("string").alias("evidence_id"), "content")
    return scan.scan(contents, rules).select("evidence_id", "rule_id", F.array_join("matched", ",").alias("matched"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes that depend on ids: a stand-in for probing real files."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("evidence_id"), F.col("doc_id").alias("n"))
    o = F.when((F.col("n") % 11 == 0) & (F.col("m") == 5), "malformed").when(F.col("n") % F.col("m") == 0, "confirmed").when(F.col("n") % 7 == 0, "probable").otherwise("not_this_format")
    # Three parsers for each evidence: an explode, not a join.
    each = d.withColumn("p", F.explode(F.array(*[F.struct(F.lit(a).alias("parser_id"), F.lit(b).alias("m")) for a, b in (("amcache", 2), ("registry", 3), ("lnk", 5))]))).select("evidence_id", "n", "p.*")
    return each.select("evidence_id", "parser_id", o.alias("outcome"))


def link_bytes(n: int) -> bytes:
    """A shell link of which the key decides which of the three times are set."""
    base = 133_000_000_000_000_000 + n * 10_000_000
    times_ = [base + i if n % (i + 2) == 0 else 0 for i in range(3)]
    return struct.pack("<I", 76) + bytes.fromhex("0114020000000000C000000000000046") + struct.pack("<IIQQQIiIHHII", 0x80, 0x20, *times_, n % 1000, 0, 1, 0, 0, 0, 0) + bytes(4)


def journal_bytes(n: int) -> bytes:
    """A folder's record, a pair of rename records and one of another file."""

    def one(name: str, file: int, parent: int, usn_: int, reason: int) -> bytes:
        raw = name.encode("utf-16-le")
        body = struct.pack("<QQqQIIIIHH", file, parent, usn_, 133_000_000_000_000_000 + n * 10_000_000, reason, 0, 0, 0x20, len(raw), 60) + raw
        size = (8 + len(body) + 7) // 8 * 8
        return (struct.pack("<IHH", size, 2, 0) + body).ljust(size, bytes(1))

    return one(f"dir{n}", 5, 4, 1, 0x100) + one("old", 7, 5, 10, 0x1000) + one("new", 7, 5, 11, 0x2000) + one("other", 8, 5, 20, 0x80000002)


def parsed(spark: SparkSession, sf_dir: str, make: Callable[[int], bytes], name: str, key: str) -> DataFrame:
    """Events that the parsers make of synthesised contents, one for each row of a table."""
    ship(spark)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # stands in for files
        for b in batches:
            keys = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(map(str, keys), pa.string()), pa.array(map(make, keys), pa.binary())], names=["source_locator", "content"])

    rows = parse_contents(table(spark, sf_dir, name).select(F.col(key).cast("long")).mapInArrow(build, "source_locator string, content binary"))
    return rows.select(F.col("provenance.source_locator").alias("source_locator"), "event_type", F.col("time.kind").alias("time_kind"), F.col("time.value").alias("time_value"), F.col("path.original").alias("path"), F.element_at("attributes", "usn.reason_flags").alias("reason_flags"), F.element_at("attributes", "lnk.timestamp_field").alias("event_ordinal"))


FLAGS = {1: "data_overwrite", 2: "data_extend", 4: "data_truncation", 256: "file_create", 512: "file_delete"}
Q = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Q]:
    out: dict[str, Q] = {}
    for name in SINGLE:
        out[name] = lambda s, d, n=name: single_matches(s, d, n).select(F.get("event_ids", 0).alias("event_id"), "match_id", "rule_id")
    out["sigma_multi_rule_single_pass"] = lambda s, d: single_matches(s, d, *SINGLE).groupBy("rule_id").agg(F.count("*").alias("n"))
    for name, (p, _) in PREDICATES.items():
        out[name] = lambda s, d, p=p: event_rows(s, d).where(p.column()).select("event_id")
    for name, source in SEQUENCES.items():
        out[name] = lambda s, d, source=source: sequence(s, d, source)

    out["timeline_order"] = timeline_order
    out["timeline_summary"] = lambda s, d: timeline.summary(mixed_times(s, d))
    out["timeline_filter"] = lambda s, d: timeline.filtered(event_rows(s, d), "2024-01-05T00:00:00Z", "2024-01-06T12:00:00Z", ["view", "error"], ["HOST1", "HOST2", "HOST3"]).select("event_id", "hostname", "event_type")

    def doc_ids(s: SparkSession, d: str) -> DataFrame:
        e = evidence.with_ids(_documents_as_evidence(s, d))
        a = e.withColumn("artifact_id", ids.artifact_id(F.col("evidence_id"), F.lit("text"), F.lit("plain"), F.lit("1.0.0")))
        ev = ids.event_id(F.col("evidence_id"), F.col("artifact_id"), F.lit("plain"), F.lit("1.0.0"), F.lit('{"type":"source_ordinal","value":0}'), F.lit(0), F.lit("document"), F.lit("observed"), F.lit('{"type":"unknown"}'), F.lit(0))
        return a.select("doc_id", "evidence_id", "artifact_id", ev.alias("event_id"))

    out["ids_evidence_artifact_event"] = doc_ids
    out["id_case"] = lambda s, d: evidence.with_ids(_documents_as_evidence(s, d)).groupBy((F.col("doc_id") % 100).alias("part")).agg(ids.case_id(F.collect_set("evidence_id")).alias("case_id"))
    out["finding_single"] = lambda s, d: findings.single(single_matches(s, d, "sigma_all_of_them")).select("finding_id", "title", "severity", "confidence_level", F.get("match_ids", 0).alias("match_id"))
    merge = [findings.MergeRule("g1", ["rule-exact", "rule-oneof"], "Two users", "critical")]
    out["finding_merge"] = lambda s, d: findings.build(single_matches(s, d, "sigma_exact", "sigma_one_of_wildcard", "sigma_all_of_them"), merge).select("title", "severity", F.size("event_ids").cast("long").alias("n_events"), F.size("match_ids").cast("long").alias("n_matches"), F.array_join("evidence_ids", ",").alias("evidence_ids"))

    def lost(s: SparkSession, d: str) -> DataFrame:
        m = single_matches(s, d, "sigma_exact", "sigma_all_of_them")
        made = findings.build(m, merge)
        none = findings.lost(m, made).select(F.lit(0).alias("of"))
        some = findings.lost(m, made.where("title = 'Two users'")).select(F.lit(1).alias("of"))
        return none.union(some).agg(F.count_if(F.col("of") == 0).alias("n_lost"), F.count_if(F.col("of") == 1).alias("n_without_singles"))

    out["finding_lossless"] = lost

    def techniques(s: SparkSession, d: str) -> DataFrame:
        data = s.createDataFrame([("T1059.001", "Shell", "execution"), ("T1003", "Dump", "credential-access")], "technique_id string, name string, tactic string")
        tags = event_rows(s, d).select("event_id", F.concat(F.lit("attack.t"), F.when(F.col("user").endswith("1"), "1059.001").when(F.col("user").endswith("2"), "1003").otherwise("9999")).alias("tag"))
        wanted = tags.select("event_id", findings.technique_of_tag(F.col("tag")).alias("technique_id"))
        return findings.map_techniques(wanted, data).groupBy("technique_id", "tactic", "known").agg(F.count("*").alias("n"))

    out["attack_lookup"] = techniques

    def united(s: SparkSession, d: str) -> DataFrame:
        """Matches of all three engines, each once, and what becomes of them."""
        rule = correlation.compile_rule(SEQUENCES["corr_seq2_user"])
        rule.max_matches = None
        frames = [single_matches(s, d, "sigma_exact", "sigma_all_of_them"), single_matches(s, d, "sigma_exact"), correlation.match(event_rows(s, d), rule)]
        scanned = analysis.byte_matches(evidence.with_ids(_documents_as_evidence(s, d)).select("evidence_id", "content"), scan.compile_file(SCAN_RULES), None)
        found = findings.single(analysis.unite([*frames, scanned]))
        return found.groupBy(F.substring_index("title", " ", 1).alias("engine")).agg(F.count("*").alias("n"), F.countDistinct("finding_id").alias("n_findings"))

    out["findings_union"] = united
    out["case_lines"] = lambda s, d: export.case_lines(export.case_parts("c", *case_tables(s, d))).groupBy("section").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.get_json_object("line", "$.record.attributes.k").cast("long")), F.lit(0)).alias("k"), F.min(F.get_json_object("line", "$.record_type")).alias("record_type"))

    def case_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        files = evidence.with_ids(_documents_as_evidence(s, d)).select("evidence_id", "source_locator", "size", "sha256", F.lit("verified_snapshot").alias("status"))
        issues = files.where("size < 100").select(F.lit("SHORT").alias("issue_code"), F.col("source_locator").alias("issue_message"), "evidence_id", F.lit(None).cast("string").alias("artifact_id"))
        return files, event_rows(s, d).drop("sec", "nano"), issues

    def guarded(s: SparkSession, d: str) -> DataFrame:
        """Messages that need the guard, that do not, that need it behind blanks, and none."""
        kind, rest = F.col("user").cast("long") % 4, F.substring("message", 2, 1 << 20)
        shown = F.when(kind == 0, F.col("message")).when(kind == 1, rest).when(kind == 2, F.concat(F.lit("  -"), rest))
        return event_rows(s, d).select("event_id", text.csv_cell(shown).alias("cell"), text.needs_formula_guard(shown).alias("guarded"))

    out["csv_guard"] = guarded
    out["csv_rows"] = lambda s, d: export.csv_lines(event_rows(s, d)).select("event_id", "line", F.col("guarded").cast("long").alias("guarded"))
    out["html_escape"] = lambda s, d: table(s, d, "pages").select("page_id", F.md5(text.html_text(F.col("html"))).alias("escaped_md5"), F.md5(text.html_attribute(F.col("html"))).alias("attribute_md5"))
    out["control_escape"] = lambda s, d: table(s, d, "documents").select("doc_id", F.md5(text.escape_controls(F.concat(F.coalesce("text", F.lit("")), F.lit("\x1b[0m\x07\x7f")))).alias("escaped_md5"))
    out["timesketch_rows"] = lambda s, d: export.timesketch(mixed_times(s, d))[0].select("event_id", "datetime", "timestamp")
    out["timesketch_excluded"] = lambda s, d: export.timesketch(mixed_times(s, d))[1].groupBy("reason").agg(F.count("*").alias("n"))
    out["manifest_counts"] = lambda s, d: export.manifest_counts(events=table(s, d, "events"), evidence=table(s, d, "documents"), issues=table(s, d, "labels"))

    def paths(s: SparkSession, d: str) -> DataFrame:
        p = F.concat(F.lit("C:/A/./"), F.regexp_replace("url", "^[a-z]+://", ""), F.lit("\\..\\X"))
        key, notes = text.windows_path(p)
        return table(s, d, "pages").select("page_id", key.alias("path_key"), F.array_join(notes, ",").alias("notes"))

    out["path_normalize"] = paths
    out["source_locator"] = lambda s, d: table(s, d, "pages").select("page_id", text.source_locator(F.regexp_replace("url", "^https?:", "x")).alias("locator"), text.source_locator(F.concat(F.when(F.col("page_id") % 2 == 0, "/").otherwise("y//"), F.col("page_id").cast("string"))).alias("absolute"))
    out["evidence_dedupe_sha"] = lambda s, d: evidence.distinct_by_hash(_documents_as_evidence(s, d))
    out["probe_resolve"] = lambda s, d: evidence.resolve_probes(probes(s, d)).select("evidence_id", "decision", F.array_join("parsers", ",").alias("parsers"), "issue")
    def containers(s: SparkSession, d: str) -> DataFrame:
        head = F.lit(b"")
        for n, (offset, magic) in enumerate(evidence.CONTAINERS.values(), 1):
            head = F.when(F.col("doc_id") % 10 == n, F.unhex(F.lit("00" * offset + magic))).otherwise(head)
        return evidence.with_header(_documents_as_evidence(s, d).withColumn("content", F.concat(head, "content"))).select("doc_id", evidence.container_kind(F.col("header")).alias("kind"), F.octet_length("header").cast("long").alias("n"))

    out["container_kind"] = containers
    out["inspect_files"] = lambda s, d: evidence.inspect(_documents_as_evidence(s, d)).select("source_locator", "size", "sha256", "first_bytes")

    def modes(s: SparkSession, d: str, which: int) -> DataFrame:
        e = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("evidence_id"), F.when(F.col("doc_id") % 4 == 0, "snapshot_failed").otherwise("verified_snapshot").alias("status"))
        return evidence.select_mode(e, "suspicious", table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("evidence_id")))[which].select("evidence_id")

    out["evidence_mode_suspicious"] = lambda s, d: modes(s, d, 0)
    out["evidence_mode_unresolved"] = lambda s, d: modes(s, d, 1)
    out["yara_scan"] = byte_scan
    out["yara_size_limit"] = lambda s, d: scan.oversized(_documents_as_evidence(s, d).select(F.col("doc_id").cast("string").alias("evidence_id"), "content"), 5000)
    out["snapshot_byte_limit"] = lambda s, d: evidence.running_bytes(_documents_as_evidence(s, d).select(F.col("source_locator").alias("evidence_id"), "source_locator", "size"), 1_000_000).where("within").agg(F.count("*").alias("n"), F.max("running").alias("running"))
    out["rename_pairing"] = lambda s, d: usn.rename_pairs(table(s, d, "events").select("user_id", "event_id", F.col("user_id").alias("file"), F.col("event_type").alias("reason")), ["user_id"], ["event_id"], "view", "view").select("user_id", "first", "second")

    def hierarchy(s: SparkSession, d: str) -> DataFrame:
        r = table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
        n = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_name").alias("name"))
        c = table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.col("c_name").alias("name"))
        return usn.resolve_paths(r.union(n).union(c))

    out["hierarchy_path"] = hierarchy

    def first_seen(s: SparkSession, d: str) -> DataFrame:
        """Customers named by the status of their first order below a nation that is named by its first customer's segment."""
        o = table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), (F.col("o_custkey") % 25).cast("string")).alias("parent"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").cast("long").alias("seen"))
        c = table(s, d, "customer").select(F.concat(F.lit("n"), (F.col("c_custkey") % 25).cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").cast("long").alias("seen"))
        return usn.resolve_paths(o.union(c), order="seen")

    out["first_seen_path"] = first_seen
    renames = lambda s, d: table(s, d, "events").select("user_id", "event_id", F.lit(1).alias("file"), "event_type", F.when(F.col("event_id") % 5 > 0, F.col("props")).alias("name"), F.floor(F.col("value")).alias("usn"))
    out["rename_distance"] = lambda s, d: usn.rename_pairs(renames(s, d), ["user_id"], ["event_id"], "view", "click", "file", "event_type", "name", "usn", 20).select("user_id", "first", "second")
    snap = lambda s, d: _documents_as_evidence(s, d).select("doc_id", "source_locator", "size", "sha256")
    out["snapshot_verify"] = lambda s, d: evidence.verify_snapshot(snap(s, d), snap(s, d).where("doc_id % 13 <> 0").select("source_locator", (F.col("size") + (F.col("doc_id") % 7 == 0).cast("int")).alias("size"), F.when(F.col("doc_id") % 5 == 0, F.sha2(F.col("sha256"), 256)).otherwise(F.col("sha256")).alias("sha256")))

    def filetimes(s: SparkSession, d: str) -> DataFrame:
        ticks = (F.col("l_orderkey").cast("long") * 1_234_567 + F.lit(133_000_000_000_000_000) + F.col("l_linenumber")).alias("ticks")
        rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", ticks).distinct()
        return rows.select("l_orderkey", "l_linenumber", times.utc_text(times.filetime_seconds(F.col("ticks")), times.filetime_nanos(F.col("ticks"))).alias("instant"))

    out["filetime_convert"] = filetimes
    out["parse_links"] = lambda s, d: parsed(s, d, link_bytes, "orders", "o_orderkey").select("source_locator", "event_type", "time_kind", "time_value", "event_ordinal")
    out["parse_journal"] = lambda s, d: parsed(s, d, journal_bytes, "customer", "c_custkey").select("source_locator", "path", "time_value", "reason_flags")
    out["flags_decode"] = lambda s, d: table(s, d, "orders").select("o_orderkey", F.array_join(text.flag_names(F.col("o_orderkey").cast("long"), FLAGS), "|").alias("names"), text.unknown_bits(F.col("o_orderkey").cast("long"), FLAGS).alias("unknown"))
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, (source, where) in SINGLE.items():
        r = sigma.compile_rule(source)
        out[name] = f"WITH {EV} SELECT id AS event_id, {sql_match_id(r.rule_id, r.sha256, ['id'])} AS match_id, '{r.rule_id}' AS rule_id FROM ev WHERE {where}"
    counts = " UNION ALL ".join(f"SELECT '{sigma.compile_rule(source).rule_id}' AS rule_id, count(*) AS n FROM ev WHERE {where} HAVING count(*) > 0" for source, where in SINGLE.values())
    out["sigma_multi_rule_single_pass"] = f"WITH {EV} {counts}"
    for name, (_, where) in PREDICATES.items():
        out[name] = f"WITH {EV} SELECT id AS event_id FROM ev WHERE {where}"
    out |= SEQUENCE_SQL
    out["timeline_order"] = f"WITH {EV}, {MIXED} SELECT id AS event_id, g AS time_group, row_number() OVER (ORDER BY g, CASE WHEN g IN (1, 4) THEN tt WHEN g = 3 THEN date_trunc('second', ts) END NULLS LAST, id) AS place FROM mx"
    out["timeline_summary"] = f"WITH {EV}, {MIXED} SELECT g AS time_group, count(*) AS n FROM mx GROUP BY g"
    out["timeline_filter"] = f"WITH {EV} SELECT id AS event_id, host AS hostname, et AS event_type FROM ev WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-06 12:00:00' AND et IN ('view', 'error') AND host IN ('HOST1', 'HOST2', 'HOST3')"
    body = "coalesce(text, '')"
    evid = sql_id("evidence", lp("'CHRONOSPARK-EVIDENCE-ID-V1'"), lp("'docs/' || CAST(doc_id AS VARCHAR) || '.txt'"), lp(f"CAST(octet_length(encode({body})) AS VARCHAR)"), lp(f"sha256({body})"))
    art = sql_id("artifact", lp("e"), lp("'text'"), lp("'plain'"), lp("'1.0.0'"))
    evt = sql_id("event", *map(lp, ("'CHRONOSPARK-EVENT-ID-V1'", "'1.0.0'", "e", "a", "'plain'", "'1.0.0'", """'{"type":"source_ordinal","value":0}'""", "'0'", "'document'", "'observed'", """'{"type":"unknown"}'""", "'0'")))
    out["ids_evidence_artifact_event"] = f"SELECT doc_id, e AS evidence_id, a AS artifact_id, {evt} AS event_id FROM (SELECT *, {art} AS a FROM (SELECT doc_id, {evid} AS e FROM documents))"
    out["id_case"] = f"SELECT part, 'tf-case-v1:' || sha256(unhex(string_agg(hex({lp('e')}), '' ORDER BY e))) AS case_id FROM (SELECT DISTINCT doc_id % 100 AS part, {evid} AS e FROM documents) GROUP BY part"
    r = sigma.compile_rule(SINGLE["sigma_all_of_them"][0])
    fid = sql_id("finding", lp("'sigma'"), lp("'1'"), lp(f"'{r.sha256}'"), lp("'1'"), lp("id"), lp("'1'"), lp("evd"))
    out["finding_single"] = f"WITH {EV} SELECT {fid} AS finding_id, 'Sigma match: {r.rule_id}' AS title, 'medium' AS severity, 'medium' AS confidence_level, {sql_match_id(r.rule_id, r.sha256, ['id'])} AS match_id FROM ev WHERE {SINGLE['sigma_all_of_them'][1]}"
    out["finding_merge"] = f"""WITH {EV}, m AS (SELECT id, evd, 1 AS r FROM ev WHERE {SINGLE['sigma_exact'][1]} UNION ALL SELECT id, evd, 2 FROM ev WHERE {SINGLE['sigma_one_of_wildcard'][1]})
SELECT 'Two users' AS title, 'critical' AS severity, count(DISTINCT id) AS n_events, count(*) AS n_matches, array_to_string(list_sort(list(DISTINCT evd)), ',') AS evidence_ids FROM m HAVING count(*) > 0
UNION ALL SELECT 'Sigma match: {r.rule_id}', 'medium', 1, 1, evd FROM ev WHERE {SINGLE['sigma_all_of_them'][1]}"""
    out["finding_lossless"] = f"WITH {EV} SELECT CAST(0 AS BIGINT) AS n_lost, count(*) AS n_without_singles FROM ev WHERE {SINGLE['sigma_all_of_them'][1]}"
    out["attack_lookup"] = f"WITH {EV}, t AS (SELECT CASE right(usr, 1) WHEN '1' THEN 'T1059.001' WHEN '2' THEN 'T1003' ELSE 'T9999' END AS technique_id FROM ev) SELECT technique_id, CASE technique_id WHEN 'T1059.001' THEN 'execution' WHEN 'T1003' THEN 'credential-access' END AS tactic, technique_id <> 'T9999' AS known, count(*) AS n FROM t GROUP BY technique_id"
    cell = lambda c: f"""CASE WHEN regexp_matches(g_{c}, '[,"\r\n]') THEN '"' || replace(g_{c}, '"', '""') || '"' ELSE g_{c} END"""
    parts = {"Sigma": ("sigma_exact", "sigma_all_of_them"), "Correlation": ("corr_seq2_user",)}
    counted = [f"SELECT '{engine}' AS engine, {' + '.join(f'(SELECT count(*) FROM ({out[n]}))' for n in names)} AS n" for engine, names in parts.items()]
    hits = "SELECT 'YARA-X', (SELECT count(*) FROM ({}))"
    out["case_lines"] = f"""WITH {EV} SELECT 0 AS section, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS k, 'case' AS record_type UNION ALL SELECT 1, count(*), 0, 'evidence' FROM documents
UNION ALL SELECT 3, count(*), CAST(sum(k) AS BIGINT), 'event' FROM ev UNION ALL SELECT 4, count(*), 0, 'issue' FROM documents WHERE octet_length(encode({body})) < 100 HAVING count(*) > 0 UNION ALL SELECT 7, 1, 0, 'manifest'"""
    out["csv_guard"] = f"""WITH {EV}, v AS (SELECT id, u % 4 IN (0, 2) AS guarded, CASE u % 4 WHEN 0 THEN message WHEN 1 THEN substr(message, 2) WHEN 2 THEN '  -' || substr(message, 2) END AS t FROM ev),
g AS (SELECT id, guarded, CASE WHEN guarded THEN '''' || t ELSE coalesce(t, '') END AS g_message FROM v) SELECT id AS event_id, {cell('message')} AS cell, guarded FROM g"""
    when = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
    out["csv_rows"] = f"""WITH {EV}, g AS (SELECT *, '''' || message AS g_message FROM ev) SELECT id AS event_id, id || ',' || {when} || ',event_logged,evtx,' || et || ',observed,' || coalesce(host, '') || ',' || usr || ',' || path || ',,' || {cell('message')} AS line, CAST(1 AS BIGINT) AS guarded FROM g"""
    esc = "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    out["html_escape"] = f"SELECT page_id, md5({esc}) AS escaped_md5, md5(replace(replace({esc}, '\"', '&quot;'), '''', '&#39;')) AS attribute_md5 FROM pages"
    controls = "coalesce(text, '') || chr(27) || '[0m' || chr(7) || chr(127)"
    for i in [*range(1, 9), *range(11, 32)]:
        controls = f"replace({controls}, chr({i}), '^{'' if i == 0 else chr(i + 64)}')"
    controls = f"replace({controls}, chr(127), '^?')"
    for i in range(128, 160):
        controls = f"replace({controls}, chr({i}), '\\u{i:04x}')"
    out["control_escape"] = f"SELECT doc_id, md5({controls}) AS escaped_md5 FROM documents"
    out["timesketch_rows"] = f"WITH {EV}, {MIXED} SELECT id AS event_id, strftime(tt, '%Y-%m-%dT%H:%M:%S') AS datetime, epoch_us(tt) AS timestamp FROM mx WHERE g = 1"
    out["timesketch_excluded"] = f"WITH {EV}, {MIXED} SELECT CASE g WHEN 3 THEN 'local time without a definite instant' WHEN 4 THEN 'range' ELSE 'unknown time' END AS reason, count(*) AS n FROM mx WHERE g > 1 GROUP BY g"
    out["manifest_counts"] = "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'evidence', count(*) FROM documents UNION ALL SELECT 'issues', count(*) FROM labels"
    # Whole components of the URL behind its scheme; the last one is popped.
    parts = "list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda p: p <> '')"
    joined = f"'C:\\A\\' || array_to_string(list_append(({parts})[1:-2], 'X'), '\\')"
    out["path_normalize"] = f"SELECT page_id, lower({joined}) AS path_key, 'forward_slash_converted,dot_component_removed,parent_component_resolved,comparison_key_case_folded' AS notes FROM pages"
    out["source_locator"] = "SELECT page_id, rtrim(regexp_replace(regexp_replace(url, '^https?:', 'x'), '/+', '/', 'g'), '/') AS locator, CASE WHEN page_id % 2 <> 0 THEN 'y/' || CAST(page_id AS VARCHAR) END AS absolute FROM pages"
    out["evidence_dedupe_sha"] = f"SELECT sha256({body}) AS sha256, min('docs/' || CAST(doc_id AS VARCHAR) || '.txt') AS source_locator, count(*) AS copies FROM documents GROUP BY 1"
    out["probe_resolve"] = """WITH p AS (SELECT doc_id AS n, doc_id % 2 = 0 AS a, doc_id % 3 = 0 AS r, doc_id % 5 = 0 AND doc_id % 11 <> 0 AS l, doc_id % 11 = 0 AS bad, doc_id % 7 = 0 AS q FROM documents),
s AS (SELECT *, CAST(a AS INT) + CAST(r AS INT) + CAST(l AS INT) AS c FROM p)
SELECT CAST(n AS VARCHAR) AS evidence_id, CASE WHEN bad THEN 'skip' WHEN c = 1 OR (a AND r AND NOT l) THEN 'run' WHEN c > 1 THEN 'skip' WHEN q THEN 'run_probable' ELSE 'none' END AS decision,
CASE WHEN bad THEN '' WHEN a AND r AND NOT l THEN 'amcache,registry' WHEN c = 1 THEN CASE WHEN a THEN 'amcache' WHEN r THEN 'registry' ELSE 'lnk' END WHEN c = 0 AND q THEN 'amcache,lnk,registry' ELSE '' END AS parsers,
CASE WHEN bad THEN 'TF-W-PROBE-MALFORMED' WHEN c > 1 AND NOT (a AND r AND NOT l) THEN 'TF-W-PROBE-AMBIGUOUS' WHEN c = 0 AND q THEN 'TF-W-PROBE-PROBABLE-ONLY' END AS issue FROM s"""
    kinds = " ".join(f"WHEN {k + 1} THEN '{name}'" for k, name in enumerate(evidence.CONTAINERS))
    longer = " ".join(f"WHEN {k + 1} THEN {offset + len(magic) // 2}" for k, (offset, magic) in enumerate(evidence.CONTAINERS.values()))
    out["container_kind"] = f"SELECT doc_id, CASE doc_id % 10 {kinds} END AS kind, least(512, octet_length(encode({body})) + CASE doc_id % 10 {longer} ELSE 0 END) AS n FROM documents"
    out["inspect_files"] = f"SELECT 'docs/' || CAST(doc_id AS VARCHAR) || '.txt' AS source_locator, octet_length(encode({body})) AS size, sha256({body}) AS sha256, lower(substr(hex(encode({body})), 1, 16)) AS first_bytes FROM documents"
    out["evidence_mode_suspicious"] = "SELECT CAST(doc_id AS VARCHAR) AS evidence_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
    out["evidence_mode_unresolved"] = "SELECT CAST(doc_id AS VARCHAR) AS evidence_id FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0)"
    out["yara_scan"] = f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS e, {body} AS t FROM documents), x AS (SELECT e, contains(lower(t), 'licensed under') AS lic, regexp_matches(t, 'token = "[0-9a-f]{{8}}') AS tok, contains(t, 'the ') AS a, regexp_matches(t, '(?s)and.') AS b, regexp_matches(t, '(?:^|[^0-9A-Za-z])zzz(?:[^0-9A-Za-z]|$)') AS c, octet_length(encode(t)) AS z FROM d)
SELECT e AS evidence_id, 'license_or_token' AS rule_id, concat_ws(',', CASE WHEN lic THEN '$lic' END, CASE WHEN tok THEN '$tok' END) AS matched FROM x WHERE lic OR tok
UNION ALL SELECT e, 'two_of_three', concat_ws(',', CASE WHEN a THEN '$a' END, CASE WHEN b THEN '$b' END, CASE WHEN c THEN '$c' END) FROM x WHERE CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) >= 2 AND z < 2048"""
    out["findings_union"] = f"SELECT engine, n, n AS n_findings FROM ({' UNION ALL '.join([*counted, hits.format(out['yara_scan'])])}) WHERE n > 0"
    out["yara_size_limit"] = f"SELECT CAST(doc_id AS VARCHAR) AS evidence_id, octet_length(encode({body})) AS size, 'TF-W-LIMIT-YARA-FILE-SIZE' AS code FROM documents WHERE octet_length(encode({body})) > 5000"
    out["snapshot_byte_limit"] = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY 'docs/' || CAST(doc_id AS VARCHAR) || '.txt') AS i, octet_length(encode({body})) AS z FROM documents),
f(i, n, t) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT d.i, n + CASE WHEN t + z <= 1000000 THEN 1 ELSE 0 END, t + CASE WHEN t + z <= 1000000 THEN z ELSE 0 END FROM f JOIN d ON d.i = f.i + 1)
SELECT n, t AS running FROM f ORDER BY i DESC LIMIT 1"""
    out["rename_pairing"] = """WITH s AS (SELECT user_id, event_id, event_type, lead(event_id) OVER w AS nx, event_type = 'view' AND coalesce(lead(event_type) OVER w = 'view', false) AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, p ORDER BY event_id) AS g FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY user_id, p, g ORDER BY event_id) AS k FROM i)
SELECT user_id, event_id AS first, nx AS second FROM o WHERE p AND k % 2 = 1"""
    out["hierarchy_path"] = r"""SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, r_name AS path, true AS complete FROM region UNION ALL
SELECT 'n' || CAST(n_nationkey AS VARCHAR), r_name || '\' || n_name, true FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
SELECT 'c' || CAST(c_custkey AS VARCHAR), r_name || '\' || n_name || '\' || c_name, true FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
    out["first_seen_path"] = r"""WITH c AS (SELECT o_custkey AS k, arg_min(o_orderstatus || CAST(o_orderkey AS VARCHAR), o_orderkey) AS nm FROM orders GROUP BY 1), n AS (SELECT c_custkey % 25 AS k, arg_min(c_mktsegment, c_custkey) AS nm FROM customer GROUP BY 1)
SELECT 'n' || CAST(k AS VARCHAR) AS id, nm AS path, true AS complete FROM n UNION ALL SELECT 'c' || CAST(c.k AS VARCHAR), n.nm || '\' || c.nm, true FROM c JOIN n ON c.k % 25 = n.k"""
    out["rename_distance"] = """SELECT user_id, event_id AS first, nx AS second FROM (SELECT user_id, event_id, event_type, event_id % 5 > 0 AS named, floor(value) AS u, lead(event_id) OVER w AS nx, lead(event_type) OVER w AS t2, lead(floor(value)) OVER w AS u2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
WHERE event_type = 'view' AND t2 = 'click' AND named AND nx % 5 > 0 AND abs(u2 - u) <= 20"""
    out["snapshot_verify"] = "SELECT l AS source_locator, CASE WHEN i IS NULL THEN 'verified_snapshot' ELSE 'snapshot_failed' END AS status, i AS issue FROM (SELECT 'docs/' || CAST(doc_id AS VARCHAR) || '.txt' AS l, CASE WHEN doc_id % 13 = 0 THEN 'TF-W-SNAPSHOT-MISSING' WHEN doc_id % 7 = 0 THEN 'TF-W-SNAPSHOT-SIZE' WHEN doc_id % 5 = 0 THEN 'TF-W-SNAPSHOT-HASH' END AS i FROM documents)"
    out["filetime_convert"] = """WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey * 1234567 + 133000000000000000 + l_linenumber AS k FROM lineitem), f AS (SELECT *, k % 10000000 * 100 AS ns, make_timestamp((k // 10000000 - 11644473600) * 1000000) AS tt FROM t)
SELECT l_orderkey, l_linenumber, strftime(tt, '%Y-%m-%dT%H:%M:%S') || CASE WHEN ns = 0 THEN '' WHEN ns % 1000000 = 0 THEN '.' || lpad(CAST(ns // 1000000 AS VARCHAR), 3, '0') WHEN ns % 1000 = 0 THEN '.' || lpad(CAST(ns // 1000 AS VARCHAR), 6, '0') ELSE '.' || lpad(CAST(ns AS VARCHAR), 9, '0') END || 'Z' AS instant FROM f"""
    moment = lambda k: f"strftime(make_timestamp(({k} // 10000000 - 11644473600) * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {k} % 10000000 = 0 THEN '' ELSE '.' || lpad(CAST({k} % 10000000 * 100 AS VARCHAR), 9, '0') END || 'Z'"
    links = " UNION ALL ".join(f"SELECT CAST(o_orderkey AS VARCHAR) AS source_locator, 'lnk_timestamp' AS event_type, '{kind}' AS time_kind, {moment(f'(133000000000000000 + CAST(o_orderkey AS BIGINT) * 10000000 + {i})')} AS time_value, '\"{field}\"' AS event_ordinal FROM orders WHERE o_orderkey % {i + 2} = 0" for i, (kind, field) in enumerate((("created", "creation"), ("accessed", "access"), ("modified", "write"))))
    out["parse_links"] = f"{links} UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'lnk_timestamp', 'observed', NULL, '\"none\"' FROM orders WHERE o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0"
    out["parse_journal"] = f"""SELECT CAST(c_custkey AS VARCHAR) AS source_locator, replace(x.p, '#', CAST(c_custkey AS VARCHAR)) AS path, {moment('(133000000000000000 + CAST(c_custkey AS BIGINT) * 10000000)')} AS time_value, x.f AS reason_flags FROM customer CROSS JOIN (VALUES ('dir#', '["FILE_CREATE"]'), ('dir#\\old', '["RENAME_OLD_NAME"]'), ('dir#\\other', '["DATA_EXTEND","CLOSE"]')) x(p, f)"""
    names = ", ".join(f"CASE WHEN o_orderkey & {bit} <> 0 THEN '{name}' END" for bit, name in FLAGS.items())
    out["flags_decode"] = f"SELECT o_orderkey, concat_ws('|', {names}) AS names, CAST(o_orderkey AS BIGINT) & {~sum(FLAGS)} AS unknown FROM orders"
    return out

