"""Parsers on synthesised bytes, case files, configuration, streams, commands."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from chronospark import cli, config
from chronospark.operators import timeline
from chronospark.plans import catalog, correlation, sigma
from chronospark.sources import case
from chronospark.sources.parsers import amcache, jump_list, lnk, parse_contents, parse_one, prefetch, registry, usn
from chronospark.sources.parsers.base import filetime_text, windows_path
from chronospark.streaming import rules as streams

TICKS = 133_500_000_000_000_001


def link(flags=0x80, times=(0, 0, TICKS), rest=b"\0\0\0\0"):
    return struct.pack("<I", 76) + lnk.CLSID + struct.pack("<IIQQQIiIHHII", flags, 0x20, *times, 5, 0, 1, 0, 0, 0, 0) + rest


def journal(name, file=7, parent=5, number=1, reason=0x100, version=2, time=TICKS):
    raw = name.encode("utf-16-le")
    if version == 2:
        body = struct.pack("<QQqQIIIIHH", file, parent, number, time, reason, 0, 0, 0x20, len(raw), 60) + raw
    else:
        body = struct.pack("<QQQQqQIIIIHH", file, 0, parent, 0, number, time, reason, 0, 0, 0x20, len(raw), 76) + raw
    size = (8 + len(body) + 7) // 8 * 8
    return (struct.pack("<IHH", size, version, 0) + body).ljust(size, b"\0")


def hive():
    cells, at = bytearray(b"hbin".ljust(32, b"\0")), {}

    def cell(name, body):
        size = (len(body) + 4 + 7) // 8 * 8
        at[name] = len(cells)
        cells.extend(struct.pack("<i", -size) + body.ljust(size - 4, b"\0"))

    def key(name, subkeys=0, sub_list=0xFFFFFFFF, values=0, value_list=0xFFFFFFFF):
        return b"nk" + struct.pack("<HQ", 0x20, TICKS) + struct.pack("<II6I", 0, 0, subkeys, 0, sub_list, 0xFFFFFFFF, values, value_list) + struct.pack("<II", 0, 0) + b"\0" * 20 + struct.pack("<HH", len(name), 0) + name

    def value(name, kind, size, where):
        return b"vk" + struct.pack("<HIIIHH", len(name), size, where, kind, 1, 0) + name

    text = "run.exe\0".encode("utf-16-le")
    cell("data", text)
    cell("v1", value(b"Path", 1, len(text), at["data"]))
    cell("v2", value(b"N", 4, 0x80000004, 42))
    cell("values", struct.pack("<II", at["v1"], at["v2"]))
    cell("child", key(b"Child", values=2, value_list=at["values"]))
    cell("list", b"lf" + struct.pack("<H", 1) + struct.pack("<I4s", at["child"], b"Chil"))
    cell("root", key(b"ROOT", 1, at["list"]))
    return (b"regf" + struct.pack("<II", 1, 1) + b"\0" * 24 + struct.pack("<I", at["root"])).ljust(4096, b"\0") + bytes(cells)


def ran(version=30):
    data = bytearray(400)
    struct.pack_into("<I4s", data, 0, version, b"SCCA")
    data[16:30] = "CMD.EXE".encode("utf-16-le")
    names = "\\A\0\\B\0".encode("utf-16-le")
    struct.pack_into("<III", data, 100, 400, len(names), 400 + len(names))
    at, runs, count = prefetch.LAYOUT[version]
    struct.pack_into("<Q", data, at, TICKS)
    struct.pack_into("<I", data, count, 3)
    device = "\\VOL".encode("utf-16-le")
    return bytes(data) + names + struct.pack("<II", 8, 4) + device


def log(values=("4688", "C:\\w\\cmd.exe", "bob")):
    """One chunk with one record: a template that stands inline, with a literal, attributes and three substitutions."""
    chunk = bytearray(b"ElfChnk\0".ljust(512, b"\0"))
    at = 512 + 24

    def name(text):
        nonlocal body
        here = at + len(body) + 4
        body += struct.pack("<IIHH", here, 0, 0, len(text)) + text.encode("utf-16-le") + b"\0\0"

    def start(text, attributes=()):
        nonlocal body
        body += struct.pack("<BHI", 0x41 if attributes else 1, 0xFFFF, 0)
        name(text)
        body += struct.pack("<I", 0) if attributes else b""
        for k, v in attributes:
            body += b"\x06"
            name(k)
            literal(v)
        body += b"\x02"

    def literal(text):
        nonlocal body
        body += struct.pack("<BBH", 5, 1, len(text)) + text.encode("utf-16-le")

    def leaf(text, value, attributes=()):
        nonlocal body
        start(text, attributes)
        if isinstance(value, int):
            body += struct.pack("<BHB", 0x0D, value, 1)
        else:
            literal(value)
        body += b"\x04"

    body = bytearray(b"\x0f\x01\x01\x00\x0c\x01")
    body += struct.pack("<II", 9, at + len(body) + 8)
    head = len(body)
    body += b"\0" * 24 + b"\x0f\x01\x01\x00"
    start("Event")
    start("System")
    start("Provider", [("Name", "Microsoft-Windows-Security-Auditing")])
    body += b"\x04"
    leaf("EventID", 0)
    leaf("Channel", "Security")
    leaf("Computer", "HOST1")
    body += b"\x04"
    start("EventData")
    leaf("Data", 1, [("Name", "NewProcessName")])
    leaf("Data", 2, [("Name", "SubjectUserName")])
    leaf("Data", "0x1f", [("Name", "NewProcessId")])
    body += b"\x04\x04\x00"
    struct.pack_into("<I", body, head + 20, len(body) - head - 24)
    raw = [v.encode("utf-16-le") for v in values]
    body += struct.pack("<I", len(raw)) + b"".join(struct.pack("<HBB", len(v), 1, 0) for v in raw) + b"".join(raw) + b"\0"
    size = 24 + len(body) + 4
    chunk += b"**\0\0" + struct.pack("<IQQ", size, 5, TICKS) + body + struct.pack("<I", size)
    struct.pack_into("<I", chunk, 124, zlib.crc32(bytes(chunk[:120] + chunk[128:512])))
    return b"ElfFile\0".ljust(4096, b"\0") + bytes(chunk).ljust(65536, b"\0")


def jumps():
    """A compound file with the link stream 1 and a destination list of it and of a missing stream 2."""

    def entry(number, path):
        return b"\0" * 72 + b"HOST".ljust(16, b"\0") + struct.pack("<III", number, 0, 0) + struct.pack("<Qi", TICKS, -1) + struct.pack("<IIQH", 0, 1, 0, len(path)) + path.encode("utf-16-le") + b"\0" * 4

    streams = {"DestList": struct.pack("<I", 3).ljust(32, b"\0") + entry(1, "C:\\a") + entry(2, "C:\\b"), "1": link()}
    mini, mini_fat, places = b"", [], {}
    for n, body in streams.items():
        places[n] = (len(mini_fat), len(body))
        k = -(-len(body) // 64)
        mini_fat += [*range(len(mini_fat) + 1, len(mini_fat) + k), 0xFFFFFFFE]
        mini += body.ljust(64 * k, b"\0")
    k = -(-len(mini) // 512)
    fat = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, *range(4, 3 + k), 0xFFFFFFFE]
    row = lambda n, kind, at, size: (n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(n) + 2, kind)).ljust(116, b"\0") + struct.pack("<IQ", at, size)
    rows = row("Root Entry", 5, 3, len(mini)) + b"".join(row(n, 2, *places[n]) for n in streams)
    head = bytearray(jump_list.MAGIC.ljust(512, b"\0"))
    struct.pack_into("<HH", head, 30, 9, 6)
    struct.pack_into("<I", head, 48, 1)
    struct.pack_into("<5I", head, 56, 4096, 2, 1, 0xFFFFFFFE, 0)
    struct.pack_into("<109I", head, 76, 0, *[0xFFFFFFFF] * 108)
    words = lambda x: struct.pack("<128I", *x, *[0xFFFFFFFF] * (128 - len(x)))
    return bytes(head) + words(fat) + rows.ljust(512, b"\0") + words(mini_fat) + mini.ljust(512 * k, b"\0")


def kinds(rows):
    return [r.get("event_type") or r["issue_code"] for r in rows]


def test_links():
    (row,) = parse_one(link(), "a.lnk")
    assert row["time"]["value"] == filetime_text(TICKS) and row["time"]["value"].endswith("0001Z") is False and row["time"]["kind"] == "modified"
    assert kinds(parse_one(link(times=(0, 0, 0)), "a.lnk")) == ["lnk_timestamp"] and parse_one(link(times=(0, 0, 0)), "a.lnk")[0]["time"]["type"] == "unknown"
    assert len(parse_one(link(times=(1, 2, 3)), "a.lnk")) == 3
    path = b"C:\\x\\y.exe\0"
    info = struct.pack("<7I", 0x1C + len(path) + 1, 0x1C, 1, 0, 0x1C, 0, 0x1C + len(path)) + path + b"\0"
    name = "n".encode("utf-16-le")
    (row,) = parse_one(link(0x80 | 2 | 4, rest=info + struct.pack("<H", 1) + name + struct.pack("<IIxxxx", 12, 0xA0000003) + b"\0" * 4), "a.lnk")
    assert row["path"]["original"] == "C:\\x\\y.exe" and json.loads(row["attributes"]["lnk.name"]) == "n" and json.loads(row["attributes"]["lnk.extra_blocks"])[0]["name"] == "tracker"
    assert kinds(parse_one(link(0x80 | 4, rest=b"\xff\xff"), "a.lnk")) == ["TF-R-PARSER-PARTIAL-BOUNDARY", "lnk_timestamp"]


def test_journal():
    data = journal("dir", 5, 4) + journal("old.txt", number=10, reason=0x1000) + journal("new.txt", number=11, reason=0x2000) + journal("v3", version=3, number=12, time=0) + struct.pack("<IHH", 16, 9, 0) + b"\0" * 8 + struct.pack("<IHH", 7, 2, 0)
    rows = parse_one(data, "j")
    assert kinds(rows) == ["TF-W-PARSER-UNSUPPORTED-VERSION", "TF-W-PARSER-INVALID-LENGTH", *["usn_change_observed"] * 3]
    renamed = rows[3]
    assert renamed["path"]["original"] == "dir\\old.txt" and json.loads(renamed["attributes"]["usn.rename.new_name"]) == "new.txt"
    assert rows[4]["time"]["type"] == "unknown" and rows[4]["attributes"]["usn.file_reference"] == '"v3v4:07' + "0" * 30 + '"'
    looped = [usn.Record(0, 64, 2, 0, "a", "b", 1, 0, 0, 0, name="A"), usn.Record(0, 64, 2, 0, "b", "a", 2, 0, 0, 0, name="B")]
    assert usn.path_of(looped[0], {"a": ("A", "b"), "b": ("B", "a")}) == "B\\A\\A" or usn.path_of(looped[0], {"a": ("A", "b"), "b": ("B", "a")}).endswith("\\A")


def test_hives():
    rows = parse_one(hive(), "x/SOFTWARE")
    assert kinds(rows) == ["registry_key_last_write"] * 2 + ["registry_observation"] * 2
    assert rows[1]["path"]["original"] == "ROOT\\Child" and [json.loads(r["attributes"]["registry.value_data"]) for r in rows[2:]] == ["run.exe", 42]
    assert json.loads(rows[0]["attributes"]["registry.hive_type"]) == "software"
    assert registry.value_of(7, "a\0b\0\0".encode("utf-16-le")) == ["a", "b"] and registry.value_of(5, b"\0\0\0\1") == 1


@pytest.mark.parametrize("version", [17, 23, 26, 30, 31])
def test_prefetch(version):
    (row,) = parse_one(ran(version), "CMD.pf")
    assert row["path"]["original"] == "\\VOL\\CMD.EXE" and json.loads(row["attributes"]["prefetch.run_count"]) == 3 and json.loads(row["attributes"]["prefetch.referenced_files"]) == ["\\A", "\\B"]


def test_logs():
    (row,) = parse_one(log(), "Security.evtx")
    assert (row["event_type"], row["hostname"], row["user"], row["path"]["comparison_key"], row["process"]["pid"]) == ("process_start", "HOST1", "bob", "c:\\w\\cmd.exe", 31)
    assert row["attributes"]["evtx.event_id"] == "4688" and json.loads(row["attributes"]["evtx.event_data.NewProcessId"]) == "0x1f"
    assert kinds(parse_one(log(("9999", "a", "b")), "x")) == ["event_logged"] and kinds(parse_one(log(("x", "a", "b")), "x")) == ["TF-W-PARSER-MISSING-REQUIRED-FIELD"]
    broken = bytearray(log())
    broken[4096 + 512] = 0
    assert kinds(parse_one(bytes(broken), "x")) == []
    broken = bytearray(log())
    broken[4096 + 10] ^= 1
    assert kinds(parse_one(bytes(broken), "x")) == ["TF-W-PARSER-MALFORMED-INPUT", "process_start"]


def test_jump_lists():
    rows = parse_one(jumps(), "d/1b4dd67f29cb1962.automaticDestinations-ms")
    assert kinds(rows) == ["jump_list_observation", "TF-W-PARSER-MISSING-REQUIRED-FIELD"]
    assert rows[0]["path"]["original"] == "C:\\a" and rows[0]["time"]["kind"] == "accessed" and json.loads(rows[0]["attributes"]["jump_list.app_id"]) == "1b4dd67f29cb1962"
    rows = parse_one(b"\0" * 24 + link() + link(times=(0, 0, 0)), "5.customDestinations-ms")
    assert kinds(rows) == ["jump_list_observation"] * 2


def test_inventory_hives():
    data = hive().replace(b"Child", b"File\0", 1)
    rows = parse_one(data.replace(struct.pack("<HH", 5, 0) + b"File\0", struct.pack("<HH", 4, 0) + b"File\0"), "x/Amcache.hve")
    assert kinds(rows).count("amcache_observation") == 1 and kinds(rows).count("registry_observation") == 2
    assert amcache.family(["Root", "InventoryApplicationFile"]) == "win10_inventory" and amcache.family(["x"]) == "unknown"


def test_unpacking():
    # Symbols a, b and a copy of three bytes at distance two: codes 0, 10 and 11 of one, two and two bits.
    table = bytearray(256)
    for symbol, n in ((97, 1), (98, 2), (256 + 16, 2)):
        table[symbol // 2] |= n << 4 * (symbol & 1)
    bits = "0" + "10" + "11" + "0" + "0"
    word = int(bits.ljust(32, "0"), 2)
    assert prefetch.decompress(bytes(table) + struct.pack("<HH", word >> 16, word & 0xFFFF) + b"\0" * 8, 6) == b"ababaa"


@pytest.mark.parametrize("make", [link, lambda: journal("a"), hive, ran, log, jumps])
def test_parsers_survive_any_cut_or_change(make):
    data = make()
    for n in {*range(0, min(len(data), 200), 3), len(data) // 2, len(data) - 1}:
        parse_one(data[:n], "x")
        changed = bytearray(data)
        changed[n] ^= 0xFF
        rows = parse_one(bytes(changed), "x")
        assert all("event_id" in r or "issue_code" in r for r in rows)
    for kind in ("lnk", "usn", "registry", "prefetch", "evtx", "amcache", "jump_list"):
        for bad in (b"", b"\0" * 500, b"\xff" * 500, data[:90]):
            parse_one(bad, "x", kind)


def test_contents_become_events_and_matches(spark):
    files = [("a/x.lnk", link()), ("b/$J", journal("old.txt")), ("c/SYSTEM", hive()), ("d/t.txt", b"text"), ("e/CMD.pf", ran())]
    rows = parse_contents(spark.createDataFrame(files, "source_locator string, content binary"))
    counts = {r["event_type"]: r["count"] for r in rows.groupBy("event_type").count().collect()}
    assert counts == {"lnk_timestamp": 1, "usn_change_observed": 1, "registry_key_last_write": 2, "registry_observation": 2, "prefetch_execution_observed": 1}
    rule = sigma.compile_rule(catalog._rule("reg", "  sel:\n    registry.value_name: path\n    TargetFilename|endswith: child\n  condition: sel\n"))
    assert sigma.match(rows, [rule]).count() == 1
    assert rows.select("event_id").distinct().count() == 7 and timeline.summary(rows).first()["time_group"] == 1


def test_paths_on_the_driver_equal_the_columns(spark):
    from chronospark.functions import text

    for p in ("C:/A/../../b/.\\C", "..\\x", "\\\\srv\\share\\\\f", "", "C:x", "a\\..\\..\\b", "\\a\\..\\..\\b", "C:"):
        key, _ = text.windows_path(F.lit(p))
        assert spark.range(1).select(key).first()[0] == windows_path(p)["comparison_key"], p


def case_lines(spark, tmp_path):
    rows = parse_one(link(), "a.lnk") + parse_one(journal("f"), "j")
    path = tmp_path / "case.jsonl"
    events = []
    for r in rows:
        e = {k: v for k, v in r.items()} | {"attributes": {k: json.loads(v) for k, v in r["attributes"].items()}}
        events.append(e)
    path.write_text("\n\n".join(json.dumps({"record": e, "record_type": "event", "schema_version": "1.2.0"}) for e in events) + "\n")
    (tmp_path / "case.json").write_text(json.dumps({"schema_version": "1.0.0", "case": {"case_id": "c"}, "events": events, "matches": []}, indent=1))
    return str(path), events


def test_case_files(spark, tmp_path):
    path, events = case_lines(spark, tmp_path)
    for tables in (case.read_jsonl(spark, path), case.read_json(spark, path[:-1])):
        got = {r["event_id"]: r["attributes"] for r in tables["event"].collect()}
        assert {k: {n: json.loads(x) for n, x in v.items()} for k, v in got.items()} == {e["event_id"]: e["attributes"] for e in events}
        assert tables["match"].count() == 0
    (tmp_path / "bad.jsonl").write_text('{"record":{},"record_type":"nonsense","schema_version":"1.0.0"}\n')
    with pytest.raises(Exception, match="bad record"):
        case.checked(case.lines(spark, str(tmp_path / "bad.jsonl"))).select("record").collect()
    with pytest.raises(case.CaseError):
        case.check_version("2.0.0")


def test_configuration():
    assert config.load('[limits]\nmax_files = 5\n[analysis]\ntimezone = "Asia/Tokyo"')["limits"]["max_files"] == 5
    for bad in ("[limits]\nmax_files = 0", "[nope]\na = 1", '[analysis]\nsnapshot_mode = "never"', '[analysis]\ntimezone = "Mars/X"', "[", '[limits]\nmax_files = "1"'):
        with pytest.raises(config.ConfigError):
            config.load(bad)


def test_streams_equal_batches(spark, small, tmp_path):
    rule = correlation.compile_rule(catalog.UNSURE)
    single = [sigma.compile_rule(catalog.SINGLE["sigma_glob"][0])]
    events = catalog.event_rows(spark, small).withColumn("ts", F.timestamp_micros(F.col("sec") * 1_000_000 + F.floor(F.col("nano") / 1000)))
    events.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, stream, batch in (("single", streams.match_stream(live, single), sigma.match(events, single)), ("pairs", streams.sequence_stream(live, rule), correlation.match(events, rule))):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        got = {r["match_id"] for r in spark.table(name).collect()}
        assert got and got == {r["match_id"] for r in batch.collect()}


def test_commands(spark, tmp_path, capsys):
    path, _ = case_lines(spark, tmp_path)
    rules = tmp_path / "rules"
    rules.mkdir()
    (rules / "a.yml").write_text(catalog._rule("any", "  sel:\n    lnk.file_size: 5\n  condition: sel\n"))
    assert cli.run(["version"]) == 0 and cli.run(["rules", str(rules)]) == 0
    (rules / "b.yml").write_text("title: [")
    assert cli.run(["rules", str(rules)]) == cli.EXIT["rules"]
    capsys.readouterr()
    assert cli.run(["timeline", path, "--from", "2000-01-01T00:00:00Z"], spark) == 0 and capsys.readouterr().out.count("\n") == 2
    assert cli.run(["sigma", path, "--rules", str(rules)], spark) == cli.EXIT["rules"] and capsys.readouterr().out.count("match_id") == 1
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.lnk").write_bytes(link())
    assert cli.run(["inspect", str(files)], spark) == 0 and '"kind":"lnk"' in capsys.readouterr().out
    assert cli.run(["analyze", str(files), "--rules", str(rules), "--output", str(tmp_path / "out")], spark) == cli.EXIT["rules"]
    assert spark.read.json(str(tmp_path / "out" / "findings")).count() == 1
    assert cli.run(["export", path, "--format", "timesketch", "--output", str(tmp_path / "ts")], spark) == 0
    assert cli.worse("partial", "rules") == "rules"
