"""Event logs (EVTX): chunks of records whose content is binary XML."""

from __future__ import annotations

import struct
import zlib
from typing import Any

from .base import MALFORMED, MISSING, TRUNCATED, VERSION, Context, byte_range, instant
from .binxml import BinXmlError, content

HEADER, CHUNK, FIRST = 4096, 65_536, 512
# Event numbers with a type of their own, where they come from, and data of which one must be there.
TYPES = {4624: "login", 4625: "login_failure", 4688: "process_start", 4689: "process_stop", 7045: "service_create"}
ORIGIN = {7045: ("system", "service control manager")}
REQUIRED = {4624: ("TargetUserName", "SubjectUserName"), 4625: ("TargetUserName", "SubjectUserName"), 4688: ("NewProcessName", "ProcessName"), 4689: ("ProcessName", "NewProcessName"), 7045: ("ServiceName", "ImagePath")}


def probe(data: bytes, locator: str) -> str:
    if data[:8] != b"ElfFile\0":
        return "not_this_format"
    return "confirmed" if len(data) >= HEADER else "malformed"


def first(data: dict[str, Any], *names: str) -> Any:
    """The first of the names that has text, whatever the case of its letters."""
    lower = {k.lower(): v for k, v in reversed(data.items()) if isinstance(v, str)}
    return next((lower[n.lower()] for n in names if n.lower() in lower), None)


def number(data: dict[str, Any], *names: str) -> int | None:
    lower = {k.lower(): v for k, v in data.items()}
    for n in names:
        v = lower.get(n.lower())
        try:
            v = int(v, 0) if isinstance(v, str) else v
        except ValueError:
            continue
        if isinstance(v, int) and v >= 0:
            return v
    return None


def event_type(c: dict) -> str:
    """A typed event needs its channel, its provider and its data together."""
    kind = TYPES.get(c["event_id"])
    origin = ORIGIN.get(c["event_id"], ("security", "microsoft-windows-security-auditing"))
    if kind and (str(c["channel"]).lower(), str(c["provider"]).lower()) == origin and any(k.lower() in {n.lower() for n in REQUIRED[c["event_id"]]} for k in c["data"]):
        return kind
    return "event_logged"


def parse(data: bytes, context: Context) -> None:
    if probe(data, "") != "confirmed":
        context.issue(MALFORMED, "file header")
        return
    ordinal = 0
    for index, base in enumerate(range(HEADER, len(data), CHUNK)):
        chunk = data[base : base + CHUNK]
        if chunk[:8] != b"ElfChnk\0":
            if chunk.strip(b"\0"):
                context.issue(MALFORMED, f"chunk {index}")
            continue
        if len(chunk) < FIRST:
            context.issue(TRUNCATED, f"chunk {index}")
            continue
        if zlib.crc32(chunk[:120] + chunk[128:512]) != struct.unpack_from("<I", chunk, 124)[0]:
            context.issue(MALFORMED, f"header checksum of chunk {index}")
        at = FIRST
        while at + 24 <= len(chunk):
            if chunk[at : at + 4] != b"**\0\0":
                following = chunk.find(b"**\0\0", at)
                if following < 0:
                    break
                context.issue(MALFORMED, f"record at {base + at}; next at {base + following}")
                at = following
                continue
            size, record, ticks = struct.unpack_from("<IQQ", chunk, at + 4)
            if size < 28 or at + size > len(chunk):
                context.issue(TRUNCATED, f"record of {size} bytes at {base + at}")
                at += 4
                continue
            try:
                c = content(chunk, at + 24, at + size - 4)
            except (BinXmlError, struct.error, ValueError) as e:
                context.issue(MALFORMED, f"content of record {record}: {e}")
                at += size
                continue
            if not record or not ticks or c["event_id"] is None or not c["provider"] or not c["channel"]:
                context.issue(MISSING, f"record {record}")
                at += size
                continue
            kind = event_type(c)
            a = {"evtx.event_record_id": record, "evtx.timestamp_filetime": ticks, "evtx.chunk_index": index, "evtx.record_size": size, "evtx.event_id": c["event_id"], "evtx.channel": c["channel"], "evtx.provider": c["provider"], "evtx.parser_version": VERSION}
            a |= {"evtx.computer": c["computer"]} if c["computer"] else {}
            a |= {"evtx.level": c["level"]} if c["level"] is not None else {}
            a |= {f"evtx.event_data.{k}": v for k, v in c["data"].items()}
            names = {"process_start": ("NewProcessName", "ProcessName", "Image"), "process_stop": ("NewProcessName", "ProcessName", "Image"), "service_create": ("ImagePath",)}.get(kind, ())
            path = first(c["data"], *names)
            process = {"pid": number(c["data"], "NewProcessId", "ProcessId"), "ppid": None, "command_line": first(c["data"], "CommandLine")} if path else None
            context.event(instant(ticks, "event_logged", f"FILETIME({ticks})"), "evtx", kind, f"EVTX {kind}: EventID={c['event_id']} channel={c['channel']} provider={c['provider']}", a, byte_range(base + at, base + at + 2 + size), ordinal, ordinal, path, None, c["computer"], first(c["data"], "TargetUserName", "SubjectUserName", "User"), process)
            ordinal += 1
            at += size
