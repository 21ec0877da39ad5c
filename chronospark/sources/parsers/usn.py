"""Change journal ($J) records of versions 2, 3 and 4: one event for each named record, rename pairs combined."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from .base import BAD_LENGTH, BAD_VERSION, TRUNCATED, VERSION, Context, byte_range, instant, unknown

MAX_RECORD, MAX_RECORDS, MAX_BYTES, MAX_DEPTH = 64 * 1024, 5_000_000, 256 << 20, 32
FIXED = {2: 60, 3: 76, 4: 84}
SPEC = "[MS-FSCC] USN_RECORD"
# Reason bits.
REASONS = {0x1: "DATA_OVERWRITE", 0x2: "DATA_EXTEND", 0x4: "DATA_TRUNCATION", 0x10: "NAMED_DATA_OVERWRITE", 0x20: "NAMED_DATA_EXTEND", 0x40: "NAMED_DATA_TRUNCATION", 0x100: "FILE_CREATE", 0x200: "FILE_DELETE", 0x400: "EA_CHANGE", 0x800: "SECURITY_CHANGE", 0x1000: "RENAME_OLD_NAME", 0x2000: "RENAME_NEW_NAME", 0x4000: "INDEXABLE_CHANGE", 0x8000: "BASIC_INFO_CHANGE", 0x10000: "HARD_LINK_CHANGE", 0x20000: "COMPRESSION_CHANGE", 0x40000: "ENCRYPTION_CHANGE", 0x80000: "OBJECT_ID_CHANGE", 0x100000: "REPARSE_POINT_CHANGE", 0x200000: "STREAM_CHANGE", 0x400000: "TRANSACTED_CHANGE", 0x800000: "INTEGRITY_CHANGE", 0x1000000: "DESIRED_STORAGE_CLASS_CHANGE", 0x80000000: "CLOSE"}
OLD, NEW = 0x1000, 0x2000


@dataclass
class Record:
    offset: int
    length: int
    version: int
    minor: int
    file: str
    parent: str
    usn: int
    time: int
    reason: int
    source: int
    security: int = 0
    attributes: int = 0
    name: str | None = None
    extents: dict | None = None


def probe(data: bytes, locator: str) -> str:
    if len(data) < 8:
        return "not_this_format"
    length, major = struct.unpack_from("<IH", data)
    if major not in FIXED or length % 8 or not FIXED[major] <= length <= MAX_RECORD:
        return "not_this_format"
    return "confirmed" if length <= len(data) else "probable"


def record(data: bytes, at: int, length: int, major: int, minor: int) -> Record:
    body = data[at : at + length]
    if major == 2:
        file, parent, at2 = (f"v2:{x:016x}" for x in struct.unpack_from("<QQ", body, 8)), None, 24
        file, parent = tuple(file)
    else:
        file, parent, at2 = f"v3v4:{body[8:24].hex()}", f"v3v4:{body[24:40].hex()}", 40
    usn, time, reason, source = struct.unpack_from("<qQII", body, at2) if major != 4 else (struct.unpack_from("<q", body, 40)[0], *struct.unpack_from("<QII", body, 48))
    out = Record(at, length, major, minor, file, parent, usn, time, reason, source)
    if major == 4:
        remaining, number, location, size = struct.unpack_from("<HHQQ", body, 64)
        out.extents = {"remaining_extents": remaining, "number_of_extents": number, "extent_location": location, "extent_length": size}
        return out
    out.security, out.attributes, n, offset = struct.unpack_from("<IIHH", body, at2 + 24)
    if n:
        if offset < FIXED[major] or offset + n > length:
            raise ValueError(f"name at {offset}, {n} bytes, in a record of {length}")
        out.name = body[offset : offset + n].decode("utf-16-le", errors="replace").rstrip("\0")
    return out


def records(data: bytes, context: Context) -> list[Record]:
    out, at = [], 0
    while at + 8 <= len(data) and len(out) < MAX_RECORDS and at <= MAX_BYTES:
        length, major, minor = struct.unpack_from("<IHH", data, at)
        if length == 0:
            break
        if length < 8 or length > MAX_RECORD or length % 8:
            context.issue(BAD_LENGTH, f"record of {length} bytes at {at}")
            break
        if at + length > len(data):
            context.issue(TRUNCATED, f"record of {length} bytes at {at}")
            break
        if major not in FIXED:
            context.issue(BAD_VERSION, f"version {major} at {at}")
        elif length < FIXED[major]:
            context.issue(BAD_LENGTH, f"record of {length} bytes at {at}")
        else:
            try:
                out.append(record(data, at, length, major, minor))
            except ValueError as e:
                context.issue(BAD_LENGTH, str(e))
        at += length
    return out


def path_of(r: Record, names: dict[str, tuple[str, str]]) -> str:
    parts, seen, up = [r.name or ""], set(), r.parent
    for _ in range(MAX_DEPTH):
        if up in seen or up not in names:
            break
        seen.add(up)
        name, up = names[up]
        parts.append(name)
    return "\\".join(reversed(parts))


def pairs(found: list[Record]) -> list[tuple[Record, Record | None]]:
    """Records in order; an old name and the new name right behind it are one observation."""
    out, at = [], 0
    while at < len(found):
        a = found[at]
        b = found[at + 1] if at + 1 < len(found) else None
        if b and a.reason & OLD and b.reason & NEW and a.name and b.name and a.file == b.file and abs(b.usn - a.usn) <= 1:
            out.append((a, b))
            at += 2
        else:
            out.append((a, None))
            at += 1
    return out


def parse(data: bytes, context: Context) -> None:
    found = records(data, context)
    names: dict[str, tuple[str, str]] = {}
    for r in found:
        if r.name:
            names.setdefault(r.file, (r.name, r.parent))
    ordinal = 0
    for r, new in pairs(found):
        if r.name is None:
            continue
        flags = [n for b, n in REASONS.items() if r.reason & b]
        a = {"usn.major_version": r.version, "usn.minor_version": r.minor, "usn.usn": r.usn, "usn.reason": r.reason, "usn.reason_flags": flags, "usn.file_reference": r.file, "usn.parent_reference": r.parent, "usn.source_info": r.source, "usn.security_id": r.security, "usn.file_attributes": r.attributes, "usn.record_offset": r.offset, "usn.record_length": r.length, "usn.reference_spec": SPEC, "usn.parser_version": VERSION}
        if rest := r.reason & ~sum(REASONS):
            a["usn.reason_unknown_bits"] = rest
        if r.version == 2:
            raw = int(r.file[3:], 16)
            a |= {"usn.file_reference_mft_number": raw & (1 << 48) - 1, "usn.file_reference_sequence": raw >> 48}
        if new:
            a |= {"usn.rename.combined": True, "usn.rename.old_name": r.name, "usn.rename.new_name": new.name, "usn.rename.old_usn": r.usn, "usn.rename.new_usn": new.usn}
        time = instant(r.time, "event_logged", f"FILETIME({r.time})") if r.time else unknown("event_logged")
        context.event(time, "usn_journal", "usn_change_observed", f"USN {'|'.join(flags)}: {r.name}", a, byte_range(r.offset, r.offset + r.length), ordinal, ordinal, path_of(r, names))
        ordinal += 1
