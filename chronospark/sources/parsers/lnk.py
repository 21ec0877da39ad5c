"""Shell links: header times, target path, strings and extra blocks."""

from __future__ import annotations

import struct

from .base import BOUNDARY, MALFORMED, VERSION, Context, byte_range, instant, unknown

HEADER = 76
CLSID = bytes.fromhex("0114020000000000C000000000000046")
# Names of link flags and file attributes by bit.
FLAGS = {0: "has_link_target_idlist", 1: "has_link_info", 2: "has_name", 3: "has_relative_path", 4: "has_working_dir", 5: "has_arguments", 6: "has_icon_location", 7: "is_unicode", 8: "force_no_link_info", 19: "enable_target_metadata"}
ATTRIBUTES = {0: "readonly", 1: "hidden", 2: "system", 4: "directory", 5: "archive", 7: "normal", 8: "temporary", 9: "sparse_file", 10: "reparse_point", 11: "compressed", 12: "offline", 13: "not_content_indexed", 14: "encrypted"}
SHOW = {1: "normal", 3: "maximized", 7: "min_no_active"}
BLOCKS = {0xA0000001: "environment_variable", 0xA0000002: "console", 0xA0000003: "tracker", 0xA0000004: "console_fe", 0xA0000005: "special_folder", 0xA0000006: "darwin", 0xA0000007: "icon_environment", 0xA0000008: "shim", 0xA0000009: "property_store", 0xA000000B: "known_folder", 0xA000000C: "vista_and_above_idlist"}
STRINGS = ((2, "name"), (3, "relative_path"), (4, "working_dir"), (5, "arguments"), (6, "icon_location"))
SPEC = "[MS-SHLLINK] v10.0"


class Cut(Exception):
    """A block that ends beyond the file or contradicts its length."""


def probe(data: bytes, locator: str) -> str:
    if data[4:20] != CLSID or len(data) < HEADER:
        return "not_this_format" if data[4:20] != CLSID else "malformed"
    return "confirmed" if data[:4] == b"\x4c\0\0\0" else "malformed"


def _text(data: bytes) -> str:
    return data.decode("utf-16-le", errors="replace")


def _info(body: bytes) -> str | None:
    """The path of a LinkInfo block: local base path and common suffix."""
    size = struct.unpack_from("<I", body, 4)[0]
    if size not in (0x1C, 0x24):
        return None
    flags, _, base, _, suffix = struct.unpack_from("<5I", body, 8)

    def at(offset: int) -> str:
        if not offset:
            return ""
        if offset >= len(body):
            raise Cut(f"offset {offset}")
        return body[offset:].split(b"\0", 1)[0].decode(errors="replace")

    path = (at(base) if flags & 1 else "") + at(suffix)
    return path or None


def blocks(data: bytes, at: int, flags: int) -> tuple[str | None, dict, list[dict]]:
    """Target path, strings and extra blocks behind the header."""

    def take(n: int) -> bytes:
        nonlocal at
        if n < 0 or at + n > len(data):
            raise Cut(f"{n} bytes at {at}")
        at += n
        return data[at - n : at]

    target, strings, extra = None, {}, []
    if flags & 1:
        take(struct.unpack("<H", take(2))[0])
    if flags & 2 and not flags >> 8 & 1:
        size = struct.unpack("<I", take(4))[0]
        if size < 0x1C:
            raise Cut(f"link info of {size} bytes")
        target = _info(struct.pack("<I", size) + take(size - 4))
    for bit, name in STRINGS:
        if flags >> bit & 1:
            n = struct.unpack("<H", take(2))[0]
            strings[name] = _text(take(2 * n)) if flags >> 7 & 1 else take(n).decode(errors="replace")
    while at + 4 <= len(data):
        size = struct.unpack("<I", take(4))[0]
        if size < 8 or at + size - 4 > len(data):
            break
        signature = struct.unpack("<I", take(4))[0]
        body = take(size - 8)
        extra.append({"name": BLOCKS.get(signature), "signature": signature, "size": size})
        if signature == 0xA0000001 and len(body) >= 780:
            target = _text(body[260:780]).split("\0", 1)[0] or body[:260].split(b"\0", 1)[0].decode(errors="replace") or target
    return target, strings, extra


def parse(data: bytes, context: Context) -> None:
    if probe(data, "") != "confirmed":
        context.issue(MALFORMED, "shell link header")
        return
    flags, attributes, created, accessed, written, size, icon, show, key, r1, r2, r3 = struct.unpack_from("<IIQQQIiIHHII", data, 20)
    if r1 or r2 or r3:
        context.issue(MALFORMED, "reserved header fields are not zero")
        return
    target, strings, extra = None, {}, None
    try:
        target, strings, extra = blocks(data, HEADER, flags)
    except Cut as e:
        context.issue(BOUNDARY, f"shell link blocks: {e}")
    a = {"lnk.header_size": HEADER, "lnk.flags": flags, "lnk.flag_names": [n for b, n in FLAGS.items() if flags >> b & 1], "lnk.file_attributes": attributes, "lnk.file_attribute_names": [n for b, n in ATTRIBUTES.items() if attributes >> b & 1], "lnk.file_size": size, "lnk.icon_index": icon, "lnk.show_command": SHOW.get(show, "normal"), "lnk.hot_key": key, "lnk.creation_filetime": created, "lnk.access_filetime": accessed, "lnk.write_filetime": written, "lnk.reference_spec": SPEC, "lnk.parser_version": VERSION}
    a |= {f"lnk.{k}": v for k, v in strings.items()}
    a |= {"lnk.target_path": target} if target else {}
    a |= {"lnk.extra_blocks": extra} if extra is not None else {}
    ordinal = 0
    for ticks, kind, name in ((created, "created", "creation"), (accessed, "accessed", "access"), (written, "modified", "write")):
        if ticks:
            context.event(instant(ticks, kind, f"FILETIME({name}={ticks})"), "lnk", "lnk_timestamp", f"LNK {name} time observed", a | {"lnk.timestamp_field": name}, byte_range(0, HEADER), 0, ordinal, target)
            ordinal += 1
    if not ordinal:
        context.event(unknown("observed"), "lnk", "lnk_timestamp", "LNK header observed, without times", a | {"lnk.timestamp_field": "none"}, byte_range(0, HEADER), 0, 0, target)
