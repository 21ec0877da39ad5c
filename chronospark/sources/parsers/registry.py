"""Registry hives (regf): an event for each key's last write and one for each value, depth first."""

from __future__ import annotations

import hashlib
import struct
from typing import Any

from .base import BOUNDARY, MALFORMED, VERSION, Context, byte_range, instant, unknown

BINS = 4096
MAX_DEPTH, MAX_KEYS, MAX_VALUES = 512, 2_000_000, 65_536
# Value types.
TYPES = {0: "REG_NONE", 1: "REG_SZ", 2: "REG_EXPAND_SZ", 3: "REG_BINARY", 4: "REG_DWORD", 5: "REG_DWORD_BIG_ENDIAN", 6: "REG_LINK", 7: "REG_MULTI_SZ", 8: "REG_RESOURCE_LIST", 9: "REG_FULL_RESOURCE_DESCRIPTOR", 10: "REG_RESOURCE_REQUIREMENTS_LIST", 11: "REG_QWORD"}
HIVES = {"ntuser.dat": "ntuser", "usrclass.dat": "usrclass", "system": "system", "software": "software", "sam": "sam", "security": "security", "amcache.hve": "amcache", "default": "default"}


class Bad(Exception):
    """A cell that lies outside the bins or isn't what it should be."""


def probe(data: bytes, locator: str) -> str:
    if data[:4] != b"regf":
        return "not_this_format"
    return "confirmed" if len(data) >= BINS else "malformed"


def value_of(kind: int, data: bytes) -> Any:
    """Strings, numbers and string lists as such; every other content by its SHA-256."""
    if kind in (1, 2):
        return data.decode("utf-16-le", errors="replace").rstrip("\0")
    if kind in (4, 5) and len(data) >= 4:
        return int.from_bytes(data[:4], "little" if kind == 4 else "big")
    if kind == 11 and len(data) >= 8:
        return int.from_bytes(data[:8], "little")
    if kind == 7:
        return [s for s in data.decode("utf-16-le", errors="replace").split("\0") if s]
    return hashlib.sha256(data).hexdigest()


class Bins:
    """Cells by their offset in the area behind the base block."""

    def __init__(self, data: bytes):
        self.data = data[BINS:]

    def cell(self, offset: int, least: int = 4) -> bytes:
        if not 0 <= offset <= len(self.data) - 4:
            raise Bad(f"cell {offset}")
        size = struct.unpack_from("<i", self.data, offset)[0]
        if size >= 0 or -size < least + 4 or offset - size > len(self.data):
            raise Bad(f"cell {offset} of size {size}")
        return self.data[offset + 4 : offset - size]

    def key(self, offset: int) -> dict:
        c = self.cell(offset, 76)
        if c[:2] != b"nk":
            raise Bad(f"cell {offset} is no key")
        flags, time = struct.unpack_from("<HQ", c, 2)
        subkeys, _, sub_list, _, values, value_list = struct.unpack_from("<6I", c, 20)
        n = struct.unpack_from("<H", c, 72)[0]
        raw = c[76 : 76 + n]
        return {"time": time, "subkeys": subkeys, "sub_list": sub_list, "values": values, "value_list": value_list, "name": raw.decode("latin-1") if flags & 0x20 else raw.decode("utf-16-le", errors="replace"), "size": len(c) + 4}

    def value(self, offset: int) -> dict:
        c = self.cell(offset, 20)
        if c[:2] != b"vk":
            raise Bad(f"cell {offset} is no value")
        n, size, where, kind, flags = struct.unpack_from("<HIIIH", c, 2)
        raw = c[20 : 20 + n]
        inline = size >> 31
        size &= 0x7FFFFFFF
        data = c[8:12][: min(4, size)] if inline else self.cell(where)[:size] if size else b""
        return {"name": raw.decode("latin-1") if flags & 1 else raw.decode("utf-16-le", errors="replace"), "kind": kind, "data": data, "size": len(c) + 4}

    def children(self, offset: int, seen: set[int]) -> list[int]:
        out, todo = [], [offset]
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            c = self.cell(at)
            n = struct.unpack_from("<H", c, 2)[0]
            step = 8 if c[:2] in (b"lf", b"lh") else 4
            found = [struct.unpack_from("<I", c, 4 + step * i)[0] for i in range(n) if 8 + step * i <= len(c)]
            if c[:2] == b"ri":
                todo += reversed(found)
            else:
                out += found
        return out


def parse(data: bytes, context: Context) -> None:
    if probe(data, "") != "confirmed":
        context.issue(MALFORMED, "hive header")
        return
    bins, hive = Bins(data), HIVES.get(context.locator.rsplit("/", 1)[-1].lower(), "unknown")
    root = struct.unpack_from("<I", data, 36)[0]
    todo, seen, lists, ordinal, keys = [(root, "", 0)], set(), set(), 0, 0
    while todo:
        offset, above, depth = todo.pop()
        if offset in seen:
            continue
        if depth >= MAX_DEPTH or keys >= MAX_KEYS:
            context.issue(BOUNDARY, f"limit of depth or keys at cell {offset}")
            continue
        seen.add(offset)
        keys += 1
        try:
            key = bins.key(offset)
        except Bad as e:
            context.issue(MALFORMED, str(e))
            continue
        path = f"{above}\\{key['name']}" if above else key["name"]
        a = {"registry.hive_type": hive, "registry.key_path": path, "registry.view": "base", "registry.subkey_count": key["subkeys"], "registry.value_count": key["values"], "registry.parser_version": VERSION}
        when = lambda k=key: instant(k["time"], "registry_modified", f"FILETIME({k['time']})") if k["time"] else unknown("registry_modified")
        context.event(when(), "registry", "registry_key_last_write", f"registry key written: {path}", a, byte_range(offset, offset + key["size"]), ordinal, ordinal, path)
        ordinal += 1
        if key["values"] and key["value_list"] != 0xFFFFFFFF:
            try:
                body = bins.cell(key["value_list"])
                offsets = [struct.unpack_from("<I", body, 4 * i)[0] for i in range(min(key["values"], MAX_VALUES, len(body) // 4))]
            except Bad as e:
                context.issue(MALFORMED, str(e))
                offsets = []
            for at in offsets:
                try:
                    v = bins.value(at)
                except Bad as e:
                    context.issue(MALFORMED, str(e))
                    continue
                own = a | {"registry.value_name": v["name"], "registry.value_type": TYPES.get(v["kind"], f"REG_UNKNOWN_{v['kind']}"), "registry.value_data": value_of(v["kind"], v["data"]), "registry.time_source": "key_last_write"}
                context.event(when(), "registry", "registry_observation", f"registry value: {path}\\{v['name']}", own, byte_range(at, at + v["size"]), ordinal, ordinal, path)
                ordinal += 1
        if key["subkeys"] and key["sub_list"] != 0xFFFFFFFF:
            try:
                todo += [(c, path, depth + 1) for c in reversed(bins.children(key["sub_list"], lists))]
            except (Bad, struct.error) as e:
                context.issue(MALFORMED, str(e))
