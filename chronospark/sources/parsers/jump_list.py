"""Jump lists: compound files of numbered links with a destination list, and custom ones of links in a row."""

from __future__ import annotations

import re
import struct
from typing import Any

from . import lnk
from .base import BOUNDARY, MALFORMED, MISSING, TRUNCATED, VERSION, Context, byte_range, instant, unknown

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, MAX_SECTORS = 0xFFFFFFFA, 1 << 20


class Compound:
    """Streams of a compound file by name."""

    def __init__(self, data: bytes):
        self.data = data
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("compound header")
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise ValueError("sector size")
        self.size = 1 << shift
        first_dir, = struct.unpack_from("<I", data, 48)
        self.cutoff, first_mini, _, difat, n_difat = struct.unpack_from("<5I", data, 56)
        sectors = list(struct.unpack_from("<109I", data, 76))
        while difat < FREE and n_difat and len(sectors) < MAX_SECTORS:
            block = struct.unpack(f"<{self.size // 4}I", self.sector(difat))
            sectors += block[:-1]
            difat, n_difat = block[-1], n_difat - 1
        self.fat: list[int] = []
        for s in sectors:
            if s < FREE:
                self.fat += struct.unpack(f"<{self.size // 4}I", self.sector(s))
        self.entries = []
        directory = self.chain(first_dir)
        for at in range(0, len(directory) - 127, 128):
            n, kind = struct.unpack_from("<HB", directory, at + 64)
            start, size = struct.unpack_from("<IQ", directory, at + 116)
            self.entries.append((directory[at : at + max(0, n - 2)].decode("utf-16-le", errors="replace"), kind, start, size))
        root = next((e for e in self.entries if e[1] == 5), None)
        self.mini = self.chain(root[2])[: root[3]] if root else b""
        raw = self.chain(first_mini)
        self.mini_fat = struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])

    def sector(self, n: int) -> bytes:
        out = self.data[(n + 1) * self.size : (n + 2) * self.size]
        if len(out) < self.size:
            raise ValueError(f"sector {n}")
        return out

    def chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < FREE and n not in seen and n < len(self.fat):
            seen.add(n)
            out.append(self.sector(n))
            n = self.fat[n]
        return b"".join(out)

    def stream(self, start: int, size: int) -> bytes:
        if size >= self.cutoff:
            return self.chain(start)[:size]
        out, seen, n = [], set(), start
        while n < FREE and n not in seen and n < len(self.mini_fat):
            seen.add(n)
            out.append(self.mini[64 * n : 64 * n + 64])
            n = self.mini_fat[n]
        return b"".join(out)[:size]


def destinations(data: bytes) -> list[dict[str, Any]]:
    """Entries of a destination list of version 1, 3 or 4."""
    if len(data) < 32:
        return []
    version = struct.unpack_from("<I", data)[0]
    name_at, fixed, tail = (112, 114, 0) if version == 1 else (128, 130, 4)
    out, at = [], 32
    while at + fixed <= len(data):
        n = struct.unpack_from("<H", data, at + name_at)[0]
        end = at + fixed + 2 * n
        if end > len(data):
            break
        number, = struct.unpack_from("<I", data, at + 88)
        ticks, pin = struct.unpack_from("<Qi", data, at + 100)
        out.append({"stream": f"{number:x}", "time": ticks, "pinned": pin >= 0, "hostname": data[at + 72 : at + 88].split(b"\0", 1)[0].decode(errors="replace"), "path": data[at + fixed : end].decode("utf-16-le", errors="replace")})
        at = end + tail
    return out


def app_id(locator: str) -> str | None:
    m = re.fullmatch(r"([0-9a-fA-F]{1,16})\.(automatic|custom)Destinations-ms", locator.rsplit("/", 1)[-1])
    return m[1].lower() if m else None


def probe(data: bytes, locator: str) -> str:
    if data[:8] == MAGIC:
        return "confirmed" if locator.endswith(".automaticDestinations-ms") or b"D\0e\0s\0t\0L\0i\0s\0t\0" in data else "not_this_format"
    if locator.endswith(".customDestinations-ms"):
        return "confirmed" if lnk.CLSID in data[:4096] else "probable"
    return "not_this_format"


def target(data: bytes) -> str | None:
    try:
        return lnk.blocks(data, lnk.HEADER, struct.unpack_from("<I", data, 20)[0])[0] if lnk.probe(data, "") == "confirmed" else None
    except (lnk.Cut, struct.error):
        return None


def parse(data: bytes, context: Context) -> None:
    base = {"jump_list.app_id": app_id(context.locator), "jump_list.parser_version": VERSION}
    if data[:8] != MAGIC:
        starts = [m.start() for m in re.finditer(re.escape(b"\x4c\0\0\0" + lnk.CLSID), data)]
        if not starts:
            context.issue(MALFORMED, "no links")
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(data)], strict=True)):
            ticks = struct.unpack_from("<Q", data, a + 44)[0] if a + 52 <= len(data) else 0
            time = instant(ticks, "modified", f"FILETIME({ticks})") if ticks else unknown("observed")
            context.event(time, "jump_list", "jump_list_observation", f"custom jump list entry {i}", base | {"jump_list.type": "custom", "jump_list.entry_index": i}, byte_range(a, b), i, i, target(data[a:b]))
        return
    try:
        whole = Compound(data)
    except (ValueError, struct.error) as e:
        context.issue(MALFORMED, f"compound file: {e}")
        return
    listed: dict[str, dict] = {}
    for name, kind, start, size in whole.entries:
        if name == "DestList" and kind == 2:
            for e in destinations(whole.stream(start, size)):
                listed.setdefault(e["stream"], e)
    index = 0
    for name, kind, start, size in whole.entries:
        if kind != 2 or not re.fullmatch(r"[0-9a-fA-F]+", name):
            continue
        body = whole.stream(start, size)
        if len(body) < size:
            context.issue(TRUNCATED, f"stream {name}")
        e = listed.pop(name.lower(), None)
        path = (e["path"] if e else None) or target(body)
        if lnk.probe(body, "") != "confirmed":
            context.issue(BOUNDARY, f"stream {name} is no link")
        a = base | {"jump_list.type": "automatic", "jump_list.entry_index": index, "jump_list.stream": name, "jump_list.in_destlist": e is not None}
        a |= {"jump_list.pinned": e["pinned"], "jump_list.hostname": e["hostname"]} if e else {}
        time = instant(e["time"], "accessed", f"FILETIME({e['time']})") if e and e["time"] else unknown("observed")
        context.event(time, "jump_list", "jump_list_observation", f"jump list entry {name}", a, {"parts": [name], "type": "logical_path"}, index, index, path)
        index += 1
    for name in listed:
        context.issue(MISSING, f"destination {name} has no stream")
