"""Binary XML of event records, as published: tokens, templates with substitutions, typed values."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from typing import Any

from .base import filetime_text

MAX_DEPTH, MAX_NODES = 64, 20_000


class BinXmlError(Exception):
    pass


@dataclass
class Element:
    name: str
    attributes: dict[str, Any] = field(default_factory=dict)
    children: list[Element] = field(default_factory=list)
    values: list[Any] = field(default_factory=list)

    def find(self, *path: str) -> Element | None:
        here = self
        for name in path:
            here = next((c for c in here.children if c.name == name), None)
            if here is None:
                return None
        return here

    def value(self) -> Any:
        kept = [v for v in self.values if v is not None]
        return None if not kept else kept[0] if len(kept) == 1 else "".join(map(str, kept))


def typed(kind: int, raw: bytes, chunk: bytes, base: int) -> Any:
    """The value of a type: text, number, boolean, list, or hexadecimal text."""
    if kind == 0 or not raw and kind not in (1, 2):
        return None
    if kind & 0x80:
        if kind & 0x7F == 1:
            return [s for s in raw.decode("utf-16-le", errors="replace").split("\0") if s]
        size = {3: 1, 4: 1, 5: 2, 6: 2, 7: 4, 8: 4, 9: 8, 10: 8, 15: 16, 17: 8, 20: 4, 21: 8}.get(kind & 0x7F)
        return [typed(kind & 0x7F, raw[i : i + size], chunk, base) for i in range(0, len(raw), size)] if size else raw.hex()
    if kind == 1:
        return raw.decode("utf-16-le", errors="replace").rstrip("\0")
    if kind == 2:
        return raw.decode("latin-1").rstrip("\0")
    if kind in (3, 5, 7, 9):
        return int.from_bytes(raw, "little", signed=True)
    if kind in (4, 6, 8, 10, 16):
        return int.from_bytes(raw, "little")
    if kind in (11, 12):
        return struct.unpack("<f" if kind == 11 else "<d", raw)[0]
    if kind == 13:
        return bool(int.from_bytes(raw, "little"))
    if kind == 15 and len(raw) == 16:
        a, b, c = struct.unpack_from("<IHH", raw)
        return f"{{{a:08X}-{b:04X}-{c:04X}-{raw[8:10].hex().upper()}-{raw[10:].hex().upper()}}}"
    if kind == 17:
        return filetime_text(int.from_bytes(raw, "little"))
    if kind == 18 and len(raw) == 16:
        y, m, _, d, h, mi, s, ms = struct.unpack("<8H", raw)
        return f"{y:04d}-{m:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}.{ms:03d}Z"
    if kind == 19 and len(raw) >= 8:
        subs = struct.unpack_from(f"<{min(raw[1], (len(raw) - 8) // 4)}I", raw, 8)
        return "-".join(map(str, ["S", raw[0], int.from_bytes(raw[2:8], "big"), *subs]))
    if kind in (20, 21):
        return f"0x{int.from_bytes(raw, 'little'):x}"
    if kind == 33:
        return Reader(chunk, base, base + len(raw)).fragment()
    return raw.hex()


class Reader:
    """Tokens from ``at`` to ``end`` of a chunk; names and templates are found by their offset in the chunk."""

    def __init__(self, chunk: bytes, at: int, end: int, depth: int = 0):
        self.chunk, self.at, self.end, self.depth, self.nodes = chunk, at, min(end, len(chunk)), depth, 0
        if depth > 8:
            raise BinXmlError("templates are nested too deep")

    def take(self, form: str) -> Any:
        size = struct.calcsize(form)
        if self.at + size > self.end:
            raise BinXmlError(f"{size} bytes at {self.at}")
        self.at += size
        out = struct.unpack_from(form, self.chunk, self.at - size)
        return out[0] if len(out) == 1 else out

    def name(self) -> str:
        offset = self.take("<I")
        n = struct.unpack_from("<H", self.chunk, offset + 6)[0] if offset + 8 <= len(self.chunk) else 0
        if offset == self.at:
            self.at += 10 + 2 * n
        return self.chunk[offset + 8 : offset + 8 + 2 * n].decode("utf-16-le", errors="replace")

    def fragment(self, values: list | None = None) -> Element:
        root = Element("")
        stack, attribute = [root], None

        def put(value: Any) -> None:
            if isinstance(value, Element):
                stack[-1].children += value.children or []
            elif attribute is not None:
                old = stack[-1].attributes.get(attribute)
                stack[-1].attributes[attribute] = value if old is None else f"{old}{value}"
            else:
                stack[-1].values.append(value)

        while self.at < self.end:
            token = self.take("<B")
            self.nodes += 1
            if self.nodes > MAX_NODES or len(stack) > MAX_DEPTH:
                raise BinXmlError("too large")
            kind = token & ~0x40
            if token == 0:
                break
            if kind == 0x01:
                self.take("<HI")
                element = Element(self.name())
                if token & 0x40:
                    self.take("<I")
                stack[-1].children.append(element)
                stack.append(element)
                attribute = None
            elif kind == 0x06:
                attribute = self.name()
            elif kind == 0x02:
                attribute = None
            elif kind in (0x03, 0x04):
                if len(stack) == 1:
                    raise BinXmlError("an end without a start")
                stack.pop()
                attribute = None
            elif kind == 0x05:
                value_kind, n = self.take("<BH")
                if value_kind != 1:
                    raise BinXmlError(f"literal of type {value_kind}")
                put(self.take(f"<{2 * n}s").decode("utf-16-le", errors="replace"))
            elif kind in (0x07, 0x08):
                n = self.take("<H")
                put(chr(n) if kind == 0x08 else self.take(f"<{2 * n}s").decode("utf-16-le", errors="replace"))
            elif kind == 0x09:
                put({"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}.get(self.name(), ""))
            elif token in (0x0D, 0x0E):
                index, _ = self.take("<HB")
                put(values[index] if values is not None and index < len(values) else None)
            elif token == 0x0F:
                self.take("<3B")
            elif token == 0x0C:
                put(self.template())
            else:
                raise BinXmlError(f"token {token:#x}")
        return root

    def template(self) -> Element:
        self.take("<B")
        _, offset = self.take("<II")
        if offset + 24 > len(self.chunk):
            raise BinXmlError(f"template at {offset}")
        size = struct.unpack_from("<I", self.chunk, offset + 20)[0]
        if offset == self.at:
            self.at += 24 + size
        kinds = [self.take("<HBB") for _ in range(min(self.take("<I"), 4096))]
        values = []
        for n, kind, _ in kinds:
            start = self.at
            raw = self.take(f"<{n}s")
            if kind == 33:
                values.append(Reader(self.chunk, start, start + n, self.depth + 1).fragment())
            else:
                values.append(typed(kind, raw, self.chunk, start))
        return Reader(self.chunk, offset + 24, offset + 24 + size, self.depth + 1).fragment(values)


def content(chunk: bytes, start: int, end: int) -> dict[str, Any]:
    """What an event says of itself: system fields and named data."""
    event = Reader(chunk, start, end).fragment().find("Event")
    if event is None:
        raise BinXmlError("no Event")
    of = lambda *p: (e.value() if (e := event.find("System", *p)) is not None else None)
    provider = event.find("System", "Provider")
    data: dict[str, Any] = {}
    for part in ("EventData", "UserData"):
        todo = list(event.find(part).children) if event.find(part) else []
        while todo:
            e = todo.pop(0)
            todo = [*e.children, *todo]
            if e.name == "Data" or not e.children:
                name = e.attributes.get("Name") or (f"Data{len(data)}" if e.name == "Data" else e.name)
                data.setdefault(str(name), e.value())
    number = of("EventID")
    return {"event_id": int(number) if isinstance(number, int) or str(number or "").isdigit() else None, "channel": of("Channel"), "computer": of("Computer"), "provider": provider.attributes.get("Name") if provider else None, "level": of("Level"), "data": data}
