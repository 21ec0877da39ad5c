"""Amcache hives: observations of the values below the inventory keys."""

from __future__ import annotations

import struct

from .base import MALFORMED, VERSION, Context, byte_range, instant, unknown
from .registry import BINS, MAX_DEPTH, MAX_KEYS, TYPES, Bad, Bins, value_of

# Keys below the root that tell the two families.
INVENTORY = ("inventoryapplicationfile", "inventoryapplication", "inventoryapplicationshortcut", "inventorydevicepnp", "inventorydevicecontainer", "devicecensus")
LEGACY = ("file", "programs")


def probe(data: bytes, locator: str) -> str:
    """Confirmed only beside a registry parser and by name; the same bytes are a hive too."""
    if data[:4] != b"regf" or len(data) < BINS:
        return "not_this_format"
    return "confirmed" if locator.rsplit("/", 1)[-1].lower() == "amcache.hve" else "not_this_format"


def family(names: list[str]) -> str:
    low = {n.lower() for n in names}
    return "win10_inventory" if low & set(INVENTORY) else "win8_legacy" if low & set(LEGACY) else "unknown"


def parse(data: bytes, context: Context) -> None:
    bins, seen, lists, ordinal = Bins(data), set(), set(), 0
    root = struct.unpack_from("<I", data, 36)[0]

    def below(key: dict) -> list[int]:
        if not key["subkeys"] or key["sub_list"] == 0xFFFFFFFF:
            return []
        try:
            return bins.children(key["sub_list"], lists)
        except (Bad, struct.error) as e:
            context.issue(MALFORMED, str(e))
            return []

    def read(offset: int) -> dict | None:
        try:
            return bins.key(offset)
        except Bad as e:
            context.issue(MALFORMED, str(e))
            return None

    top = read(root)
    first = [(o, k) for o in (below(top) if top else []) if (k := read(o))]
    if [k["name"].lower() for _, k in first] == ["root"]:  # inventory keys lie one level deeper
        first = [(o, k) for o in below(first[0][1]) if (k := read(o))]
    kind = family([k["name"] for _, k in first])
    if kind == "unknown":
        context.issue(MALFORMED, "no inventory keys")
        return
    known = INVENTORY if kind == "win10_inventory" else LEGACY
    todo = [(o, k["name"], 0) for o, k in reversed(first) if k["name"].lower() in known]
    while todo and len(seen) < MAX_KEYS:
        offset, path, depth = todo.pop()
        key = read(offset) if offset not in seen and depth < MAX_DEPTH else None
        seen.add(offset)
        if key is None:
            continue
        values = {}
        if key["values"] and key["value_list"] != 0xFFFFFFFF:
            try:
                body = bins.cell(key["value_list"])
                for i in range(min(key["values"], len(body) // 4)):
                    v = bins.value(struct.unpack_from("<I", body, 4 * i)[0])
                    values[v["name"]] = (TYPES.get(v["kind"], f"REG_UNKNOWN_{v['kind']}"), value_of(v["kind"], v["data"]))
            except Bad as e:
                context.issue(MALFORMED, str(e))
        if values:
            a = {"amcache.schema_family": kind, "amcache.key_path": path, "amcache.is_file_metadata": path.split("\\")[0].lower() in ("inventoryapplicationfile", "inventoryapplication"), "amcache.parser_version": VERSION}
            a |= {f"amcache.value.{n}": v for n, (_, v) in values.items()}
            time = instant(key["time"], "registry_modified", f"FILETIME({key['time']})") if key["time"] else unknown("registry_modified")
            file = values.get("LowerCaseLongPath", (None, None))[1]
            context.event(time, "amcache", "amcache_observation", f"Amcache entry: {path}", a, byte_range(offset, offset + key["size"]), ordinal, ordinal, file if isinstance(file, str) else None)
            ordinal += 1
        todo += [(c, f"{path}\\{k['name']}", depth + 1) for c in reversed(below(key)) if (k := read(c))]
