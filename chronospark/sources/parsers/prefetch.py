"""Prefetch files, versions 17, 23, 26, 30 and 31, plain or compressed with LZXPRESS-Huffman (MAM)."""

from __future__ import annotations

import struct

from .base import BAD_VERSION, MALFORMED, TRUNCATED, VERSION, Context, byte_range, instant, unknown

MAX_BYTES, MAX_FILES = 32 << 20, 64
# By version, where the last run times begin, how many there are, and where the run count is.
LAYOUT = {17: (120, 1, 144), 23: (128, 1, 152), 26: (128, 8, 208), 30: (128, 8, 208), 31: (128, 8, 200)}


def probe(data: bytes, locator: str) -> str:
    if data[:3] == b"MAM":
        return "confirmed" if len(data) >= 8 else "malformed"
    if data[4:8] != b"SCCA":
        return "not_this_format"
    return "confirmed" if struct.unpack_from("<I", data)[0] in LAYOUT else "unsupported_version"


def decompress(data: bytes, size: int) -> bytes:
    """LZXPRESS-Huffman: 64 KiB blocks, each with 512 code lengths of 4 bits and a bit stream of 16-bit words."""
    out, at = bytearray(), 0
    while len(out) < size:
        lengths = [n for b in data[at : at + 256] for n in (b & 15, b >> 4)]
        if len(lengths) < 512:
            raise ValueError("code table is cut")
        at += 256
        codes, code, last = {}, 0, 0
        for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
            code <<= n - last
            codes[n, code] = symbol
            code, last = code + 1, n
        word = lambda: int.from_bytes(data[at : at + 2], "little")
        bits = word() << 16
        at += 2
        bits |= word()
        at += 2
        extra, end = 16, min(size, len(out) + 65536)

        def skip(n: int) -> None:
            nonlocal bits, extra, at
            bits = bits << n & 0xFFFFFFFF
            extra -= n
            if extra < 0:
                bits |= word() << -extra
                extra += 16
                at += 2

        while len(out) < end:
            for n in range(1, 16):
                symbol = codes.get((n, bits >> 32 - n))
                if symbol is not None:
                    break
            else:
                raise ValueError("no code")
            skip(n)
            if symbol < 256:
                out.append(symbol)
                continue
            length, width = symbol & 15, symbol - 256 >> 4
            if length == 15:
                length += data[at] if at < len(data) else 0
                at += 1
                if length == 270:
                    length = int.from_bytes(data[at : at + 2], "little")
                    at += 2
            distance = (1 << width) + (bits >> 32 - width if width else 0)
            skip(width)
            if distance > len(out):
                raise ValueError("distance")
            for _ in range(length + 3):
                out.append(out[-distance])
    return bytes(out[:size])


def parse(data: bytes, context: Context) -> None:
    packed = data[:3] == b"MAM"
    if packed:
        size = struct.unpack_from("<I", data, 4)[0]
        if size > MAX_BYTES:
            context.issue(MALFORMED, f"{size} bytes after unpacking")
            return
        try:
            data = decompress(data[8:], size)
        except (ValueError, IndexError) as e:
            context.issue(MALFORMED, f"compressed data: {e}")
            return
    if data[4:8] != b"SCCA":
        context.issue(MALFORMED, "signature")
        return
    version = struct.unpack_from("<I", data)[0]
    if version not in LAYOUT:
        context.issue(BAD_VERSION, f"version {version}")
        return
    at, runs, count_at = LAYOUT[version]
    if len(data) < max(at + 8 * runs, count_at + 4, 124):
        context.issue(TRUNCATED, "file information")
        return
    name = data[16:76].decode("utf-16-le", errors="replace").split("\0", 1)[0]
    strings_at, strings_size, volumes_at = struct.unpack_from("<III", data, 100)
    names = [s for s in data[strings_at : strings_at + strings_size].decode("utf-16-le", errors="replace").split("\0") if s]
    device = ""
    if volumes_at + 8 <= len(data):
        where, n = struct.unpack_from("<II", data, volumes_at)
        device = data[volumes_at + where : volumes_at + where + 2 * n].decode("utf-16-le", errors="replace").rstrip("\0")
    a = {"prefetch.version": version, "prefetch.executable": name, "prefetch.hash": f"{struct.unpack_from('<I', data, 76)[0]:08X}", "prefetch.run_count": struct.unpack_from("<I", data, count_at)[0], "prefetch.mam_compressed": packed, "prefetch.referenced_files": names[:MAX_FILES], "prefetch.referenced_files_truncated": len(names) > MAX_FILES, "prefetch.parser_version": VERSION}
    path = f"{device}\\{name}" if device else name
    ordinal = 0
    for i, ticks in enumerate(struct.unpack_from(f"<{runs}Q", data, at)):
        if ticks:
            context.event(instant(ticks, "executed", f"FILETIME({ticks})"), "prefetch", "prefetch_execution_observed", f"{name} ran", a | {"prefetch.run_index": i}, byte_range(at + 8 * i, at + 8 * i + 8), i, ordinal, path, name)
            ordinal += 1
    if not ordinal:
        context.event(unknown("executed"), "prefetch", "prefetch_execution_observed", f"{name} ran at an unknown time", a, byte_range(at, at + 8), 0, 0, path, name)
