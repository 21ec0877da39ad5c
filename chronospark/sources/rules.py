"""Rule files of a folder: read once, distinct by content, in the order of their hashes."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from ..plans import correlation, sigma
from ..operators import scan
from .evidence import discover

MAX_FILES, MAX_BYTES = 100_000, 16 << 20


@dataclass
class RuleFile:
    name: str
    sha256: str
    data: bytes


def load(root: str) -> tuple[list[RuleFile], list[str]]:
    """Files in the order of their sha256, and the names of those that are too large."""
    found, skipped = {}, []
    for name, path in discover(root, max_files=MAX_FILES).files:
        with open(path, "rb") as f:
            data = f.read(MAX_BYTES + 1)
        if len(data) > MAX_BYTES:
            skipped.append(name)
            continue
        digest = hashlib.sha256(data).hexdigest()
        found.setdefault(digest, RuleFile(name, digest, data))
    return [found[k] for k in sorted(found)], skipped


def compile_all(files: list[RuleFile], kind: str) -> tuple[list, list[tuple[str, str]]]:
    """Compiled rules, and (name, reason) of the files that are skipped or wrong. Kinds: sigma, correlation, yara."""
    rules, bad = [], []
    for f in files:
        try:
            if kind == "yara":
                rules += scan.compile_file(f.data.decode())
            else:
                rules.append((sigma if kind == "sigma" else correlation).compile_rule(f.data))
        except (sigma.RuleError, correlation.RuleError, scan.ScanError, UnicodeDecodeError) as e:
            bad.append((f.name, f"{type(e).__name__}: {e}"))
    return rules, bad
