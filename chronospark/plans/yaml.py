"""A strict YAML subset for rule files: block and flow collections and plain or quoted scalars, nothing else.

Rejected with ``YamlError``: anchors, aliases, tags, directives, several documents, block scalars, duplicate keys, tabs
in indentation. Plain scalars are typed: null, booleans, decimal and octal integers, floats; everything else is text.
"""

from __future__ import annotations

import re
from typing import Any

_INT = re.compile(r"[-+]?(?:0|[1-9][0-9]*)")
_OCT = re.compile(r"0o[0-7]+")
_FLOAT = re.compile(r"[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[-+]?[0-9]+[eE][-+]?[0-9]+")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", '"': '"', "/": "/", "b": "\b", "f": "\f", "a": "\a", "e": "\x1b", "v": "\v", " ": " "}


class YamlError(ValueError):
    pass


def scalar(text: str) -> Any:
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text[0] in "tT"
    if _INT.fullmatch(text):
        return int(text)
    if _OCT.fullmatch(text):
        return int(text[2:], 8)
    return float(text) if _FLOAT.fullmatch(text) else text


def _strip_comment(line: str) -> str:
    quote, at = "", 0
    while at < len(line):
        c = line[at]
        if quote:
            if c == "\\" and quote == '"':
                at += 1
            elif c == quote:
                quote = ""
        elif c in "'\"" and (at == 0 or line[at - 1] in " [{,:-"):
            quote = c
        elif c == "#" and (at == 0 or line[at - 1] in " \t"):
            return line[:at].rstrip()
        at += 1
    return line.rstrip()


class _Parser:
    def __init__(self, source: str):
        self.lines: list[tuple[int, str]] = []
        for raw in source.replace("\r\n", "\n").split("\n"):
            line = _strip_comment(raw)
            body = line.lstrip(" ")
            if not body:
                continue
            if body[0] == "\t":
                raise YamlError("tab in indentation")
            if line.startswith("%"):
                raise YamlError("directive")
            if line.startswith("---"):
                if self.lines or line != "---":
                    raise YamlError("several documents")
                continue
            if line == "...":
                raise YamlError("several documents")
            self.lines.append((len(line) - len(body), body))
        self.at = 0

    def flow(self, text: str, at: int) -> tuple[Any, int]:
        """A flow value from ``at``; returns it and the place behind it."""
        while at < len(text) and text[at] == " ":
            at += 1
        if at >= len(text):
            return None, at
        c = text[at]
        if c in "&*!":
            raise YamlError("anchor, alias or tag")
        if c in "[{":
            out: Any = [] if c == "[" else {}
            close, at = "]" if c == "[" else "}", at + 1
            while True:
                while at < len(text) and text[at] in " ,":
                    at += 1
                if at >= len(text):
                    raise YamlError("unclosed flow collection")
                if text[at] == close:
                    return out, at + 1
                item, at = self.flow(text, at)
                if c == "[":
                    out.append(item)
                    continue
                while at < len(text) and text[at] == " ":
                    at += 1
                value = None
                if at < len(text) and text[at] == ":":
                    value, at = self.flow(text, at + 1)
                key = item if isinstance(item, str) else str(item)
                if key in out:
                    raise YamlError(f"duplicate key {key}")
                out[key] = value
        if c in "'\"":
            return self.quoted(text, at)
        end = at
        while end < len(text) and text[end] not in ",]}" and not (text[end] == ":" and (end + 1 == len(text) or text[end + 1] in " ,]}")):
            end += 1
        return scalar(text[at:end].strip()), end

    def quoted(self, text: str, at: int) -> tuple[str, int]:
        quote, out, at = text[at], [], at + 1
        while at < len(text):
            c = text[at]
            if quote == "'" and c == "'":
                if text[at + 1 : at + 2] != "'":
                    return "".join(out), at + 1
                out.append("'")
                at += 2
            elif quote == '"' and c == '"':
                return "".join(out), at + 1
            elif quote == '"' and c == "\\":
                e = text[at + 1 : at + 2]
                if e in ("x", "u", "U"):
                    n = {"x": 2, "u": 4, "U": 8}[e]
                    out.append(chr(int(text[at + 2 : at + 2 + n], 16)))
                    at += 2 + n
                elif e in _ESCAPES:
                    out.append(_ESCAPES[e])
                    at += 2
                else:
                    raise YamlError("unknown escape")
            else:
                out.append(c)
                at += 1
        raise YamlError("unclosed quote")

    def inline(self, text: str) -> Any:
        if text[0] in "|>":
            raise YamlError("block scalar")
        if text[0] in "&*!":
            raise YamlError("anchor, alias or tag")
        if text[0] in "[{'\"":
            value, end = self.flow(text, 0)
            while text[0] in "[{" and end > len(text):
                raise YamlError("unclosed flow collection")
            if text[end:].strip():
                raise YamlError("text behind a value")
            return value
        if ": " in text or text.endswith(":"):
            raise YamlError("a mapping within a value")
        return scalar(text)

    def key(self, text: str) -> tuple[str, str] | None:
        """Key and rest of a mapping line."""
        if text[0] in "'\"":
            name, end = self.quoted(text, 0)
            rest = text[end:].lstrip()
            return (name, rest[1:].strip()) if rest.startswith(":") else None
        if text[0] in "[{":
            return None
        m = re.match(r"([^:]*(?::(?=\S)[^:]*)*):(?:\s+(.*))?$", text)
        return (m[1].rstrip(), (m[2] or "").strip()) if m else None

    def joined(self, text: str) -> str:
        """A flow collection that goes on over the next lines."""
        while text[:1] in ("[", "{") and self.at < len(self.lines) and sum(text.count(c) for c in "[{") > sum(text.count(c) for c in "]}"):
            text += " " + self.lines[self.at][1]
            self.at += 1
        return text

    def block(self, indent: int) -> Any:
        first = self.lines[self.at][1]
        if first == "-" or first.startswith("- "):
            out = []
            while self.at < len(self.lines) and self.lines[self.at][0] == indent and (self.lines[self.at][1] == "-" or self.lines[self.at][1].startswith("- ")):
                body = self.lines[self.at][1][1:]
                inner = body.lstrip(" ")
                if not inner:
                    self.at += 1
                    out.append(self.block(self.lines[self.at][0]) if self.at < len(self.lines) and self.lines[self.at][0] > indent else None)
                elif inner == "-" or inner.startswith("- ") or inner[0] not in "[{" and self.key(inner):
                    self.lines[self.at] = (indent + 1 + len(body) - len(inner), inner)
                    out.append(self.block(self.lines[self.at][0]))
                else:
                    self.at += 1
                    out.append(self.inline(self.joined(inner)))
            if self.at < len(self.lines) and self.lines[self.at][0] > indent:
                raise YamlError("indentation")
            return out
        if self.key(first) is None:
            self.at += 1
            return self.inline(self.joined(first))
        out = {}
        while self.at < len(self.lines) and self.lines[self.at][0] == indent:
            found = self.key(self.lines[self.at][1])
            if found is None:
                raise YamlError("a key is missing")
            name, rest = found
            if name[:1] in ("&", "*", "!", "?"):
                raise YamlError("anchor, alias, tag or complex key")
            if name in out:
                raise YamlError(f"duplicate key {name}")
            self.at += 1
            if rest:
                out[name] = self.inline(self.joined(rest))
            elif self.at < len(self.lines) and (self.lines[self.at][0] > indent or self.lines[self.at][0] == indent and self.lines[self.at][1].startswith("- ")):
                out[name] = self.block(self.lines[self.at][0])
            else:
                out[name] = None
        if self.at < len(self.lines) and self.lines[self.at][0] > indent:
            raise YamlError("indentation")
        return out


def parse(source: str) -> Any:
    p = _Parser(source)
    if not p.lines:
        return None
    out = p.block(p.lines[0][0])
    if p.at != len(p.lines):
        raise YamlError("indentation")
    return out
