"""Binary parsers: bytes of one file to events and issues, as a table function over evidence contents."""

from .base import EVENT_SCHEMA, PARSERS, parse_contents, parse_one

__all__ = ["EVENT_SCHEMA", "PARSERS", "parse_contents", "parse_one"]
