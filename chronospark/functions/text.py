"""Sanitising, path normalising and bit-flag functions, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_controls(text: Column) -> Column:
    """C0 controls but tab and line feed as ^X, DEL as ^?, C1 controls as \\u0080 and so on."""
    names = {i: f"^{chr(i + 64)}" for i in range(32) if i not in (9, 10)} | {127: "^?"} | {i: f"\\u{i:04x}" for i in range(128, 160)}
    table = F.create_map(*[F.lit(x) for i, name in names.items() for x in (chr(i), name)])
    chars = F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), c))
    return F.when(text.rlike(r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"), F.array_join(chars, "")).otherwise(text)


def needs_formula_guard(cell: Column) -> Column:
    return F.coalesce(cell.rlike(r"^ *[=+\-@\t\r]"), F.lit(False))


def csv_cell(cell: Column) -> Column:
    """A cell guarded against formulas by an apostrophe, and quoted where it holds a comma, quote or line end."""
    guarded = F.when(needs_formula_guard(cell), F.concat(F.lit("'"), cell)).otherwise(F.coalesce(cell, F.lit("")))
    return F.when(guarded.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def html_text(text: Column) -> Column:
    out = text
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def html_attribute(text: Column) -> Column:
    return F.replace(F.replace(html_text(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def issue_message(text: Column) -> Column:
    """Without control characters, at most 512 bytes of whole characters."""
    plain = F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")
    cut = F.try_validate_utf8(F.substring(plain.cast("binary"), 1, 512).cast("string"))
    return F.when(F.octet_length(plain) <= 512, plain).otherwise(F.coalesce(cut, F.substring(plain, 1, 170)))


def windows_path(path: Column) -> tuple[Column, Column]:
    """(comparison key, notes) of a Windows path: separators, dot components and case are made alike."""
    back = F.replace(path, F.lit("/"), F.lit("\\"))
    drive = F.regexp_extract(back, r"^([A-Za-z]:)(?:\\|$)", 1)
    root = F.when(back.startswith("\\\\"), F.lit("\\\\")).when(drive != "", F.concat(drive, F.lit("\\"))).when(back.startswith("\\"), F.lit("\\")).otherwise(F.lit(""))
    rest = F.substring(back, F.length(root) + 1, 1 << 30)
    parts = F.filter(F.split(rest, r"\\", -1), lambda p: p != "")
    dots = F.size(F.filter(parts, lambda p: p == "."))
    state = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("notes"))

    def step(acc: Column, part: Column) -> Column:
        last = F.element_at(acc["kept"], -1)
        can_pop = (F.size(acc["kept"]) > 0) & (last != "..")
        note = lambda n: F.concat(acc["notes"], F.array(F.lit(n)))
        made = lambda kept, notes: F.struct(kept.alias("kept"), notes.alias("notes"))
        return (
            F.when(part != "..", made(F.concat(acc["kept"], F.array(part)), acc["notes"]))
            .when(can_pop, made(F.slice(acc["kept"], 1, F.greatest(F.size(acc["kept"]) - 1, F.lit(0))), note("parent_component_resolved")))
            .when(root == "", made(F.concat(acc["kept"], F.array(part)), note("parent_component_kept_relative")))
            .otherwise(made(acc["kept"], note("parent_component_dropped_at_root")))
        )

    folded = F.aggregate(F.filter(parts, lambda p: p != "."), state, step)
    joined = F.concat(root, F.array_join(folded["kept"], "\\"))
    key = F.lower(joined)
    notes = F.concat(
        F.when(back != path, F.array(F.lit("forward_slash_converted"))).otherwise(F.array().cast("array<string>")),
        F.array_repeat(F.lit("dot_component_removed"), dots),
        folded["notes"],
        F.when(key != joined, F.array(F.lit("comparison_key_case_folded"))).otherwise(F.array().cast("array<string>")),
    )
    return key, notes


def source_locator(path: Column) -> Column:
    """A relative locator with single forward slashes; null for absolute or empty ones and those with dot components."""
    forward = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(forward, "/", -1), lambda p: p != "")
    bad = forward.startswith("/") | forward.rlike("^[A-Za-z]:") | (F.size(parts) == 0) | F.exists(parts, lambda p: p.isin(".", ".."))
    return F.when(~bad, F.array_join(parts, "/"))


def flag_names(value: Column, names: dict[int, str]) -> Column:
    """The names of the set bits, in the order given."""
    return F.filter(F.array(*[F.when(value.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in names.items()]), lambda x: x.isNotNull())


def unknown_bits(value: Column, names: dict[int, str]) -> Column:
    return value.bitwiseAND(F.lit(~sum(names)))
