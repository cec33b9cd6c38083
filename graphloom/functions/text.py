"""Scalar functions over source text, paths and names, as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.schemas import TYPE_CONTAINERS

KEYWORDS = ("if", "for", "while", "switch", "catch")
_WORD = "[A-Za-z0-9_]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complexity(text: Column | str) -> Column:
    """1 + whole-word branching keywords, comments and strings included."""
    return (F.regexp_count(_c(text), F.lit(rf"(?<!{_WORD})(?:{'|'.join(KEYWORDS)})(?!{_WORD})")) + 1).cast("int")


def starts_with_keyword(text: Column | str, keyword: str) -> Column:
    return _c(text).rlike(rf"^{re.escape(keyword)}(?!{_WORD})")


def count_lines(text: Column | str) -> Column:
    """Lines of a text; a final line feed begins no line, an empty text has none."""
    t = _c(text)
    feeds = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(F.length(t) == 0, 0).otherwise(feeds + F.when(t.endswith("\n"), 0).otherwise(1)).cast("long")


def line_of_offset(text: Column | str, offset: Column | int) -> Column:
    """1-based line on which the character at ``offset`` (from 0) stands."""
    head = F.substring(_c(text), F.lit(1), F.lit(offset) if isinstance(offset, int) else offset)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


def line_range(text: Column | str, first: Column | int, last: Column | int) -> Column:
    """Lines first..last (1-based, inclusive) with their line feeds; the whole text if first is past its end."""
    t = _c(text)
    a = F.lit(first) if isinstance(first, int) else first
    b = F.lit(last) if isinstance(last, int) else last
    lines = F.split(t, "\n")
    n = count_lines(t)
    part = F.array_join(F.slice(lines, a, F.greatest(b - a + 1, F.lit(0))), "\n")
    return F.when(a > n, t).otherwise(F.concat(part, F.when(b < F.size(lines), F.lit("\n")).otherwise(F.lit(""))))


def import_paths(text: Column | str) -> Column:
    """Every ``@import("...")`` argument in order, those in comments and strings as well."""
    return F.regexp_extract_all(_c(text), F.lit(r'@import\("([^"]*)"'), F.lit(1))


def import_kind(path: Column | str) -> Column:
    p = _c(path)
    return F.when(p.isin("std", "builtin"), "stdlib").when(p.endswith(".zig"), "project_file").otherwise("unknown")


def resolve_import(importer: Column | str, path: Column | str, limit: int | None = None) -> Column:
    """The path from the importer's folder, normalised; null above the root, for nothing, or beyond ``limit`` segments."""
    here, to = _c(importer), _c(path)
    folder = F.when(here.contains("/"), F.regexp_replace(here, "/[^/]*$", "")).otherwise("")
    parts = F.filter(F.split(F.concat_ws("/", folder, to), "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("ok"))

    fits = (lambda n: n < limit) if limit else (lambda n: F.lit(True))

    def step(acc: Column, x: Column) -> Column:
        up = F.struct(F.slice(acc["path"], 1, F.greatest(F.size(acc["path"]) - 1, F.lit(0))).alias("path"), (acc["ok"] & (F.size(acc["path"]) > 0)).alias("ok"))
        return F.when(x == "..", up).otherwise(F.struct(F.concat(acc["path"], F.array(x)).alias("path"), (acc["ok"] & fits(F.size(acc["path"]))).alias("ok")))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"] & (F.size(acc["path"]) > 0) & (F.length(to) > 0), F.array_join(acc["path"], "/")))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """With its point; empty if the name has none, or only one in front."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def has_component(path: Column | str, name: str) -> Column:
    return F.array_contains(F.split(_c(path), "/"), name)


def excluded(path: Column | str, names: list[str]) -> Column:
    """Equal to a name, or with a segment (also the last) that is."""
    if not names:
        return F.lit(False)
    p = _c(path)
    return p.isin(*names) | F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(n) for n in names]))


def in_scope(path: Column | str, prefix: str | None) -> Column:
    """Bytewise prefix; null is out of scope, and everything is in scope of None."""
    return F.lit(True) if prefix is None else F.coalesce(_c(path).startswith(prefix), F.lit(False))


def internal(external: Column | str = "external") -> Column:
    return F.coalesce(_c(external)["kind"], F.lit("none")) == "none"


def pascal(name: Column | str) -> Column:
    return _c(name).rlike("^[A-Z]")


def type_container(kind: Column | str) -> Column:
    return _c(kind).isin(*TYPE_CONTAINERS)


def type_reference(kind: Column | str, name: Column | str) -> Column:
    """What a type name can mean: a container, or a constant or import in PascalCase."""
    return type_container(kind) | (_c(kind).isin("constant", "import_decl") & pascal(name))


def in_line_comment(before: Column | str) -> Column:
    """Whether ``//`` stands earlier on the last line of the text before a place."""
    return F.substring_index(_c(before), "\n", -1).contains("//")


def dotted_chains(text: Column | str, alias: str = "std") -> Column:
    """Every ``alias.a.b`` at a word's start, without a final point."""
    found = F.regexp_extract_all(_c(text), F.lit(rf"(?<![A-Za-z0-9_])({re.escape(alias)}\.[A-Za-z0-9_.]+)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"\.+$", ""))


def chain_concat(a: Column | str, b: Column | str, limit: int | None = None) -> Column:
    both = F.concat(_c(a), _c(b))
    return F.slice(both, 1, limit) if limit else both


def return_type(signature: Column | str) -> Column:
    """Segments of the type after the last ``)``, without error set, pointers, optionals and const."""
    t = F.trim(F.regexp_extract(_c(signature), r"(?s)\)([^)]*)$", 1))
    t = F.when(t.contains("!"), F.regexp_replace(t, r"(?s)^[^!]*!", "")).otherwise(t)
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim(t), r"^[*?]+", ""), r"^const\s+", ""))
    parts = F.transform(F.split(t, r"\."), lambda x: F.regexp_extract(x, r"^\s*([A-Za-z0-9_]+)", 1))
    return F.filter(parts, lambda x: x != "")


def content_hash(content: Column | str) -> Column:
    """12 bytes: XXH3-64 (little-endian), then the low half of XXH3-64 seeded with 1; an Arrow function."""
    import pandas as pd

    def xxh3(values):
        import xxhash

        def one(v):
            if v is None:
                return None
            v = bytes(v)
            return xxhash.xxh3_64_intdigest(v).to_bytes(8, "little") + (xxhash.xxh3_64_intdigest(v, seed=1) & 0xFFFFFFFF).to_bytes(4, "little")

        return values.map(one)

    xxh3.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(xxh3, T.BinaryType())(_c(content).cast("binary"))


def hash_text(content_hash: Column | str) -> Column:
    return F.lower(F.hex(_c(content_hash)))


def hash_bytes(text: Column | str) -> Column:
    """Null unless it is 24 hexadecimal digits."""
    t = _c(text)
    return F.when(t.rlike("^[0-9a-fA-F]{24}$"), F.unhex(t))


def json_string(text: Column | str) -> Column:
    """A JSON string literal: short escapes for quote, backslash, line feed, return and tab, lower-case \\u00xx for other controls."""
    t = _c(text)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(a), F.lit(b))
    for k in range(32):
        if k not in (9, 10, 13):
            t = F.replace(t, F.lit(chr(k)), F.lit(f"\\u{k:04x}"))
    return F.concat(F.lit('"'), t, F.lit('"'))


def flow_escape(text: Column | str) -> Column:
    """Quotes and angle brackets as entities; & stays."""
    t = _c(text)
    for a, b in (('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def underscored(text: Column | str) -> Column:
    return F.translate(_c(text), ".", "_")


def align8(n: Column | str) -> Column:
    return (_c(n) + 7) - F.pmod(_c(n) + 7, F.lit(8))


def utc_stamp(ts: Column | None = None) -> Column:
    return F.date_format(ts if ts is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def flags_text(meta: Column | str) -> Column:
    """A node's language flags in the form of the listing: two spaces and [name] for each that is set."""
    m = _c(meta)
    on = [F.when(m[f], F.lit(f"  [{n}]")).otherwise("") for f, n in (("is_comptime", "comptime"), ("is_mutable", "mutable"), ("is_inline", "inline"), ("is_extern", "extern"), ("is_packed", "packed"), ("comptime_conditional", "comptime_conditional"))]
    call = F.when(m["calling_convention"].isNotNull(), F.concat(F.lit("  [callconv="), m["calling_convention"], F.lit("]"))).otherwise("")
    return F.when(m.isNull(), F.lit("")).otherwise(F.concat(*on, call))


def flags_bits(meta: Column | str) -> Column:
    m = _c(meta)
    return sum(F.when(m[f], v).otherwise(0) for f, v in (("is_comptime", 1), ("is_inline", 2), ("is_extern", 4), ("comptime_conditional", 8), ("is_mutable", 16), ("is_packed", 32)))
