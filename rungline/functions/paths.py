"""Operand paths as column expressions: all of them stay inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The controller's grammar of tags, literals, module tags and indexes.
#: The leading tag of an operand.
BASE = r"^(?:\\[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*|[A-Za-z_][A-Za-z0-9_]*(?::[A-Za-z0-9_]+)*)"
#: Where an operand has a leading tag.
HAS_BASE = r"^(?:[A-Za-z_]|\\[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_])"
#: A path inside an expression; a letter right after a digit or # belongs to a literal such as 16#FF.
IDENTIFIER = r"(?<![A-Za-z0-9_#\\.])(\\?[A-Za-z_][A-Za-z0-9_:]*(?:\.[A-Za-z0-9_:]+|\[[^\]]*\])*)"


def base_tag(operand: Column) -> Column:
    """Leading tag of an operand (`Tag.Member[1]` -> `Tag`, `\\Prog.Tag` -> `\\Prog.Tag`); null if there is none."""
    got = F.regexp_extract(F.trim(operand), BASE, 0)
    return F.when(got != "", got)


def is_literal(operand: Column) -> Column:
    """A number, a radix literal, a quoted string, `?` or nothing."""
    return operand.rlike(r"^[-+]?(?:\d|\.\d|16#|8#|2#)") | operand.isin("?", "") | operand.rlike("^'.*'$")


def norm(path: Column) -> Column:
    """Lower case, without white space, indexes as [*]. A nested index leaves its outer bracket."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"\s+", ""), r"\[[^\]]*\]", "[*]"))


def overlaps(a: Column, b: Column) -> Column:
    """Equal normalised paths, or one is the other followed by `.` or `[`."""
    inside = lambda long, short: F.startswith(long, short) & F.substr(long, F.length(short) + 1, F.lit(1)).isin(".", "[")
    return (a == b) | inside(a, b) | inside(b, a)


def above(path: Column, base: Column) -> Column:
    """The paths that hold a normalised path, from its base on: each ends where a `.` or `[` follows. None for a base itself."""
    ends = F.filter(F.sequence(F.length(base) + 1, F.length(path)), lambda i: F.substr(path, i, F.lit(1)).isin(".", "["))
    return F.when(F.length(path) > F.length(base), F.transform(ends, lambda i: F.substr(path, F.lit(1), i - 1))).otherwise(F.array().cast("array<string>"))


def is_output_module(operand: Column) -> Column:
    return operand.rlike(r"(?i):S?O(\b|$)")


def is_input_module(operand: Column) -> Column:
    return operand.rlike(r"(?i):S?I(\b|$)")


def natural_key(name: Column, width: int = 12) -> Column:
    """A key that sorts digit runs by value: each run is padded with zeros to `width` digits."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")


def split_base(path: str) -> str:
    """The part of a query before its first member or index."""
    return re.split(r"[.\[]", path, maxsplit=1)[0]


def place(n: Column, is_st: Column) -> Column:
    """`#12` for a rung, `#L13` for a line, which counts from 1."""
    return F.when(is_st, F.concat(F.lit("#L"), (n + 1).cast("string"))).otherwise(F.concat(F.lit("#"), n.cast("string")))
