"""Structured Text: same-length blanking of what is no code, tag uses, calls and balance of a whole routine."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from . import tables

_BLANK = re.compile(
    r"//[^\n]*|\(\*.*?(?:\*\)|\Z)|/\*.*?(?:\*/|\Z)|'(?:\$.|[^'$])*(?:'|\Z)|\b(?:T|TIME|LT|D|DT|DATE|TOD|LDT)#[\w:.+-]*|\b\d+#\w+|(?<![\w.])\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?", re.DOTALL | re.IGNORECASE
)
#: The kinds of token that matter, by the pattern that finds them.
_TOKENS = re.compile(
    r"(?P<path>\\?[A-Za-z_]\w*(?::\w+)*(?:\s*\.\s*\w+|\s*\[[^\]]*\])*)(?P<call>\s*\()?|(?P<set>:=)|(?P<open>[(\[])|(?P<close>[)\]])|(?P<comma>,)", re.ASCII
)
_WORD = re.compile(r"\\?[A-Za-z_]\w*", re.ASCII)
_BASE = re.compile(r"\\[A-Za-z_]\w*\.[A-Za-z_]\w*|[A-Za-z_]\w*(?::\w+)*", re.ASCII)
_LITERAL = re.compile(r"[-+]?(\d|\.\d)|'.*'$|\?$|$")
_SET = re.compile(r"\s*:=")
_INDEX = re.compile(r"\[([^\]]*)\]")


def blank(src: str | None) -> str | None:
    """Comments, strings, typed literals and numbers become spaces; line ends and length stay."""
    return None if src is None else _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), src)


class _Routine:
    """One routine's tokens, and its findings as rows (line, kind, instruction, operand, base, is_write, idx, within).

    Kinds: use; arg, an argument of a call that isn't known by itself, whole; jump, a JSR target. What is found inside such an argument has
    the call's name in `within`: if the name turns out to be a user-defined instruction, the argument counts and what is inside doesn't."""

    def __init__(self, lines: list[str]):
        self.text = "\n".join(lines).replace("[:=]", " := ")
        self.code = blank(self.text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]
        self.rows: list[tuple] = []
        self.scan(0, len(self.code), ())
        self.rows.sort(key=lambda r: (r[0], *map(str, r[1:])))

    def found(self, at: int, kind: str, instruction: str, operand: str, write: bool, idx: int, within: tuple) -> None:
        operand = re.sub(r"\s+", "", operand)
        if m := _BASE.match(operand):
            self.rows.append((bisect_right(self.starts, at) - 1, kind, instruction, operand, m[0], write, idx, list(within)))

    def indexes(self, at: int, path: str, within: tuple) -> None:
        for x in _INDEX.finditer(path):
            self.scan(at + x.start(1), at + x.end(1), within)

    def scan(self, i: int, to: int, within: tuple) -> None:
        """Read everything from i on as expressions, assignments and calls."""
        inside: list[tuple[int, tuple]] = []  # ends of the calls around, and what was around them
        while m := _TOKENS.search(self.code, i, to):
            i = m.end()
            while inside and m.start() >= inside[-1][0]:
                within = inside.pop()[1]
            if not m["path"]:
                continue
            at, path = m.start(), m["path"]
            name = path.upper()
            if m["call"] and _WORD.fullmatch(path):
                spans, close = self.arguments(m.end(), to)
                if name in tables.WRITES:
                    self.known(name, spans, within)
                    i = close + 1
                elif name not in tables.ST_KEYWORDS and name not in tables.EXPRESSION_FUNCTIONS:
                    for k, (a, z) in enumerate(spans):
                        self.found(a, "arg", name, self.text[a:z].strip(), False, k, within)
                        self.indexes(a, self.code[a:z], within)
                    inside.append((close, within))
                    within = (*within, name)
            elif _WORD.match(path)[0].upper() not in tables.ST_KEYWORDS:
                i = m.end("path")
                write = _SET.match(self.code, i, to) is not None
                self.found(at, "use", ":=" if write else "ST", self.text[at:i], write, 0, within)
                self.indexes(at, path, within)

    def known(self, name: str, spans: list[tuple[int, int]], within: tuple) -> None:
        for k, (a, z) in enumerate(spans):
            arg = self.text[a:z].strip()
            if k == 0 and name in tables.NAME_FIRST:
                if name == "JSR":
                    self.found(a, "jump", name, self.code[a:z].strip(), False, 0, within)
            elif not _LITERAL.match(arg):
                if name in tables.EXPRESSIONS and k not in tables.WRITES[name]:
                    self.scan(a, z, within)
                else:
                    self.found(a, "use", name, arg, k in tables.WRITES[name], k, within)
                    self.indexes(a, self.code[a:z], within)

    def arguments(self, start: int, to: int) -> tuple[list[tuple[int, int]], int]:
        """Spans of a call's arguments from just after its parenthesis, and where it closes."""
        depth, out = 0, [start]
        for m in re.finditer(r"[()\[\],]", self.code[start:to]):
            at = start + m.start()
            if m[0] in "([":
                depth += 1
            elif m[0] == ")" and depth == 0:
                return list(zip(out, [*(x - 1 for x in out[1:]), at], strict=True)), at
            elif m[0] in ")]":
                depth -= 1
            elif depth == 0:
                out.append(at + 1)
        return list(zip(out, [*(x - 1 for x in out[1:]), to], strict=True)), to


def findings(lines: list[str]) -> list[tuple]:
    return _Routine(lines).rows


def uses(lines: list[str]) -> list[tuple]:
    """(line from 0, instruction, operand, base, is_write, idx) of a routine: `:=` targets are written, all other paths read; arguments of
    known instructions are classified as in ladder text; expressions in indexes are read."""
    return sorted((line, ins, operand, base, write, idx) for line, kind, ins, operand, base, write, idx, _ in findings(lines) if kind == "use")


def calls(lines: list[str]) -> list[str]:
    return [operand for _, kind, _, operand, *_ in findings(lines) if kind == "jump"]


def problems(lines: list[str]) -> list[str]:
    """Comments and brackets that don't balance, brackets that close nothing, and blocks without their end."""
    text = "\n".join(lines)
    code, out = blank(text), []
    out += [f"unbalanced {a} {z}" for a, z in (("(*", "*)"), ("/*", "*/")) if text.count(a) != text.count(z)]
    open_, starts = {"(": 0, "[": 0}, [m.end() for m in re.finditer("\n", code)]
    for m in re.finditer(r"[()\[\]]", code):
        kind = "(" if m[0] in "()" else "["
        open_[kind] += 1 if m[0] == kind else -1
        if open_[kind] < 0:
            out.append(f"unexpected {m[0]} in line {bisect_right(starts, m.start()) + 1}")
            open_[kind] = 0
    out += [f"unbalanced {k}{')' if k == '(' else ']'}" for k, n in open_.items() if n]
    count = lambda w: len(re.findall(rf"\b{w}\b", code, re.IGNORECASE))
    return out + [f"{w} without END_{w}" for w in ("IF", "CASE", "FOR", "WHILE", "REPEAT") if count(w) != count(f"END_{w}")]


ROWS = "n long, pos int, kind string, instruction string, operand string, base string, is_write boolean, idx int, within array<string>"


def _grouped(lines: DataFrame, keys: list[str], rows, schema: str) -> DataFrame:
    """A routine's lines become one row, and many rows go to a worker at once: there are more routines than lines in one."""
    kinds = dict(lines.dtypes)
    out = ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema])
    arrow = to_arrow_schema(StructType.fromDDL(out))

    def run(batches):
        for b in batches:
            own, held = [b.column(k) for k in range(len(keys))], []
            for row, units in enumerate(b.column(len(keys)).to_pylist()):
                held += [(row, *r) for r in rows([u["n"] for u in units], [u["txt"] or "" for u in units])]
            if held:
                at, *columns = zip(*held, strict=True)
                yield pa.RecordBatch.from_arrays([c.take(pa.array(at)) for c in own] + [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(keys) :], strict=True)], schema=arrow)

    units = F.array_sort(F.collect_list(F.struct("n", "txt"))).alias("units")
    return lines.groupBy(*keys).agg(units).select(*keys, "units").mapInArrow(run, out)


def routine_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of lines(keys, n, txt): a routine's lines meet in one group, as a statement may run over several."""
    return _grouped(lines, keys, lambda n, txt: [(n[line], k, *rest) for k, (line, *rest) in enumerate(findings(txt))], ROWS)


def routine_uses(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Uses of routines without user-defined instructions: keys, n, pos, instruction, operand, base, is_write, idx."""
    return routine_rows(lines, keys).where("kind = 'use'").drop("kind", "within")


def routine_problems(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem: faults of whole routines."""
    return _grouped(lines, keys, lambda n, txt: [(p,) for p in problems(txt)], "problem string")


blank_non_code = F.udf(blank, StringType(), useArrow=True)
