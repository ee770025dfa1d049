"""The spreadsheet formula subset: arithmetic, cell references, SUM, MIN, MAX, ROUND, ranges as arguments."""

from __future__ import annotations

import decimal
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.decimals import DIGITS
from ledgerlens.functions.text import lookup
from ledgerlens.operators.grouped import by_group
from ledgerlens.operators.rows import OPERANDS

#: Cells that one range may name.
RANGE_CELLS = 100_000
UNSUPPORTED, CYCLE = "unsupported_formula", "formula_cycle"
FUNCTIONS = ("SUM", "MIN", "MAX", "ROUND")
#: How tightly signs bind; the unary minus is written `~` inside.
BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "~": 3}
DIGIT, LETTER = frozenset("0123456789"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Unsupported(ValueError):
    """The formula is outside the subset, or needs a value that isn't there."""


class Cyclic(Unsupported):
    """The formula depends on itself."""


def _while(text: str, at: int, kind: frozenset[str]) -> int:
    while at < len(text) and text[at] in kind:
        at += 1
    return at


def scan(formula: str) -> list[tuple[str, str]]:
    """(kind, text) of each part: number, cell, name (of a function) or sign."""
    text, at, out = formula.removeprefix("=").upper(), 0, []
    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
        elif c in DIGIT or c == ".":
            whole = _while(text, at, DIGIT)
            end = _while(text, whole + 1, DIGIT) if text[whole : whole + 1] == "." else whole
            if end - at == 1 and c == ".":
                raise Unsupported(formula)
            if text[end : end + 1] == "E":
                first = end + 1 + (text[end + 1 : end + 2] in ("+", "-") and end + 1 < len(text))
                end = power if (power := _while(text, first, DIGIT)) > first else end
            out.append(("number", text[at:end]))
            at = end
        elif c in LETTER or c == "$":
            letters = at + (c == "$")
            end = _while(text, letters, LETTER)
            digits = end + (text[end : end + 1] == "$")
            last = _while(text, digits, DIGIT)
            if 1 <= end - letters <= 3 and last > digits and text[digits] != "0":
                out.append(("cell", text[letters:end] + text[digits:last]))
            elif c != "$" and text[end:].lstrip().startswith("("):
                out.append(("name", text[at:end]))
                last = end
            else:
                raise Unsupported(formula)
            at = last
        elif c in "+-*/(),:":
            out.append(("sign", c))
            at += 1
        else:
            raise Unsupported(formula)
    return out


@lru_cache(maxsize=4096)  # sheets of one kind repeat their formulas
def compiled(formula: str) -> list[tuple]:
    """The formula as steps on a stack: (push, number), (cell, ref), (range, refs' corners), (do, sign), (mark,), (call, name, ranged)."""
    parts, out = scan(formula), []
    held: list[list] = []  # signs, `(`, and functions as [name, commas, ranged]
    wanted, i = True, 0

    def settle(least: int) -> None:
        while held and BINDS.get(held[-1][0], 0) >= least:
            out.append(("do", held.pop()[0]))

    while i < len(parts):
        kind, text = parts[i]
        i += 1
        if wanted and kind == "number":
            out.append(("push", text))
            wanted = False
        elif wanted and kind == "cell":
            if parts[i : i + 1] == [("sign", ":")]:
                if not held or held[-1][0] not in FUNCTIONS or len(parts) < i + 3 or parts[i + 1][0] != "cell" or parts[i + 2] not in (("sign", ","), ("sign", ")")):
                    raise Unsupported(formula)
                out.append(("range", text, parts[i + 1][1]))
                held[-1][2] = True
                i += 2
            else:
                out.append(("cell", text))
            wanted = False
        elif wanted and kind == "name":
            if text not in FUNCTIONS:
                raise Unsupported(text)
            out.append(("mark",))
            held.append([text, 0, False])
            i += 1  # the bracket after a name is there, or it would be none
        elif wanted and text in ("-", "+", "("):
            if text != "+":
                held.append(["~" if text == "-" else "("])
        elif not wanted and text in BINDS:
            settle(BINDS[text])
            held.append([text])
            wanted = True
        elif not wanted and text in (",", ")"):
            settle(1)
            if not held or (text == "," and held[-1][0] == "("):
                raise Unsupported(formula)
            if text == ",":
                wanted = True
            elif (top := held.pop())[0] != "(":
                out.append(("call", top[0], top[2]))
        else:
            raise Unsupported(formula)
    settle(1)
    if wanted or held:
        raise Unsupported(formula)
    return out


def split_cell(ref: str) -> tuple[int, int]:
    """(row, column) of A1."""
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


def name_cell(row: int, col: int) -> str:
    out = ""
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return f"{out}{row}"


def range_cells(first: str, last: str) -> list[str] | None:
    """The cells of a range by row; None if it is turned around or names too many."""
    (r1, c1), (r2, c2) = split_cell(first), split_cell(last)
    if r2 < r1 or c2 < c1 or (r2 - r1 + 1) * (c2 - c1 + 1) > RANGE_CELLS:
        return None
    return [name_cell(r, c) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)]


_short_range = lru_cache(maxsize=64)(range_cells)  # corners of five characters together, 7,000 cells each at most

CONTEXT = decimal.Context(prec=DIGITS, rounding=decimal.ROUND_HALF_EVEN)
ROUNDING = decimal.Context(prec=60)


class Evaluator:
    """Evaluates a sheet's formulas, each once; `values` are numbers of plain cells.

    A formula runs until it needs another that has no result yet, and waits on a list meanwhile, so chains of
    any length work.
    """

    ctx = CONTEXT

    def __init__(self, values: dict[str, decimal.Decimal], formulas: dict[str, str]):
        self.values, self.formulas = values, formulas
        self.done: dict[str, decimal.Decimal | Unsupported] = {}

    def cell(self, ref: str) -> decimal.Decimal:
        waiting: list[tuple[str, Iterator[str]]] = []
        running: set[str] = set()
        if ref in self.formulas and ref not in self.done:
            waiting.append((ref, self._run(ref)))
            running.add(ref)
        while waiting:
            own, steps = waiting[-1]
            need = next(steps, None)
            if need is None:
                waiting.pop()
                running.discard(own)
            elif need in running:
                self.done[own] = Cyclic(need)
                waiting.pop()
                running.discard(own)
            else:
                waiting.append((need, self._run(need)))
                running.add(need)
        return self._known(ref)

    def _known(self, ref: str) -> decimal.Decimal:
        got = self.done[ref] if ref in self.formulas else self.values.get(ref)
        if isinstance(got, Unsupported):
            raise got
        if got is None:
            raise Unsupported(f"{ref} is blank or text")
        return got

    def _run(self, ref: str) -> Iterator[str]:
        """Yields formula cells without a result as they are needed, then keeps its own."""
        try:
            stack: list = []
            for step in compiled(self.formulas[ref]):
                if step[0] == "push":
                    stack.append(self.ctx.create_decimal(step[1]))
                elif step[0] == "mark":
                    stack.append(None)
                elif step[0] in ("cell", "range"):
                    for cell in self._cells(step):
                        if cell in self.formulas and cell not in self.done:
                            yield cell
                        stack.append(self._known(cell))
                elif step[0] == "do":
                    self._do(step[1], stack)
                else:
                    args = []
                    while (top := stack.pop()) is not None:
                        args.append(top)
                    stack.append(self._call(step[1], args[::-1], step[2]))
            self.done[ref] = stack[0]
        except Unsupported as error:
            self.done[ref] = error
        except decimal.DecimalException:
            self.done[ref] = Unsupported(ref)

    def _cells(self, step: tuple) -> list[str]:
        if step[0] == "cell":
            return [step[1]]
        cells = range_cells(step[1], step[2]) if len(step[1]) + len(step[2]) > 5 else _short_range(step[1], step[2])
        if cells is None:
            raise Unsupported("range")
        return cells

    def _do(self, sign: str, stack: list[decimal.Decimal]) -> None:
        right = stack.pop()
        if sign == "~":
            stack.append(self.ctx.minus(right))
            return
        if sign == "/" and right == 0:
            raise Unsupported("division by zero")
        make = {"+": self.ctx.add, "-": self.ctx.subtract, "*": self.ctx.multiply, "/": self.ctx.divide}[sign]
        stack.append(make(stack.pop(), right))

    def _call(self, name: str, args: list[decimal.Decimal], ranged: bool) -> decimal.Decimal:
        if name == "ROUND":
            if len(args) != 2 or ranged or args[1] != args[1].to_integral_value() or abs(args[1]) > 15:
                raise Unsupported("ROUND")
            step = decimal.Decimal(1).scaleb(-int(args[1]))
            return args[0].quantize(step, decimal.ROUND_HALF_UP, context=ROUNDING)
        if name == "SUM":
            return reduce(self.ctx.add, args, decimal.Decimal(0))
        return min(args) if name == "MIN" else max(args)


def evaluate(cells: DataFrame) -> DataFrame:
    """(sheet, ref, value, error) of each formula of cells (sheet, ref, value text, formula); values are text.

    A formula's cells are on its own sheet, and a sheet is bounded, so sheets are grouped. A formula that is
    in a cycle, or depends on one, says so; blanks are not zeros.
    """

    def fold(rows: list[tuple]) -> list[tuple]:
        values, formulas = {}, {}
        for _, ref, value, formula in rows:
            if formula is not None:
                formulas[ref] = formula
            elif value is not None:
                try:
                    number = decimal.Decimal(value)
                except decimal.InvalidOperation:
                    continue
                if number.is_finite():
                    values[ref] = number
        sheet, own, out = rows[0][0], Evaluator(values, formulas), []
        for ref in sorted(formulas):
            try:
                out.append((sheet, ref, format(own.cell(ref), "f"), None))
            except Cyclic:
                out.append((sheet, ref, None, CYCLE))
            except Unsupported:
                out.append((sheet, ref, None, UNSUPPORTED))
        return out

    return by_group(cells.select("sheet", "ref", "value", "formula"), "sheet", fold, "sheet string, ref string, value string, error string")


def product_basis(rows: DataFrame) -> DataFrame:
    """rows (id, formula, fields map<column letters, field>, row) with `basis`: the allowed product that the formula is.

    The formula must multiply distinct cells of its own row, all mapped, in one of four combinations.
    """
    refs = F.transform(F.split(F.regexp_replace(F.col("formula"), r"[=\s$]", ""), r"\*"), F.upper)
    own = F.forall(refs, lambda r: r.rlike("^[A-Z]{1,3}[0-9]+$") & (F.regexp_extract(r, "([0-9]+)$", 1) == F.col("row").cast("string")))
    fields = F.transform(refs, lambda r: F.try_element_at(F.col("fields"), F.regexp_extract(r, "^([A-Z]+)", 1)))
    known = F.forall(fields, lambda f: f.isNotNull()) & (F.size(F.array_distinct(fields)) == F.size(fields))
    basis = lookup({" ".join(sorted(v)): k for k, v in OPERANDS.items()}, F.array_join(F.array_sort(fields), " "))
    return rows.withColumn("basis", F.when(F.coalesce(own & known, F.lit(False)), basis))
