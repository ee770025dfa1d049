"""Text normalisation and alias tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the documents' producers see it: ASCII, and the Unicode separators.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"

# Header texts of the three kinds of table. They differ on purpose.
RECORD_HEADERS = {
    "code": ["code", "шифр", "обоснование", "номер расценки", "код"],
    "name": ["name", "наименование", "работы и затраты", "наименование работ"],
    "quantity": ["quantity", "количество", "объем", "объём", "объем работ", "объём работ"],
    "unit": ["unit", "единица", "ед. изм.", "ед изм", "единица измерения"],
    "unit_price": ["unit_price", "цена единицы", "цена за единицу", "цена", "стоимость единицы", "unit price"],
    "declared_total": ["total", "declared_total", "всего", "стоимость", "итого"],
    "index": ["index", "индекс"],
    "coefficient": ["coefficient", "коэффициент", "коэф."],
    "category": ["category", "категория", "вид затрат"],
}
SHEET_HEADERS = {
    "number": ["№", "№ п/п", "n", "no", "number", "номер", "п/п"],
    "code": ["код", "обоснование", "шифр", "code", "rate code"],
    "name": ["наименование", "название", "описание", "name", "description", "work description"],
    "unit": ["ед. изм.", "ед изм", "единица измерения", "unit", "uom"],
    "quantity": ["количество", "объем", "qty", "quantity", "volume"],
    "unit_price": ["цена за единицу", "единичная цена", "цена ед.", "unit price", "unit_price", "price per unit"],
    "amount": ["стоимость", "сумма", "всего", "amount", "total", "cost"],
    "index": ["индекс", "index"],
    "coefficient": ["коэффициент", "коэф.", "коэф", "coeff", "coefficient"],
    "category": ["категория", "category"],
    "source": ["источник", "source"],
    "date": ["дата", "date"],
    "vat": ["ндс", "vat"],
    "delivery": ["доставка", "delivery"],
    "taxable_base": ["налоговая база", "база ндс", "облагаемая база", "taxable base", "taxable_base"],
}
SCAN_HEADERS = {
    "code": ["code", "код", "шифр", "обоснование"],
    "name": ["name", "item", "наименование", "работы", "затраты"],
    "unit": ["unit", "ед", "ед.", "единица"],
    "quantity": ["quantity", "qty", "количество", "объем", "объём"],
    "unit_price": ["price", "unit_price", "цена", "расценка"],
    "declared_total": ["total", "declared_total", "всего", "итого", "стоимость"],
}
# The names of kinds of estimates.
ESTIMATE_TYPES = {
    "lsr": "LSR",
    "лср": "LSR",
    "local_estimate": "LSR",
    "osr": "OSR",
    "оср": "OSR",
    "object_estimate": "OSR",
    "ssr": "SSR",
    "сср": "SSR",
    "summary_estimate": "SSR",
    "osr_or_ssr": "OSR_OR_SSR",
    "object_or_summary_estimate": "OSR_OR_SSR",
}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def folded(text: Column) -> Column:
    """Lower case for matching; the sharp s counts as two letters."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapsed(text: Column) -> Column:
    """Trimmed, lower case, runs of white space as one space."""
    return F.regexp_replace(folded(trimmed(text)), SPACE, " ")


def blank(value: Column) -> Column:
    return value.isNull() | (value.cast("string") == "")


def semantic_name(text: Column) -> Column:
    """Digits, Latin and Russian letters only, single spaces."""
    plain = F.replace(folded(trimmed(F.coalesce(text, F.lit("")))), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(plain, "[^0-9a-zа-я]+", " "))


def sheet_header(text: Column) -> Column:
    """A header of a spreadsheet: also one letter for two, and no colons at the ends."""
    return F.trim(F.regexp_replace(F.replace(collapsed(text), F.lit("ё"), F.lit("е")), "^[: ]+|[: ]+$", ""))


def scan_header(text: Column) -> Column:
    """A header of a recognised page: no colons or semicolons at the ends."""
    return F.trim(F.regexp_replace(collapsed(text), "^[:; ]+|[:; ]+$", ""))


def lookup(table: dict[str, list[str]] | dict[str, str], text: Column) -> Column:
    """The field of an alias; null if there is none. The table is a literal of a few dozen entries."""
    flat = {a: f for f, names in table.items() for a in names} if any(isinstance(v, list) for v in table.values()) else table
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in flat.items() for x in kv]), text)


def estimate_type(text: Column) -> Column:
    return lookup(ESTIMATE_TYPES, folded(trimmed(F.coalesce(text, F.lit("")))))
