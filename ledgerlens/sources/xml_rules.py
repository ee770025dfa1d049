"""Path rules of the thirteen known estimate schemas, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Paths of the estimate formats. (entity, path pattern, fields), a field being (name, relative paths).
DOCUMENT = [("name", ["Name"]), ("code", ["Num"])]
COST = [("name", ["Name"]), ("code", ["Code"]), ("unit", ["Unit"]), ("quantity", ["QuantityTotal", "Quantity"]), ("declared_total", ["Totals/Current/Direct"])]
UNIT_PRICE = [("unit_price", ["PerUnit/Current/Direct"])]
TOTAL = [("declared_total", ["Total", "."])]
PART = [("name", ["Name"]), ("code", ["Num"]), ("declared_total", ["Details/Summary/Total"])]
OFFER = [("name", ["OfferName"]), ("code", ["OfferCode"]), ("unit", ["OfferUnit"]), ("unit_price", ["OfferPrice/OfferUnitWithoutVAT"]), ("declared_total", ["OfferPrice/EstimateWithoutVAT"])]
POSITION = [("name", ["@Caption"]), ("code", ["@Code"]), ("unit", ["@Units"]), ("quantity", ["@Quantity", "Quantity/@Result"])]
CAPTION = [("name", ["@Caption"]), ("declared_total", ["@Total"])]
INDEX_VALUES = ["@Pz", "@Sroy", "@Mont", "@Obor", "@Other", "@Mine", "@Oz", "@Em", "@Zm", "@Mt", "@Tr", "@Nr", "@Sp", "@EdPr", "@Fot", "@Gmc"]
LOCAL = [
    ("document", "/Construction", DOCUMENT),
    ("estimate", "/Construction/Object/Estimate", DOCUMENT),
    ("estimate_row", "/Construction/Object/Estimate/Sections/Section/Items/Item/Cost", COST),
    ("formula", "/Construction/Object/Estimate/Sections/Section/Items/Item/(?:Cost/)?QuantityFormula", []),
    ("resource", "/Construction/Object/Estimate/Sections/Section/Items/Item/(?:Cost/)?Resources/[^/]+(?:/Replaced)?", []),
    ("coefficient", "/Construction/Object/Estimate/.+/Coefficients/Coefficient", []),
    ("index", "/Construction/Object/Estimate/.+/Index", []),
    ("accrual", "/Construction/Object/Estimate/.+/(?:Overhead|Profit)", []),
    ("total", "/Construction/Object/Estimate/(?:Sections/Section/SectionPrice/(?:Summary/(?:Total|Price)|Total)|EstimatePrice/.+/(?:Total|Price|PriceBase|PriceCurrent|Final))", TOTAL),
]
RULES = {
    "minstroy.local_estimate_bim.3_01": [(e, p, f + UNIT_PRICE if e == "estimate_row" else f) for e, p, f in LOCAL],
    "minstroy.local_estimate_rim.3_01": LOCAL,
    "minstroy.object_estimate.3_01": [
        ("document", "/Construction", DOCUMENT),
        ("estimate", "/Construction/Object", PART),
        ("estimate_row", "/Construction/Object/LocalEstimate", PART),
        ("total", "/Construction/Object/(?:Summary/[^/]+|Details/.+/(?:Total|Price)|LocalEstimate/Details/.+/(?:Total|Price))", TOTAL),
    ],
    "minstroy.summary_estimate.3_01": [
        ("document", "/Construction", DOCUMENT),
        ("total", "/Construction/Summary", TOTAL),
        ("estimate_row", "/Construction/Chapter(?:[1-9]|1[0-4])/(?:LocalEstimate|ObjectEstimate|Estimate|Cost|Item)", [("name", ["Name"]), ("code", ["Num"]), ("declared_total", ["Total", "Summary/Total"])]),
        ("total", "/Construction/Chapter(?:[1-9]|1[0-4])/.+/(?:Total|Price|Summary|SubSummary)", TOTAL),
    ],
    "minstroy.costs_summary.3_01": [
        ("document", "/Construction", [("name", ["ConstructionSite"])]),
        ("estimate", "/Construction/Costs/Estimate", [("declared_total", ["Total"])]),
        ("total", "/Construction/Costs/(?:Building|Equipment|Other|EstimateTotal|EstimateTotalVAT)", TOTAL),
    ],
    "minstroy.quantity_takeoff.3_01": [
        ("document", "/Construction", [("name", ["ObjectName"])]),
        ("estimate_row", "/Construction/Sections/Section/Works/Work", [("name", ["Name"]), ("unit", ["Unit"]), ("quantity", ["Quantity"])]),
        ("formula", "/Construction/Sections/Section/Works/Work/QuantityFormula", []),
    ],
    "minstroy.market_analysis.4_02": [
        ("document", "/Construction", [("name", ["ObjectName"])]),
        ("KAC", "/Construction/Sections/(?:Section|SectionFSBC)/Items/(?:Item|ItemFSBC)", [("name", ["Name"]), ("unit", ["Unit"])]),
        ("KAC", "/Construction/Sections/(?:Section|SectionFSBC)/Items/(?:Item|ItemFSBC)/Offer", OFFER),
    ],
    "minstroy.explanatory_note_estimate.4_01": [
        ("document", "/Construction", DOCUMENT),
        ("estimate", "/Construction/ObjectDescription/(?:NonIndustrialObject|IndustrialObject|LinearObject)", []),
        ("resource", "/Construction/(?:ObjectDescription|ExplanatoryNoteEstimate)/.+/Resources/Resource", []),
        ("total", "/Construction/ExplanatoryNoteEstimate/.+/(?:Total|Summary)", []),
    ],
    "grandsmeta.local_estimate.2026_1_1": [
        ("document", "/Document", []),
        ("estimate_row", "/Document/Chapters/Chapter/Position", POSITION + [("unit_price", ["PriceCurr/@PZ"]), ("declared_total", ["Itog/ItogRes/@Total"])]),
        ("formula", "/Document/Chapters/Chapter/Position/Quantity", []),
        ("resource", "/Document/Chapters/Chapter/Position/Resources/[^/]+(?:/Replaced)?", []),
        ("coefficient", "/Document/(?:Koefficients/K|Chapters/Chapter/Position/.+/Koefficients/K)", []),
        ("index", "/Document/(?:Indexes/Index|Chapters/Chapter/Position/.+/Index)", []),
        ("accrual", "/Document/(?:AddZatrats/[^/]+|Chapters/Chapter/Position/.+/AddZatrs/AddZatr)", []),
        ("KAC", "/Document/Chapters/Chapter/Position/.+/(?:ConjuncturalAnalysis|KA)/.+", []),
        ("total", "/Document/(?:Itog(?:/.+)?|Chapters/Chapter/(?:Itog|Summary|Total)(?:/.+)?|Chapters/Chapter/Position/Itog/[^/]+)", CAPTION),
    ],
    "grandsmeta.object_or_summary_estimate.2026_1_1": [
        ("document", "/Document", []),
        ("index", "/Document/Indexes/Index", [("name", ["@Caption"]), ("code", ["@Code"]), ("index", INDEX_VALUES, "unique"), ("value", INDEX_VALUES, "unique")]),
        ("estimate_row", "/Document/Chapters/Chapter/Position", [("name", ["@Caption"]), ("code", ["@Obosn"]), ("unit", ["@Units"]), ("quantity", ["@UnitsQty"]), ("unit_price", ["@EdPr"]), ("declared_total", ["Total/@Total"]), ("coefficient", ["@K"])]),
        ("total", "/Document/Chapters/Chapter/(?:Position/(?:Total|Mode_BaseIdx|Mode_BaseNoIdx|Mode_ResCurr)|Total|Summary)(?:/WithIndex)?", CAPTION),
        ("accrual", "/Document/AddCharges/Item", []),
    ],
    "grandsmeta.contract_estimate.2026_1_1": [
        ("document", "/Document", []),
        ("estimate_row", "/Document/Chapters/Chapter/Position", POSITION + [("unit_price", ["Itog/UnitCost/@Total"]), ("declared_total", ["Itog/Total/@Total"])]),
        ("formula", "/Document/Chapters/Chapter/Position/Quantity", []),
        ("accrual", "/Document/AdditionalExpenses/Item", []),
        ("total", "/Document/(?:Itog|Chapters/Chapter/Itog|Chapters/Chapter/Position/Itog/(?:PosTotal|Expense|SubTotal|ExpenseWithK|WithK|UnitCost|Total))", CAPTION),
    ],
    "grandsmeta.market_analysis.2026_1_1": [
        ("document", "/Document", []),
        ("estimate_row", "/Document/Chapters/Chapter/Position", [("name", ["@Caption"]), ("unit", ["@Units"])]),
        ("KAC", "/Document/Chapters/Chapter/Position/(?:Item|Items/Item)", [("name", ["@Caption"]), ("code", ["@Obosn"]), ("unit", ["@Units"]), ("unit_price", ["@OptPrice"]), ("coefficient", ["@IzmRatio"])]),
        ("accrual", "/Document/Chapters/Chapter/Position/(?:Item|Items/Item)/AddZatrs/AddZatr", []),
    ],
    "grandsmeta.quantity_takeoff.2026_1_1": [
        ("document", "/Document", []),
        ("estimate_row", "/Document/Chapters/Chapter/Position", POSITION),
        ("formula", "/Document/Chapters/Chapter/Position/Quantity", []),
    ],
}


def tables(spark: SparkSession, rules: dict = RULES) -> tuple[DataFrame, DataFrame]:
    """Rules (rule, schema_id, entity, pattern) and their field paths (rule, path, field, ordinal, mode); rule is schema:entity:number."""
    own, paths = [], []
    for schema, made in rules.items():
        for n, (entity, pattern, fields) in enumerate(made, 1):
            rule = f"{schema}:{entity}:{n}"
            own.append((rule, schema, entity, pattern))
            for name, options, *mode in fields:
                paths += [(rule, path, name, i, mode[0] if mode else "first") for i, path in enumerate(options)]
    return spark.createDataFrame(own, "rule string, schema_id string, entity string, pattern string"), spark.createDataFrame(paths, "rule string, path string, field string, ordinal int, mode string")
