"""Tables found in sheets and recognised pages: runs under headers, lines, columns, candidates, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators.grouped import by_group
from ledgerlens.operators.ranges import dealt

#: A new text line starts where the top is further than this from the first word of the line.
LINE_STEP = 3.0
RELIABLE_CONFIDENCE, HEADER_CONFIDENCE = 60, 90


def islands(rows: DataFrame, key: str = "sheet", number: str = "row") -> DataFrame:
    """(key, first, last, n) of each run of consecutive numbers.

    Runs are found within ranges of (key, number), so a key may have any number of rows. Only a range's first
    and last run of a key can go on in the next range; those are few and joined per key.
    """
    ranged = dealt(rows.select(key, number).distinct(), key, number, part="_part")
    ranked = ranged.withColumn("_r", F.row_number().over(W.partitionBy("_part", key).orderBy(number)))
    runs = ranked.groupBy("_part", key, (F.col(number) - F.col("_r")).alias("_g")).agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n"))
    whole = W.partitionBy("_part", key)
    runs = runs.withColumn("_edge", (F.col("first") == F.min("first").over(whole)) | (F.col("last") == F.max("last").over(whole)))
    along = W.partitionBy(key).orderBy("first")
    edges = runs.where("_edge").withColumn("_new", F.when(F.lag("last").over(along) + 1 == F.col("first"), 0).otherwise(1))
    edges = edges.withColumn("_chain", F.sum("_new").over(along)).groupBy(key, "_chain").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return runs.where("NOT _edge").select(key, "first", "last", "n").unionByName(edges.drop("_chain"))


def header_rows(cells: DataFrame, fields: list[str], least: int = 3) -> DataFrame:
    """(sheet, row, fields): the first row of each sheet with `least` different fields, one of them an anchor.

    cells (sheet, row, field), field already looked up; reduced to one row per sheet row before the choice.
    """
    per = cells.where("field IS NOT NULL").groupBy("sheet", "row").agg(F.count_distinct("field").alias("n"), F.bool_or(F.col("field").isin(fields)).alias("anchored"))
    return per.where((F.col("n") >= least) & F.col("anchored")).groupBy("sheet").agg(F.min("row").alias("row"), F.min_by("n", "row").alias("fields"))


def bodies(lines: DataFrame, key: str, order: str, header: str) -> DataFrame:
    """lines with `under`: the last header at or before each line; lines before any header are dropped."""
    under = F.last(F.when(F.col(header), F.col(order)), ignorenulls=True).over(W.partitionBy(key).orderBy(order))
    return lines.withColumn("under", under).where("under IS NOT NULL AND NOT " + header)


def ocr_words(words: DataFrame) -> DataFrame:
    """words with `reliable`: confident enough and inside the image."""
    inside = (F.col("left") >= 0) & (F.col("top") >= 0) & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("left") + F.col("width") <= F.col("image_width")) & (F.col("top") + F.col("height") <= F.col("image_height"))
    return words.withColumn("reliable", F.coalesce((F.col("conf") >= RELIABLE_CONFIDENCE) & inside, F.lit(False)))


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of reliable words: text in reading order, box, mean and least confidence."""
    spots = F.transform(F.array_sort(F.collect_list(F.struct("left", "word_num", "text"))), lambda s: s["text"])
    return words.where("reliable").groupBy("page", "block", "par", "line").agg(
        F.array_join(spots, " ").alias("text"), F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"),
        F.max(F.col("top") + F.col("height")).alias("y1"), F.avg("conf").alias("mean_conf"), F.min("conf").alias("least_conf"), F.count("*").alias("n"),
    )


def text_lines(words: DataFrame, step: float = LINE_STEP) -> DataFrame:
    """(page, line_no, n, text): words by top then x; a line's first word decides where the next line starts.

    The anchor makes this sequential within a page, and a page is bounded, so pages are grouped.
    """

    def fold(rows: list[tuple]) -> list[tuple]:
        number, anchor, lines = 0, None, {}
        for page, top, x0, text in sorted(rows, key=lambda r: r[1:]):
            if anchor is None or abs(top - anchor) > step:
                number, anchor = number + 1, top
            lines.setdefault(number, []).append((x0, text))
        return [(page, n, len(words), " ".join(t for _, t in sorted(words))) for n, words in lines.items()]

    return by_group(words.select(F.col("page").cast("long").alias("page"), "top", "x0", "text"), "page", fold, "page long, line_no long, n long, text string")


def column_bounds(headers: DataFrame) -> DataFrame:
    """headers (page, table, field, center, image_width) with lo and hi: midpoints between centers, 0 and the width.

    A table two of whose headers have one center has no columns.
    """
    w = W.partitionBy("page", "table").orderBy("center")
    level = W.partitionBy("page", "table", "center")
    headers = headers.withColumn("_same", F.count("*").over(level)).withColumn("_same", F.max("_same").over(W.partitionBy("page", "table"))).where("_same = 1").drop("_same")
    lo = F.coalesce((F.lag("center").over(w) + F.col("center")) / 2, F.lit(0.0))
    hi = F.coalesce((F.lead("center").over(w) + F.col("center")) / 2, F.col("image_width").cast("double"))
    return headers.withColumns({"lo": lo, "hi": hi, "is_last": F.lead("center").over(w).isNull()})


def assign_columns(words: DataFrame, bounds: DataFrame) -> DataFrame:
    """Each word with the column of its table that holds its center; the last column is closed on the right.

    Equal page and table join first, the range is checked after; a table has a handful of columns.
    """
    held = (F.col("center") >= F.col("lo")) & ((F.col("center") < F.col("hi")) | (F.col("is_last") & (F.col("center") == F.col("hi"))))
    return words.join(bounds.select("page", "table", "field", "lo", "hi", "is_last"), ["page", "table"]).where(held).drop("lo", "hi", "is_last")


def row_candidates(cells: DataFrame, required: list[str], confidence: int = HEADER_CONFIDENCE) -> DataFrame:
    """(page, table, line, fields) of lines that have every required field once and confident."""
    per = cells.groupBy("page", "table", "line").agg(F.count_distinct("field").alias("fields"), F.count("field").alias("all"), F.min("conf").alias("least"), F.array_sort(F.collect_set("field")).alias("names"))
    full = F.size(F.array_except(F.array(*map(F.lit, required)), F.col("names"))) == 0
    return per.where(full & (F.col("all") == F.col("fields")) & (F.col("least") >= confidence)).select("page", "table", "line", "fields")


def attested(candidates: DataFrame, attestations: DataFrame, values: list[str]) -> DataFrame:
    """(source_path, candidate_id, outcome): promoted, required, duplicate or mismatch; repeated candidates are refused.

    Both sides are reduced to one row per key with its count before they are joined.
    """
    key = ["source_path", "candidate_id"]
    told = attestations.groupBy(*key).agg(F.count("*").alias("n"), *[F.min(v).alias(f"seen_{v}") for v in values])
    own = candidates.groupBy(*key).agg(F.count("*").alias("copies"), *[F.min(v).alias(v) for v in values])
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"seen_{v}"))
    outcome = F.when(F.col("copies") > 1, "duplicate_candidate").when(F.col("n").isNull(), "attestation_required").when(F.col("n") > 1, "duplicate_attestation").when(same, "promoted").otherwise("mismatch")
    return own.join(told, key, "left").select(*key, outcome.alias("outcome"))


def running_budget(rows: DataFrame, key: str, order: list[str], size: str, limit: int, entries: int | None = None) -> DataFrame:
    """rows with `used` (their key's sum so far, in order) and `accepted` (within the limit, and among the first `entries` if given).

    Rows are dealt into ranges of (key, order); sums run within a range and start from what the key has in
    earlier ranges, so a key may have any number of rows.
    """
    ranged = dealt(rows, key, *order, part="_part")
    here = ranged.withColumn("_sum", F.sum(size).over(W.partitionBy("_part", key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    here = here.withColumn("_no", F.row_number().over(W.partitionBy("_part", key).orderBy(*order)))
    sums = ranged.groupBy(key, "_part").agg(F.sum(size).alias("_s"), F.count("*").alias("_n"))
    so_far = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, 0)
    ahead = sums.withColumns({"_ahead": F.sum("_s").over(so_far) - F.col("_s"), "_before": F.sum("_n").over(so_far) - F.col("_n")}).drop("_s", "_n")
    fits = (F.col("used") <= limit) & (F.lit(True) if entries is None else F.col("_no") + F.col("_before") <= entries)
    return here.join(ahead, [key, "_part"]).withColumn("used", F.col("_sum") + F.col("_ahead")).withColumn("accepted", fits).drop("_part", "_sum", "_ahead", "_no", "_before")


def page_budget(pages: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """(key, accepted, used, n): pages in order that fit what is left; a page that doesn't fit uses nothing."""
    got = page_budgets(pages, key, order, {size: limit})
    return got.select(key, "accepted", F.col("used")[size].alias("used"), "n")


def page_budgets(pages: DataFrame, key: str, order: str, limits: dict[str, int]) -> DataFrame:
    """(key, accepted, used, n, pages): pages in order that fit what is left of every budget, such as words, characters, cells, recognised pages or pixels.

    A page that doesn't fit one of them uses nothing of any. The budget isn't a running sum, so each document's
    sizes (2,000 pages at most) are folded in order. `used` is by budget, `pages` lists the accepted ones.
    """
    names = list(limits)
    rows = F.array_sort(F.collect_list(F.struct(order, *[F.col(n).cast("long").alias(n) for n in names])))
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in names], F.array().cast(f"array<{pages.schema[order].dataType.simpleString()}>").alias("_kept"))

    def step(a, x):
        fits = F.lit(True)
        for n in names:
            fits = fits & (a[n] + x[n] <= limits[n])
        return F.when(fits, F.struct(*[(a[n] + x[n]).alias(n) for n in names], F.array_append(a["_kept"], x[order]).alias("_kept"))).otherwise(a)

    done = pages.groupBy(key).agg(rows.alias("_rows")).select(key, F.size("_rows").cast("long").alias("n"), F.aggregate("_rows", zero, step).alias("_done"))
    used = F.create_map(*[x for n in names for x in (F.lit(n), F.col("_done")[n])])
    return done.select(key, F.size("_done._kept").cast("long").alias("accepted"), used.alias("used"), "n", F.col("_done._kept").alias("pages"))


def corrections(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, outcome) of correction requests (id, target, status, expected_old, replacement) against cells (target, value).

    outcome: duplicate_target, target_not_found, stale, active_content, comment (disputed) or replace.
    """
    counts = requests.groupBy("target").agg(F.count("*").alias("wanted"))
    there = cells.groupBy("target").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    active = F.col("replacement").cast("string").rlike(r"^\s*[=+\-@]")
    outcome = (
        F.when(F.col("wanted") > 1, "duplicate_target").when(F.col("n").isNull() | (F.col("n") > 1), "target_not_found").when(~F.col("value").eqNullSafe(F.col("expected_old")), "stale")
        .when(active, "active_content").when(F.col("status") == "disputed", "comment").otherwise("replace")
    )
    return requests.join(counts, "target").join(there, "target", "left").select("id", outcome.alias("outcome"))
