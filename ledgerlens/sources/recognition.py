"""Recognised pages: words of recogniser output, candidate rows of tables, and their validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions import decimals, text
from ledgerlens.operators import tables

#: Words of a page that are read, and candidates of a page: also at most a fifth of its words.
PAGE_WORDS, PAGE_CANDIDATES, SHARE = 200_000, 2_000, 5
# The fields that a candidate must have, those of them that are numbers, and the form of its id.
REQUIRED = ["name", "unit", "quantity", "unit_price", "declared_total"]
NUMBERS = ["quantity", "unit_price", "declared_total"]
CANDIDATE_ID = r"^page:([1-9][0-9]*):ocr-table:([1-9][0-9]*):row:([1-9][0-9]*)$"
PIXELS, SIDE = 25_000_000, 10_000


def words(pages: DataFrame) -> DataFrame:
    """Words of pages (source_path, page, tsv, image_width, image_height, rotation): twelve columns a line, the first line a header.

    Lines of another shape or without text are passed over; `word_num` counts the rest, and beyond PAGE_WORDS
    none is read. `reliable` words are confident and inside the image; others have a `reason`.
    """
    line = pages.select(*[c for c in pages.columns if c != "tsv"], F.posexplode(F.split("tsv", "\r\n|[\n\r]")).alias("at", "line")).where("at > 0")
    parts = line.withColumn("p", F.split("line", "\t", 12)).where(F.size("p") == 12).withColumn("text", text.trimmed(F.col("p")[11])).where("text <> ''")
    numbered = parts.withColumn("word_num", F.row_number().over(W.partitionBy("source_path", "page").orderBy("at"))).where(F.col("word_num") <= PAGE_WORDS)
    whole = lambda i: text.trimmed(F.col("p")[i]).try_cast("int")
    out = numbered.select("source_path", "page", "image_width", "image_height", "rotation", "word_num", "text", *[whole(i).alias(n) for i, n in ((2, "block"), (3, "par"), (4, "line"), (6, "left"), (7, "top"), (8, "width"), (9, "height"))], text.trimmed(F.col("p")[10]).try_cast("double").alias("conf"))
    out = tables.ocr_words(out.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in ("block", "par", "line", "left", "top", "width", "height", "conf")])))
    inside = (F.col("left") >= 0) & (F.col("top") >= 0) & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("left") + F.col("width") <= F.col("image_width")) & (F.col("top") + F.col("height") <= F.col("image_height"))
    return out.withColumn("reason", F.when(F.col("reliable"), None).when(~inside, "invalid_bbox").otherwise("low_confidence"))


def summary(found: DataFrame) -> DataFrame:
    """(source_path, page, text, mean_conf, lines, reliable, low) of the words of each page."""
    spots = F.transform(F.array_sort(F.collect_list(F.when(F.col("reliable"), F.struct("word_num", "text")))), lambda s: s["text"])
    return found.groupBy("source_path", "page").agg(
        F.array_join(spots, " ").alias("text"), F.avg(F.when(F.col("reliable"), F.col("conf"))).alias("mean_conf"),
        F.count_distinct(F.when(F.col("reliable"), F.struct("block", "par", "line"))).alias("lines"), F.count_if("reliable").alias("reliable"), F.count_if(~F.col("reliable")).alias("low"),
    )


def headers(found: DataFrame) -> DataFrame:
    """(source_path, page, table, block, par, line, field, center, image_width): lines that have every required header once, all confident.

    A line that repeats a field is ambiguous and no header. Tables are numbered in reading order.
    """
    line = ["source_path", "page", "block", "par", "line"]
    named = found.where("reliable").withColumn("field", text.lookup(text.SCAN_HEADERS, text.scan_header(F.col("text")))).where(F.col("field").isin(*REQUIRED))
    per = named.groupBy(*line).agg(F.count("*").alias("n"), F.count_distinct("field").alias("fields"), F.min("conf").alias("least"))
    fit = per.where((F.col("n") == len(REQUIRED)) & (F.col("fields") == len(REQUIRED)) & (F.col("least") >= tables.HEADER_CONFIDENCE)).select(*line)
    fit = fit.withColumn("table", F.row_number().over(W.partitionBy("source_path", "page").orderBy("block", "par", "line")))
    return named.join(fit, line).select(*line, "table", "field", (F.col("left") + F.col("width") / 2.0).alias("center"), "image_width")


def candidates(found: DataFrame) -> DataFrame:
    """Candidate rows: (source_path, page, table, row, candidate_id, fields, confidence, bbox, table_bbox, cells, ...).

    Lines under a header belong to its table up to the next one; a word belongs to the column that holds its
    middle. A candidate has confident words in every required column and numbers where numbers are due, and a
    page has a bounded number of them. Pages are bounded, so their lines are ordered within them.
    """
    line, page = ["source_path", "page", "block", "par", "line"], ["source_path", "page"]
    heads = headers(found)
    order = F.struct("block", "par", "line")
    lines = found.where("reliable").select(*line).distinct().join(heads.select(*line, "table").distinct(), line, "left")
    w = W.partitionBy(*page).orderBy("block", "par", "line")
    under = lines.withColumn("under", F.last("table", ignorenulls=True).over(w)).where("under IS NOT NULL AND table IS NULL").select(*line, F.col("under").alias("table"))
    bounds = tables.column_bounds(heads.withColumn("page", F.struct("source_path", "page")).select("page", "table", "field", "center", "image_width"))
    middle = found.where("reliable").join(under, line).withColumns({"center": F.col("left") + F.col("width") / 2.0, "key": F.struct("source_path", "page")})
    held = tables.assign_columns(middle.drop("page", "source_path").withColumnRenamed("key", "page"), bounds).where(F.col("field").isin(*REQUIRED))
    box = lambda c: F.array(F.min(c("left")), F.min(c("top")), F.max(c("left") + c("width")), F.max(c("top") + c("height")))
    words_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "word_num", "text"))), lambda s: s["text"]), " ")
    cell = held.groupBy("page", "table", "block", "par", "line", "field").agg(words_of.alias("text"), F.min("conf").alias("confidence"), box(F.col).alias("bbox"), F.first("image_width").alias("image_width"), F.first("image_height").alias("image_height"), F.first("rotation").alias("rotation"))
    per = cell.groupBy("page", "table", "block", "par", "line").agg(F.array_sort(F.collect_list(F.struct("field", "text", "confidence", "bbox"))).alias("cells"), F.min("confidence").alias("confidence"), *[F.first(n).alias(n) for n in ("image_width", "image_height", "rotation")])
    number = F.forall(F.filter("cells", lambda c: c["field"].isin(*NUMBERS)), lambda c: decimals.written(text.trimmed(c["text"])))
    fit = per.where((F.size("cells") == len(REQUIRED)) & (F.col("confidence") >= tables.HEADER_CONFIDENCE) & number)
    fit = fit.select(F.col("page.source_path").alias("source_path"), F.col("page.page").alias("page"), *[c for c in fit.columns if c != "page"])
    most = found.groupBy(*page).agg(F.least(F.lit(PAGE_CANDIDATES), F.floor(F.count_if("reliable") / SHARE)).alias("most"))
    ranked = fit.withColumn("rank", F.row_number().over(W.partitionBy(*page).orderBy("table", order))).join(most, page).where("rank <= most")
    ranked = ranked.withColumn("row", F.row_number().over(W.partitionBy(*page, "table").orderBy(order)))
    whole = found.where("reliable").join(heads.select(*line, "table").distinct(), line).groupBy(*page, "table").agg(box(F.col).alias("head"))
    side = lambda f, i: f(F.transform("cells", lambda c: c["bbox"][i]))
    bbox = F.array(side(F.array_min, 0), side(F.array_min, 1), side(F.array_max, 2), side(F.array_max, 3))
    out = ranked.withColumn("bbox", bbox).join(whole, [*page, "table"])
    around = F.array(F.least(F.col("bbox")[0], F.col("head")[0]), F.least(F.col("bbox")[1], F.col("head")[1]), F.greatest(F.col("bbox")[2], F.col("head")[2]), F.greatest(F.col("bbox")[3], F.col("head")[3]))
    name = F.concat(F.lit("page:"), "page", F.lit(":ocr-table:"), "table", F.lit(":row:"), "row")
    fields = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["field"], c["text"])))
    return out.select(*page, "table", "row", name.alias("candidate_id"), fields.alias("fields"), "confidence", "bbox", around.alias("table_bbox"), "cells", "image_width", "image_height", "rotation")


def _box_in(box: Column, width: Column, height: Column) -> Column:
    return (F.size(box) == 4) & (box[0] >= 0) & (box[1] >= 0) & (box[0] < box[2]) & (box[1] < box[3]) & (box[2] <= width) & (box[3] <= height)


def _nested(outer: Column, inner: Column) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def validated(found: DataFrame) -> DataFrame:
    """found with `fault`: why a candidate of any origin can't be trusted with promotion; null if it can.

    Its id must name its page, table and row; boxes must nest, from cell through row and table to image; every
    required field must be there once, say what its cell says, be confident, and be a number where one is due.
    """
    c = F.col
    named = lambda i, n: F.regexp_extract("candidate_id", CANDIDATE_ID, i).try_cast("int") == c(n)
    sized = (c("image_width").between(1, SIDE)) & c("image_height").between(1, SIDE) & (c("image_width").cast("long") * c("image_height") <= PIXELS) & c("rotation").isin(0, 90, 180, 270)
    boxed = _box_in(c("bbox"), c("image_width"), c("image_height")) & _box_in(c("table_bbox"), c("image_width"), c("image_height")) & _nested(c("table_bbox"), c("bbox"))
    sure = lambda x: F.coalesce((x >= tables.HEADER_CONFIDENCE) & (x <= 100), F.lit(False))
    names = F.array(*map(F.lit, sorted(REQUIRED)))
    whole = F.array_sort(F.map_keys("fields")).eqNullSafe(names) & F.array_sort(F.transform("cells", lambda x: x["field"])).eqNullSafe(names)
    said = F.forall("cells", lambda x: (x["text"] == F.try_element_at("fields", x["field"])) & (text.trimmed(x["text"]) != "") & sure(x["confidence"]) & _box_in(x["bbox"], c("image_width"), c("image_height")) & _nested(c("bbox"), x["bbox"]))
    number = F.forall(F.array(*map(F.lit, NUMBERS)), lambda n: decimals.written(text.trimmed(F.try_element_at("fields", n))))
    tests = [("identity", c("candidate_id").rlike(CANDIDATE_ID) & named(1, "page") & named(2, "table") & named(3, "row")), ("image", sized), ("geometry", boxed), ("confidence", sure(c("confidence"))), ("fields", whole), ("cells", said), ("numbers", number)]
    fault = reduce(lambda rest, t: F.when(~F.coalesce(t[1], F.lit(False)), t[0]).otherwise(rest), tests[::-1], F.lit(None).cast("string"))
    return found.withColumn("fault", fault)
