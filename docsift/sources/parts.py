"""Documents put together from rows: pages, paragraphs and spreadsheet cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docsift.functions.text import is_blank, py_strip


def column_letter(index: Column, longest: int = 7) -> Column:
    """Spreadsheet letters of a 0-based column number: A to Z, AA, AB and so on."""
    rest, letters = index.cast("bigint"), []
    for _ in range(longest):
        letters.append(F.when(rest >= 0, F.char(F.lit(65) + F.pmod(rest, F.lit(26)))).otherwise(""))
        rest = F.floor(rest / 26) - 1
    return F.when(index < 0, "?").otherwise(F.concat(*reversed(letters)))


def paged_documents(pages: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """Non-empty page texts in page order, each closed by a line end.

    A document without any text becomes a placeholder and is ``metadata_only``.
    """
    closed = F.when(F.col(text) != "", F.concat(F.col(text), F.lit("\n")))
    grouped = pages.select(doc, page_no, closed.alias("__page")).groupBy(doc).agg(
        F.count("*").alias("pages"),
        F.expr(f"listagg(__page, '') within group (order by `{page_no}`)").alias("__text"),
    )
    has_text = ~is_blank(F.col("__text"))
    note = F.concat(
        F.lit("[PDF document with "), F.col("pages").cast("string"), F.lit(" pages - no extractable text content]")
    )
    return grouped.select(
        doc,
        F.lit("pdf").alias("type"),
        F.when(has_text, F.col("__text")).otherwise(note).alias("content"),
        F.when(has_text, "file_content").otherwise("metadata_only").alias("match_source"),
        "pages",
        has_text.alias("has_text_content"),
    )


def paragraph_documents(paragraphs: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Paragraph texts in order, joined by line ends."""
    return (
        paragraphs.groupBy(doc)
        .agg(F.expr(f"listagg(coalesce(`{text}`, ''), '\\n') within group (order by `{order}`)").alias("content"))
        .select(
            doc,
            F.lit("document").alias("type"),
            "content",
            F.lit("file_content").alias("match_source"),
            F.lit("bert").alias("embedding_type"),
        )
    )


def table_to_cells(
    table: DataFrame, doc: Column, sheet_no: int, sheet: str, row: Column, columns: list[str], header: bool = True
) -> DataFrame:
    """Turn table rows into spreadsheet cells; ``row`` is the physical row number.

    With ``header`` the column names fill row 1 of every document.
    """
    values = F.array(*[F.col(name).cast("string") for name in columns])

    def cells(source: DataFrame, number: Column, values: Column) -> DataFrame:
        return source.select(
            F.col("__doc").alias("doc"),
            F.lit(sheet_no).alias("sheet_no"),
            F.lit(sheet).alias("sheet"),
            number.cast("bigint").alias("row"),
            F.posexplode(values).alias("col", "value"),
        )

    keyed = table.withColumns({"__doc": doc, "__row": row})
    body = cells(keyed, F.col("__row"), values)
    if not header:
        return body
    names = F.array(*[F.lit(name) for name in columns])
    return body.unionByName(cells(keyed.select("__doc").distinct(), F.lit(1), names))


def cells_documents(cells: DataFrame, legacy_zeros: bool = False) -> DataFrame:
    """Spreadsheet text and facts from ``doc, sheet_no, sheet, row, col, value``.

    Rows count from 1 and columns from 0. A sheet without a filled cell still
    needs one row with a null value. ``legacy_zeros`` also drops rows whose
    only values are zero, as the older workbook format does.
    """
    value = py_strip(F.col("value").cast("string"))
    filled = F.coalesce(value != "", F.lit(False))
    shown = F.concat(column_letter(F.col("col")), F.col("row").cast("string"), F.lit(": "), value)
    zero = F.coalesce(value.try_cast("double") == 0, F.lit(False))
    counts = filled & ~zero if legacy_zeros else filled

    # Dealt by document once; rows, sheets and documents are then put together where their cells are.
    by_row = (
        cells.withColumns({"__shown": F.when(filled, shown), "__counts": counts})
        .select("doc", "sheet_no", "sheet", "row", "col", "__shown", "__counts")
        .repartition("doc")
        .groupBy("doc", "sheet_no", "sheet", "row")
        .agg(
            F.max("col").alias("last_col"),
            F.count("__shown").alias("cells"),
            F.bool_or("__counts").alias("keep"),
            F.expr("listagg(__shown, ' | ') within group (order by col)").alias("texts"),
        )
    )
    line = F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(": "), F.col("texts"), F.lit("\n"))
    by_sheet = (
        by_row.withColumn("__line", F.when(F.col("keep"), line))
        .groupBy("doc", "sheet_no", "sheet")
        .agg(
            F.max("row").alias("rows"),
            (F.max("last_col") + 1).alias("cols"),
            F.sum(F.when(F.col("keep"), F.col("cells")).otherwise(0)).alias("cells"),
            F.count("__line").alias("lines"),
            F.expr("listagg(__line, '') within group (order by row)").alias("body"),
        )
    )
    name, size = F.col("sheet"), F.concat(F.col("rows").cast("string"), F.lit(" rows × "), F.col("cols").cast("string"))
    full = F.concat(F.lit("\n[Sheet: "), name, F.lit("]\nDimensions: "), size, F.lit(" columns\n\n"), F.col("body"))
    empty = F.concat(F.lit("\n[Sheet: "), name, F.lit("] - Empty sheet\n"))
    info = F.concat(name, F.lit(":"), F.col("rows").cast("string"), F.lit("x"), F.col("cols").cast("string"))
    staged = by_sheet.withColumns({"__text": F.when(F.col("lines") > 0, full).otherwise(empty), "__info": info})
    joined = staged.groupBy("doc").agg(
        F.expr("listagg(__text, '\\n') within group (order by sheet_no)").alias("content"),
        F.count("*").alias("total_sheets"),
        F.sum("rows").cast("bigint").alias("total_rows"),
        F.sum("cells").cast("bigint").alias("total_cells"),
        F.count_if(F.col("lines") > 0).alias("sheets_with_data"),
        F.expr("listagg(sheet, ',') within group (order by sheet_no)").alias("sheet_names"),
        F.expr("listagg(__info, '; ') within group (order by sheet_no)").alias("sheet_info"),
    )
    return joined.withColumns(
        {
            "type": F.lit("excel"),
            "match_source": F.lit("file_content"),
            "has_data": (F.col("total_cells") > 0).cast("bigint"),
        }
    )
