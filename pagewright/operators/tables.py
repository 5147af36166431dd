"""Tables as rows of cells (doc_id, table_id, row, col, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NUMBER = r"^[-−–+]?[0-9]+(?:[.,][0-9]+)?%?$"
LIKE_NUMBER = r"^[-−–+]?[0-9OoIl|.,]+%?$"
UNCLEAR = 50


def doubtful_cells(cells: DataFrame) -> DataFrame:
    """Cells to check, with a reason: ``unclear`` by confidence, ``number`` if unlike the numbers of its column.

    ``cells`` has header_rows and min_conf (negative: unknown). A column is one of numbers
    with at least three of them, and half of its cells.
    """
    table = ["doc_id", "table_id"]
    column, row = W.partitionBy(*table, "col"), W.partitionBy(*table, "row")
    t = F.trim("text")
    rows = cells.withColumn("t", t).withColumn("number", t.rlike(NUMBER))
    body = (F.col("row") >= F.col("header_rows")) & (F.col("t") != "")
    places = F.when(F.col("number") & F.col("t").rlike("[.,]"), F.length(F.regexp_extract("t", r"[.,]([0-9]+)", 1)))
    rows = rows.withColumn("body", body).withColumn("places", F.when(F.col("body"), places)).withColumn("n_body", F.count_if("body").over(column))
    rows = rows.withColumn("n_numbers", F.count_if(F.col("body") & F.col("number")).over(column))
    # the decimals that most numbers of the column have; of equals those seen first
    by_places = W.partitionBy(*table, "col", "places")
    rows = rows.withColumn("have", F.when(F.col("places").isNotNull(), F.struct(F.count("*").over(by_places).alias("n"), (-F.min("row").over(by_places)).alias("first"), F.col("places"))))
    rows = rows.withColumn("decimals", F.max("have").over(column)["places"])
    whole = F.col("number") & ~F.col("t").rlike("[.,]")
    # the other numbers of the row, the headings' too, as the row reads them
    others = F.count_if("number").over(row) - F.when(F.col("number"), 1).otherwise(0)
    pointed = F.count_if(F.col("number") & F.col("t").rlike("[.,]")).over(row) - F.when(F.col("number") & F.col("t").rlike("[.,]"), 1).otherwise(0)
    rows = rows.withColumn("others", others).withColumn("pointed", pointed)
    digits = F.regexp_replace("t", "[^0-9]", "")
    numeric = F.col("body") & (F.col("n_numbers") >= 3) & (F.col("n_numbers") * 2 >= F.col("n_body"))
    letters = ~F.col("number") & F.col("t").rlike(LIKE_NUMBER) & F.col("t").rlike("[OoIl|]")
    missed = whole & F.col("decimals").isNotNull() & (F.length(digits) > F.col("decimals")) & (digits != "0") & ~((F.col("others") > 0) & (F.col("pointed") == 0))
    unclear = (F.col("min_conf") >= 0) & (F.col("min_conf") < UNCLEAR) & (F.col("t") != "")
    why = F.when(unclear, "unclear").when(numeric & (letters | missed), "number")
    return rows.withColumn("why", why).where("why is not null").select(*table, "row", "col", "text", "why")


def cell_confidence(words: DataFrame) -> DataFrame:
    """The lowest confidence of the words of each cell."""
    return words.groupBy("doc_id", "table_id", "row", "col").agg(F.min("confidence").alias("min_conf"))


def reliable(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, reliable) of tables of at least 2 x 2: under 35 % empty and at most 10 columns."""
    shape = cells.groupBy("doc_id", "table_id").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.count_if(F.trim("text") != "").alias("filled"))
    good = (1 - F.col("filled") / (F.col("n_rows") * F.col("n_cols")) < 0.35) & (F.col("n_cols") <= 10)
    return shape.where("n_rows >= 2 and n_cols >= 2").select("doc_id", "table_id", good.alias("reliable"))


def as_text(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, text): cells by tabs, rows by line ends."""
    row = cells.groupBy("doc_id", "table_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("c"))
    row = row.select("doc_id", "table_id", "row", F.array_join(F.transform("c", lambda x: x["text"]), "\t").alias("line"))
    table = row.groupBy("doc_id", "table_id").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("r"))
    return table.select("doc_id", "table_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("text"))


def from_text(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells read back from their text; a table whose shape changed keeps its cells."""
    key = ["doc_id", "table_id"]
    rows = tables.select(*key, F.posexplode(F.split("text", "\n")).alias("row", "line"))
    read = rows.select(*key, "row", F.posexplode(F.split("line", "\t")).alias("col", "put"))
    shape = lambda df: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row", "col"))).alias("shape"))
    fits = shape(read).join(shape(cells.withColumn("row", F.col("row").cast("int")).withColumn("col", F.col("col").cast("int"))), [*key, "shape"], "left_semi").select(*key)
    return cells.join(read.join(fits, key, "left_semi"), [*key, "row", "col"], "left").withColumn("text", F.coalesce("put", "text")).drop("put")
