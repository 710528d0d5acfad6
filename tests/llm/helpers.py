"""Small tables with what every operator must bear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Names that operators use inside; a table that has them must come through unharmed.
CLASHING = ("score", "id", "grp", "rest", "budget", "quality_score", "times", "end", "hash", "row", "rank")


def documents(spark: SparkSession, rows: list[tuple], clashing: bool = True) -> DataFrame:
    """Rows of (doc_id, text[, lang, source]) as documents, with columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", None if r[1] is None else len(r[1]), *(["x"] * len(CLASHING) if clashing else [])) for r in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long" + ("".join(f", {c} string" for c in CLASHING) if clashing else "")
    return spark.createDataFrame(full, names)


EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "a b c d e f"), (5, "a b c d e f"), (6, "a b c d e f"), (7, "wide " * 30_000), (8, "x" * 200_000), (9, "Ünïcode 😀 text\nwith lines.\n\n")]


def folder(tmp_path, **tables: DataFrame) -> str:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
