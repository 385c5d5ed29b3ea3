"""Small tables that every operator and stage must take."""

import os

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns that look like the operators' own.
CLASH = ("score", "kept", "size", "bucket", "batch", "class_id", "row", "at", "pass", "spans", "text_id",
         "n_tokens", "digest")

LONG = "lorem ipsum dolor sit amet " * 20_000


def odd_docs(spark, clash=True):
    rows = [(1, "one two three four five six seven", "en", "a", 33), (2, None, "en", "a", None),
            (3, "", None, None, 0), (4, "one two three four five six seven", "en", "b", 33),
            (4, "one two three four five six seven", "en", "b", 33), (None, "No id here", "de", "a", 10),
            (6, LONG, "fr", "", len(LONG)), (7, "ONE two three four five six seven", "en", "a", 33),
            (8, "  \n\t ", "en", "a", 5), (9, "!!! ??? 🙂", None, "z", 9), (10, "é" * 50, "fr", "a", 50)]
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        for c in CLASH:
            df = df.selectExpr("*", f"'x' AS {c}")
    return df


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def folder(spark, base, name="t", **tables):
    """A folder laid out like the driver's, with the given tables."""
    path = os.path.join(base, name)
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{t}.parquet")
    return path
