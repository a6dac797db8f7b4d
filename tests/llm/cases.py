"""Rows that every operator on documents must take: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

LONG = "word " * 30_000 + "x" * 20_000

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "s1"), (2, None, "s1"), (3, "", None), (4, LONG, "s2"), (None, "No key here", "s2"), (5, "Same text twice", None),
    (5, "Same text twice", None), (6, "  \n\t ", "s1"), (7, "naïve ÇA İstanbul ΣΑΣ 日本語 é <|endoftext|> it's 'll 123½", "s3"),
]


def documents(spark, rows=None):
    """With columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(DOCS if rows is None else rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("x") for c in ("key", "size", "score", "n_words", "fp", "held_out", "taken", "id")})
