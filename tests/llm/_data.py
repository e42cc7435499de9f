"""Small tables with the awkward cases that every operator must take."""

LONG = "palabra larga y otra mas. " * 4000

DOCS = [
    (1, "The cat sat on the mat. It's here.", "en", "a", 3),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (4, "déjà vu 🙂 naïve\n\nzwei  Leerzeichen\tTab nbsp x́", "fr", "b", 1),
    (5, LONG, "es", "b", len(LONG)),
    (6, "The cat sat on the mat. It's here.", "en", "c", 3),
    (6, "The cat sat on the mat. It's here.", "en", "c", 3),
    (7, "  \n\t ", "en", None, 3),
    (None, "no id at all", "en", "a", 9),
    (8, "don't <|endoftext|> 12345 ???", "en", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=DOCS):
    """The rows, with extra columns whose names operators use for themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for extra in ("size", "ids", "raw", "kept", "target", "u", "words", "score", "line", "fingerprint"):
        df = df.withColumn(extra, F.lit("x"))
    return df
