"""Small inputs that every operator has to take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en"):
    """Documents with ids from 0; a text may be None."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows."""
    rows = [
        (0, None, None, None, None),
        (1, "", "en", "a", 0),
        (2, " \n\t ", "en", "a", 4),
        (3, "one", "en", "a", 3),
        (4, "one two three four five\n" * 3, "en", "a", 1),
        (4, "one two three four five\n" * 3, "en", "a", 1),
        (5, "word " * 30_000, "en", "a", 1),
        (None, "some text without an id", "en", "a", 1),
        (6, "Ünïcödé   spaces here \x1f and   there 🙂🙂", None, "a", 1),
        (7, "x" * 200_000, "de", None, 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df):
    """Extra columns whose names the operators may use themselves."""
    from pyspark.sql import functions as F

    for name in ("shard", "slot", "fp", "node", "component", "component_id", "score", "kept", "n_words", "length", "piece", "chunk", "bucket", "size", "toxic", "l_id", "row", "bits", "rank", "held_out"):
        df = df.withColumn(name, F.lit("clash"))
    return df
