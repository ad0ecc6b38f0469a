"""Documents with columns whose names clash with those used inside the operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, crc long, block int, part string, rank int, label int, q string, score double"


def make(spark, rows):
    """Documents with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), "own", 7, 3, "p", 9, 5, "q", 0.5) for i, t, la, s in rows], SCHEMA)
