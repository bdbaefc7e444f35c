"""Small tables with what every operator must bear."""

LONG = "word " * 30_000


def documents(spark, texts, first=0):
    """documents with extra columns whose names clash with those that operators use inside."""
    rows = [(first + i if not isinstance(t, tuple) else t[0], t[1] if isinstance(t, tuple) else t, "en", "src0", 0, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, n_words int")


EDGE = [None, "", "   \n\t ", "a", LONG, "same text here for both rows", "same text here for both rows", (None, "no id at all"), (5, "an id that comes twice")]
