"""Small tables with the cases every operator must handle."""

LONG = "long words and more words, " * 20_000

ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta.", "en", "a"),
    (2, "alpha BETA gamma delta epsilon zeta eta theta.", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, " \t\n", "de", "b"),
    (6, "one two", "en", "a"),
    (6, "one two", "en", "a"),
    (7, "Ünïcödé ÀÉ 漢字 😀 text\nwith lines\n\n# and a heading", "fr", "c"),
    (8, LONG, "en", "a"),
    (None, "a row without an id", "en", "a"),
    (None, "another row without an id", "en", None),
    (10, "one two", "en", "b"),
]


def documents(spark, rows=ROWS):
    """ROWS with columns that clash with names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, _id int, _text string, score string, set string, n long, label string"
    return spark.createDataFrame([(*r, 1, "x", "y", "z", 2, "w") for r in rows], schema)


def empty(spark):
    return documents(spark, [])
