"""Small documents with what every operator must take: nulls, blanks, repeats, ties, a long text and columns of clashing names."""

LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
TEXTS = [
    (1, BASE, "a"), (2, BASE, "a"), (3, BASE.upper(), None), (4, None, "b"), (5, "", "b"), (6, "  \n ", "c"), (7, "short", "c"), (8, "short", "c"), (None, BASE, "a"),
    (9, LONG, "a"), (9, LONG, "a"), (10, BASE + " x", "b"), (11, "entirely other words that nobody else in here has written down so far", None), (None, None, None),
]
CLASHES = "key string, n int, row int, size int, h int, _id long, linked int, id int, v int, comp string, cell int, score double, rank int"


def documents(spark, rows=TEXTS):
    """doc_id, text, lang, source, n_chars and further columns."""
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
    extra = (None,) * len(CLASHES.split(", "))
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *extra) for i, t, s in rows], schema)
