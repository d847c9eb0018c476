"""Rows that every operator must stand."""

SCHEMA = "doc_id long, text string, id string, kept string, score string, line_dedup string, box string, n long, row string, _text string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", 1, "x", "x") for i, t in rows], SCHEMA)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))

#: Null and blank texts, a null key, repeated rows, equal texts, marks beyond ASCII, a very long text.
AWKWARD = [
    (5, None), (6, ""), (7, " \n\t "), (None, "a text without a key that is long enough"), (8, "one"), (8, "one"),
    (3, "the same text twice in the table"), (2, "the same text twice in the table"), (9, "the  same\ttext twice in the table"),
    (10, "été à la plage 中文 😀   end"), (11, LONG), (12, "x" * 50_000), (13, "I!!! .,; 12 345"), (14, "\x00\x01 odd"),
]
