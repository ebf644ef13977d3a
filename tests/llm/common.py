"""Fixtures of the operators' tests."""

#: id, text: nulls, empty, ties, repeated rows, white space of all kinds, a very long text.
EDGE = [(1, "a b c d e f g h i j k l m n o p q r s t u v w"), (2, "x a b c d e f g h i j k l m n o p q r s t y"),
        (3, None), (4, ""), (5, " \n\t\x0b\x0c\r "), (6, "one"), (7, "one"), (8, "É x\x1cy z"),
        (9, " ".join(f"w{i % 997}" for i in range(30_000))), (10, "line one here\nline two here\n\n \nline three\nlast 10"),
        (11, "first 11\nline one here\nline two here  \nline three"), (12, "line one here\nline two here\n\n \nline three\nlast 10")]

#: Extra columns whose names the operators use themselves.
EXTRA = "id long, block long, n_words long, size long, kept boolean, key string, doc long, h string, copies int"


def documents(spark, rows, partitions=3):
    """Documents with clashing extra columns."""
    full = [(i, t, "en", "s0", len(t or ""), *([0] * 4), True, "k", 0, "h", 1) for i, t in rows]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8], r[9], r[10], r[11], r[12], r[13]) for r in full],
                                 schema).repartition(partitions)


def words(text):
    return (text or "").encode().split()
