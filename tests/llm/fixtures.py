"""Documents with the odd cases that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, label string"

LONG = "alpha beta gamma delta " * 30_000


def odd_docs(spark, more=()):
    rows = [
        (1, None, "en", "b", None, 7, "x"),
        (2, "", None, None, 0, 7, "x"),
        (None, "No id here, but some words <|endoftext|> and é — ok\n", "en", "a", 1, 7, None),
        (4, "same words here twice over and over", "en", "a", 1, 7, "x"),
        (4, "same words here twice over and over", "en", "a", 1, 7, "x"),
        (5, "same words here twice over and over", "fr", "\U0001f600", 1, 7, "x"),
        (6, " \t\n\x0b\x0c\r ", "en", "￿", 1, 7, "x"),
        (7, LONG, "en", "b", 1, 7, "x"),
        (8, "x" * 100_000, "en", None, 1, 7, "x"),
        (9, "mail joe.d@ex-ample.org, ring +1 (555) 010-9999 or 10.0.0.255; card 4111 1111 1111 1111.", "en", "b", 1, 7, "x"),
        (-3, "nul \x00 　 wide line \x1c sep", "en", "c", 1, 7, "x"),
        *more,
    ]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
