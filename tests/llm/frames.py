"""Document tables with every awkward case the operators define."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, curve_key long, first string"


def documents(spark, rows):
    """rows: (doc_id, text[, lang]); extra columns clash with names the operators use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 0.5, True, 7, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"word{i % 997}x{i % 89}" for i in range(60_000))
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three four five"), (6, "one two three four five"), (6, "one two three four five"), (None, "no id here at all"),
    (7, LONG), (8, "É漢字 \U0001f600 <|endoftext|> x"), (9, "\u00a0\u2003tabs\x0b\x0cand\u0085more"), (10, "aaaa aaaa aaaa aaaa " * 50), (-3, "negative id with some words here"),
]
