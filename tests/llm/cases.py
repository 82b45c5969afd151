"""Edge cases and helpers of the tests in this folder."""

LONG = " ".join(f"wort{i % 997} über, the {i}" for i in range(30_000))
BASE = [f"alpha{i} beta{i % 7}" for i in range(60)]

#: Nulls, empty and very long texts, ties, repeated rows, odd characters.
EDGE_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n\r\x0b\x0c "),
    (4, "one two three"),
    (5, "ONE two\tthree"),
    (6, LONG),
    (7, LONG + " tail"),
    (8, " ".join(BASE)),
    (9, " ".join(BASE)),
    (10, " ".join([*BASE, "more", "words"])),
    (11, " ".join(["x"] * 80)),
    (12, "a" * 70_000),
    (13, "don't  stop\n\nwe'll\xa0see   wide <|endoftext|> '''re \x1c sep"),
    (14, "naïve café Ⅷ ² — 東京タワー 🎉🎉 ﬁn é"),
    (15, "1234 5678 !!! ###"),
    (16, "Permission granted. Released under the MIT License. Bye."),
    (None, "a row without an id"),
    (16, "Permission granted. Released under the MIT License. Bye."),
    (17, "the end\n\n  spaced   out \n"),
    (18, "word"),
    (19, "WORD"),
    (20, " " * 1_000_000 + "x"),
]


def by_id(df, key="doc_id"):
    """Rows by id; repeated rows must be equal."""
    out = {}
    for row in df.collect():
        values = row.asDict()
        assert out.setdefault(values[key], values) == values
    return out
