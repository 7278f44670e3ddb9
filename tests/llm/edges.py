"""Rows that operators meet at the edges."""

#: Texts that operators meet at the edges; every row has odd extra columns too.
LONG = "word " * 40_000 + "x" * 100_000 + " a@b.co " + "# " * 2_000
ROWS = [
    (None, "no id here but some text to read", "a"), (1, None, "b"), (2, "", None), (3, " \n\t ", "c"), (4, LONG, "d"),
    (5, "same text twice in two rows", "e"), (6, "same text twice in two rows", "e"), (7, "repeated row", "f"), (7, "repeated row", "f"), (8, "ünïcode ß 中文 \U0001f600 é<|endoftext|> it's  two  spaces\r\nline", "g"),
    (9, "the cat sat on the mat and the dog lay by the door of the old house in the town " * 3, "h"), (100, "mail me: jane.doe@example.org or +44 20 7946 0958, 10.0.0.1, 4111 1111 1111 1111", "i"), (-3, "one", None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, words string, f long, rank int, `odd name` string, k long, carried int"
