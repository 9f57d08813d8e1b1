"""Awkward texts that every operator has to take."""

LONG = ("alpha beta gamma delta " * 20_000).strip()  # 80,000 words
ONE_WORD = "x" * 50_000

AWKWARD = [
    (None, None),
    (None, "a row without an id"),
    (0, None),
    (1, ""),
    (2, " \n\t "),
    (3, "word"),
    (4, "word"),
    (4, "word"),
    (5, " marks  and \x00 signs \U0001f600"),
    (6, LONG),
    (7, ONE_WORD),
    (8, "\n\n\n"),
    (9, "été naïve façade — “quotes”"),
]
