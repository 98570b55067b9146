"""The odd rows, for tests that compute what they should give."""

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "Hello World"), (5, "hello world"), (5, "hello world"), (None, "no id"), (6, "x" * 50_000), (7, "word " * 30_000), (8, "ÀÉÎ émoji 😀 \u0000 zero"), (9, "!!! ??? ---"),
]
