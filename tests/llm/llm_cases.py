"""Rows that every operator has to bear."""

SF = "/root/testdata/sf0.001"

#: Names that the operators use inside; tables may have columns of these names too.
CLASHING = ("n", "line", "h1", "h2", "fp", "component", "component_id", "rest", "spans", "w", "h", "lines", "bucket", "key",
            "block", "kept", "fail_bits", "found", "band", "__other")
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
TRICKY = [
    (1, WORDS), (2, WORDS), (2, WORDS), (3, WORDS.upper()), (4, None), (5, ""), (6, "  \n\t\n "), (None, "a text without an id"),
    (None, None), (7, "x" * 200_000), (8, ("word " * 30_000).strip()), (9, "é日本 émile x 😀 token = \"abcdef123456\""),
    (10, "\n".join(["the same line again and again"] * 50)), (11, WORDS + "\n" + WORDS), (12, "## $$ %% && || <>"),
]
