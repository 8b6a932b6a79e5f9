"""A table of awkward documents, and the same without rows."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, n string, hash string, kept string, n_words string"
LONG = "one two three four five six seven eight nine ten " * 3000
SENTENCE = "The quick brown fox jumps over the lazy dog while seven old friends watch from far away."


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, names that operators use too."""
    extra = ("i", "s", "n", "h", "k", "w")
    rows = [
        (1, SENTENCE, "en", "a", 10, *extra),
        (1, SENTENCE, "en", "a", 10, *extra),
        (2, SENTENCE, None, "a", None, *extra),
        (3, SENTENCE.replace("quick", "slow"), "en", None, 1, *extra),
        (4, None, "en", "a", 0, *extra),
        (5, "", "en", "b", 0, *extra),
        (None, "a text without an id that has more than five words", "en", "b", 0, *extra),
        (None, None, None, None, None, *[None] * 6),
        (6, LONG, "en", "b", 0, *extra),
        (7, " \t\n ", "en", "b", 0, *extra),
        (8, "naïve Ünïcode 漢字 \U0001f600 'll it's 12.5 kg", "fr", "b", 0, *extra),
        (9, "two words", "en", "b", 0, *extra),
        (1, "another text under the id of the first one, which is allowed", "en", "a", 5, *extra),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
