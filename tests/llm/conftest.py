import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with outputs."""
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", None), (4, "a", None, "s"), (5, "word " * 30_000, "en", "s"), (6, "x" * 60_000, "en", "s"), (7, "the same words stand here in this text", "en", "s"), (7, "the same words stand here in this text", "en", "s"), (8, "the same words stand here in this text", "fr", "t"), (None, "no id at all", "en", "s"), (9, "ÀÉ ñ 中文 😀 \u0000 \x1c end", "es", "t")]
    clash = "score string, predicted string, lang_pred string, n_tokens string, ids string, kept string, copy string, shard string, n_words string, class_id string, node string, size string, host string, url string"
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["mine"] * 14) for r in rows], f"{DOC}, {clash}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def prose():
    """Texts of four invented languages with their names, the same each time."""
    rng = random.Random(5)
    syllables = {"aa": ["ka", "to", "mi", "re"], "bb": ["schu", "ber", "ung", "ei"], "cc": ["eau", "oi", "que", "ment"], "dd": ["ción", "ll", "os", "ado"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."

    return text
