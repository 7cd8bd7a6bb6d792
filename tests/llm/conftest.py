import random

import pytest

WORDS = "the of and river stone light under window green paper small house carries every morning quiet table never".split()
OTHER = "der die und fluss stein licht unter fenster papier klein haus trägt jeden morgen still tisch niemals über".split()
# Names that operators use inside; a table may have them as well.
CLASHES = ["tag", "cls", "key", "label", "part", "length", "kept", "row", "node", "n", "first", "lang_pred", "score", "copies", "anchor", "weight"]


def sentence(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang): odd rows among plain ones."""
    rng = random.Random(11)
    shared = sentence(rng, 70)
    rows = [(k, sentence(rng, rng.randint(3, 120)), "en") for k in range(20)]
    rows += [(k, sentence(rng, rng.randint(3, 120), OTHER), "de") for k in range(20, 40)]
    base = sentence(rng, 150).split()
    for k in range(40, 52):  # near copies of one text at several distances
        copy = base[:]
        for _ in range((k - 40) // 2):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy), "en"))
    rows += [(60, sentence(rng, 40) + " " + shared + " end", "en"), (61, shared + "\n" + sentence(rng, 30), "en")]
    rows += [(70, None, "en"), (71, "", "de"), (72, " \n\t ", None), (73, "word", "en"), (74, "zwei wörter", "de"), (75, "12 34 ... !!", "en")]
    rows += [(80, rows[3][1], "en"), (81, rows[3][1], "en"), (82, rows[3][1], "en"), (80, rows[3][1], "en")]
    rows += [(90, sentence(rng, 9000), "en"), (91, "x" * 3000, None), (92, "ñ日本 テキスト " * 40, None), (93, "A  B   C\x00d", "en")]
    rows += [(None, sentence(rng, 50), "en"), (None, rows[5][1], "en")]
    return rows


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    full = [(i, t, lang, "s", len(t) if t is not None else None, *["x"] * len(CLASHES)) for i, t, lang in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def docs(spark, texts):
    return frame(spark, texts).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])
