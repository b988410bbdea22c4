import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, uid long, fp long, n long"


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls in every column, empty and long texts, copies, near copies, ties, repeated rows, and columns whose names the operators use inside."""
    r = random.Random(5)
    word = lambda: "".join(r.choices(["the", "of", "an", "ti", "er", "on", "ing", "re", "é", "st"], k=r.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(60) for _ in range(12)]
    passage = text(30)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20 + i, base[0]) for i in range(6)]
    rows += [(40 + i, base[1].replace(" ", "  ", 1 + i % 2)) for i in range(3)]
    for i in range(5):  # one word changed
        w = base[2].split()
        w[3 + 11 * i] = "zzz"
        rows.append((50 + i, " ".join(w)))
    rows += [(60 + i, f"{text(8)} {passage} {text(8)}") for i in range(4)]
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "one"), (74, "one two three"), (75, "one two three"), (76, text(20_000)), (77, "same " * 200)]
    rows += [(80, "<|endoftext|> is text\n\n  with  odd   space    x"), (81, "日本語 text 😀"), (5, base[5]), (5, base[5]), (None, base[7]), (None, None)]
    return [(d, t, None if i % 7 == 3 else "en", None if i % 5 == 2 else f"s{i % 3}", None, "x", 1, 2, 3) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokens_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
