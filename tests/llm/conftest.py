import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, component string, runs string"


def edge_texts() -> list[str | None]:
    """Short, empty, null, repeated, very long and overlapping texts."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(draw.choices(vocabulary, k=n))
    passage, base = prose(70), prose(160)
    out: list[str | None] = [None, "", "   \n\t ", "one", "one two three", "ONE two three four five", "a a a a a a a", "the " * 300, prose(30) + "\n" + prose(30)]
    out += [base, base, base.upper(), base + " tail", "head " + base]
    words = base.split()
    for i in range(30):  # near copies
        w = list(words)
        w[draw.randrange(len(w))] = vocabulary[i]
        out.append(" ".join(w))
    out += [prose(draw.randint(5, 40)) + "\n" + passage + "\n " + prose(draw.randint(5, 40)) for _ in range(25)]
    out += [passage, " ".join(passage.split()[:49]), " ".join(passage.split()[:50])]
    out += [prose(20_000), "x" * 100_000, passage + " " + passage, "\U0001f600 éé " * 40]
    return out


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The edge texts as a table with extra columns of clashing names, one repeated row and one null id."""
    texts = edge_texts()
    rows = [(i, t, None if i % 5 == 0 else "en", f"src{i % 3}", len(t or ""), "x", None, "y") for i, t in enumerate(texts)]
    rows.append(rows[9])
    rows.append((None, "a text of no id", None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
