"""Documents with every awkward case, and the benchmark beside them."""

import random

import pytest


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text): nulls, empty and long texts, ties, repeated rows, copies, near copies, shared passages."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnoprstuvéü") for _ in range(r.randrange(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    passage, other = prose(60), prose(40)
    rows = [(i, "\n".join(prose(r.randrange(3, 40)) for _ in range(r.randrange(1, 5)))) for i in range(40)]
    rows += [(40 + i, prose(10) + " " + passage + " " + prose(10)) for i in range(6)]
    rows += [(50 + i, rows[3][1]) for i in range(5)]
    rows += [(60 + i, rows[4][1].replace(" ", "  ", i)) for i in range(4)]
    rows += [(70, "ab" * 400), (71, "x" * 250), (72, other + "\n" + other + "\n" + other.upper()), (73, "The " * 3000)]
    rows += [(80, None), (81, ""), (82, "\n\n"), (83, " "), (84, "日本語 " * 50), (85, "a\0b\x0b c"), (86, "▁ x ▁▁"), (87, "😀 " * 30)]
    rows += [(3, rows[3][1]), (3, "tie " + prose(30)), (None, passage), (None, None), (80, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    extra = [(a, b, "en", f"src{i % 3}", 1, 7, "x", "y") for i, (a, b) in enumerate(awkward)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, h int, words string, spans string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
