import random

import pytest

SF = "/root/testdata/sf0.001"
WORDS = "der und the of and ein une les las con por sur mit".split()


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and further columns with names used inside."""
    r = random.Random(4)
    line = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
    shared, base = line(14), line(90)
    texts = [line(r.randrange(1, 60)) + "\n" + shared + "\n" + line(9) for _ in range(24)]
    texts += [base, base, base.replace("a", "e", 1), base + " x", "", None, "   ", "A", "a", "two words", "\n\n \n", "x" * 5000, line(30000), shared, shared[:-1] + "?", "tab\there and there", "don't  stop", "<|endoftext|> é ́ 가"]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s0", "s1", "s0", None, "s2")[i % 5], len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[24], (None, "a null id", None, None, None), (None, "a null id", None, None, None), (None, base, "en", "s0", 1)]
    rows = [(*row, 0.5, "x", 7, 1, [1], 2, None) for row in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, size int, n int, ids array<int>, row long, `gone` string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
