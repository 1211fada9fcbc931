import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix potent jugs of liquid gold near quiet northern lakes and old grey stones keep their secrets".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + seed * i) % len(WORDS)] + str((seed * 31 + i) % 97) for i in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Copies, near copies, shared passages, nulls, empty and long texts, odd white space, a clashing extra column."""
    base, shared = prose(1, 120), prose(99, 80)
    rows = [
        (1, base), (2, base), (3, base.upper()), (4, base.replace("fox", "cat", 1)), (5, None), (6, ""), (7, "  \n\t "), (8, "one"), (9, "ONE"), (10, "two words"),
        (11, prose(2, 40) + " " + shared), (12, prose(3, 30) + "\n" + shared + " " + prose(4, 20)), (13, prose(5, 30000)), (14, "a " * 400), (15, "a " * 300), (16, "x<|endoftext|>y  z  é 漢字。\r\n1,2"),
        (16, "x<|endoftext|>y  z  é 漢字。\r\n1,2"), (17, "word" * 3000), (18, prose(6, 49)), (19, prose(6, 51)), (20, prose(6, 52)), (None, base),
    ]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, answer int")
