import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = ("the house stands near the river and the people of the town walk there every morning with their dogs "
      "while others read the paper in the garden and wait for the train that goes to the city").split()
DE = ("das haus steht nahe am fluss und die leute der stadt gehen dort jeden morgen mit ihren hunden während "
      "andere die zeitung im garten lesen und auf den zug warten der in die stadt fährt").split()


def sentence(words, start, size):
    return " ".join(words[(start + i * 7) % len(words)] for i in range(size))


def corpus():
    """Documents with copies, near copies, shared lines, odd texts, nulls and repeated rows."""
    rows = []
    for i in range(60):
        words, lang = (EN, "en") if i % 2 else (DE, "de")
        lines = [sentence(words, i + 3 * k, 9 + (i + k) % 5) + f" n{i}x{k}" for k in range(1 + i % 4)]
        if i % 3 == 0:
            lines.insert(0, "a line that many documents share.")
        rows.append((i, "\n".join(lines), lang, f"src{i % 5}", None))
    base = " ".join(f"w{k}" for k in range(80))
    rows += [(100 + i, base.replace("w7 ", f"v{i} "), "en", "src1", 5) for i in range(50)]  # near copies
    rows += [(200 + i, rows[4][1], "de", "src0", 5) for i in range(40)]  # exact copies
    rows += [(300, None, "en", "src0", None), (301, "", None, None, 0), (302, "12345 !!! 678", "en", None, 3),
             (303, "one", "en", "src9", 3), (304, "ONE", None, "src9", 3), (305, "\n\n\n", "de", "src2", 3),
             (306, "x" * 30_000, "en", "src3", 1), (307, "a b " * 15_000, "en", "src3", 1),
             (308, "😀 über  zwei   spaces\tand\ttabs\r\n日本語", None, "src4", 9), (309, " ", "en", "src4", 1),
             (None, "a text without an id but with words", "en", "src1", None)]
    rows += [rows[3], rows[3], (None, None, None, None, None)]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="session")
def cluttered(docs):
    """The same with further columns whose names operators use themselves."""
    extra = ["row", "size", "rank", "score", "ids", "digest", "n", "a", "b", "found", "gone", "doc",
             "version", "pattern", "draw", "part", "key", "base", "spans", "lang_pred", "copies"]
    return docs.select("*", *[F.lit(7).alias(c) for c in extra])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
