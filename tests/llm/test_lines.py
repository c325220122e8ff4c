from llm import brute
import pytest

from annoweave.llm import lines


def got(df):
    return {(r.doc_id, r.before): r.text for r in df.collect()}


def run(docs, **options):
    whole = docs.selectExpr("doc_id", "text", "text before")
    return got(lines.without_repeats(whole, **options))


@pytest.mark.parametrize("min_lines, min_words", [(3, 3), (1, 1), (2, 9), (5, 50), (4, 2)])
def test_equals_brute_force(spark, docs, min_lines, min_words):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    block = ["a", "b", "", "c", "d e f", "g"]
    rows += [(400 + i, "\n".join(block[i % 3:] + [f"own {i}"] + block[: 2 + i % 5])) for i in range(8)]
    rows += [(500, "\n".join(["again"] * 20)), (501, "again\nagain")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, min_lines=min_lines, min_words=min_words) == brute.line_dedup(rows, min_lines, min_words)


@pytest.mark.parametrize("min_lines", [1, 3, 6])
def test_maximal_runs(spark, min_lines):
    block = ["a", "b", "", "c", "d", "e", "f", "g", "h"]
    rows = [(i, "\n".join(block[i % 4:] + [f"own {i}"] + block[: 2 + i])) for i in range(6)]
    rows += [(10, "\n".join(["again"] * 9)), (11, "again\nagain"), (12, None), (13, ""), (14, "alone\nb\nalone too")]
    found = lines.runs(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=min_lines)
    got = sorted((r.doc, r.pos, r.n_lines) for r in found.collect())
    assert got == brute.line_runs(rows, min_lines) and len(got) > 4


def test_columns_are_kept(cluttered):
    done = lines.without_repeats(cluttered)
    assert done.columns == cluttered.columns + ["n_lines", "n_deleted"]
    assert done.count() == cluttered.count()
    assert done.where("gone <> 7 or version <> 7").count() == 0


def test_empty_table(nothing):
    assert lines.without_repeats(nothing).collect() == []
