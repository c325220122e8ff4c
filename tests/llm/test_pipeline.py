import corpus_pipeline as pipeline
import __spark_entry__ as contract
import sentencepiece
from check import differences
from llm import brute
from llm.brute import SF_SMALL

from annoweave.llm import queries


def test_everything_is_registered():
    names = list(contract.queries())
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert "pipeline" not in contract.oracle_sql()


def test_queries_match_their_sql(spark):
    problems = {name: problem for name, problem, _ in differences(spark, SF_SMALL, set(queries.SQL)) if problem}
    assert problems == {}


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_stages_decide_as_stated(spark, docs):
    columns = docs.columns
    named = pipeline.language_id(spark, docs, "")
    assert named.columns == columns
    want = [r for r in docs.collect() if r.text and any(map(str.isalpha, r.text))]
    assert rows(named) == sorted(map(repr, (tuple(r) for r in want)))

    lined = pipeline.line_dedup(spark, named, "")
    assert lined.columns == columns
    texts = brute.line_dedup([(r.doc_id, r.text) for r in want], 3, 3)
    left = [(r.doc_id, texts[r.doc_id, r.text], r.lang, r.source) for r in want]
    assert rows(lined.drop("n_chars")) == sorted(map(repr, [r for r in left if r[1] != ""]))
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    single = pipeline.near_duplicates(spark, lined, "")
    assert single.columns == columns
    groups = brute.similar([(r.doc_id, r.text) for r in lined.collect()], 5, 80)
    stay = {d for d, _, c in groups if d == c or d is None}
    assert rows(single) == rows(lined.where("doc_id is null").unionByName(
        lined.where(lined.doc_id.isin([d for d in stay if d is not None]))))

    mixed = pipeline.mix_sources(spark, single, "")
    assert mixed.columns == columns
    assert set(rows(mixed)) <= set(rows(single))

    coded = pipeline.sentencepiece(spark, mixed, "")
    library = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_PATH)
    by = {r.doc_id: r.text for r in mixed.collect()}
    found = coded.collect()
    assert len(found) == mixed.count()
    assert all(r.ids == library.encode(by[r.doc_id]) and r.round_trip for r in found)


def test_stages_keep_extra_columns_and_survive_empty_tables(spark, docs, cluttered, nothing):
    few = cluttered.where("doc_id < 12")
    empty = nothing
    for name, stage in pipeline.STAGES[:-1]:
        few, empty = stage(spark, few, ""), stage(spark, empty, "")
        assert few.columns == cluttered.columns, name
        assert empty.collect() == [] and empty.columns == nothing.columns, name
    assert pipeline.sentencepiece(spark, empty, "").collect() == []
    assert few.count() > 0


def test_whole_run(spark):
    found = pipeline.run(spark, SF_SMALL)
    assert found.columns == ["doc_id", "ids", "n_tokens", "round_trip"]
    assert found.where("round_trip").count() == found.count() > 100


def test_one_row_of_each_group_whatever_its_ids(spark):
    def text(name, *other):
        return " ".join(f"{name}{i}" if i not in other else f"other{name}{i}" for i in range(100))

    rows = [(1, text("a")), (None, text("a", 10, 30)), (2, text("a", 10, 30, 50, 70)),  # joined by a row without id
            (None, text("b")), (None, text("b")), (None, text("b", 50)),
            (5, text("c")), (5, text("c")), (5, text("c", 50)), (4, text("c", 20)), (4, text("c", 20)),
            (6, text("d")), (6, text("e")), (None, text("f"))]
    docs = spark.createDataFrame([(d, t, "en", "src", len(t)) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    single = pipeline.near_duplicates(spark, docs, "")
    found = pipeline.one_of_each(single)
    assert found.columns == docs.columns
    left = [(r.doc_id, r.text[0]) for r in found.collect() if not r.text.startswith("other")]
    assert sorted(left, key=repr) == sorted(
        [(1, "a"), (None, "b"), (4, "c"), (6, "d"), (6, "e"), (None, "f")], key=repr)
    mixed = {(r.doc_id, r.text) for r in pipeline.mix_sources(spark, single, "").collect()}
    assert mixed <= {(r.doc_id, r.text) for r in found.collect()}


def test_language_stage_sends_small_batches(spark, docs, monkeypatch):
    """Whole rows go to Python at most a thousand at a time, and the session's setting is back afterwards."""
    setting, seen, store = "spark.sql.execution.arrow.maxRecordsPerBatch", [], pipeline.stored

    def stored(df, label):
        seen.append(int(spark.conf.get(setting)))
        return store(df, label)

    before = spark.conf.get(setting)
    monkeypatch.setattr(pipeline, "stored", stored)
    assert pipeline.language_id(spark, docs, "").count() > 0
    assert seen == [1000] and spark.conf.get(setting) == before


def test_language_stage_copies_no_text(spark, docs, monkeypatch):
    """It stores the digests of the texts that cannot be told, whatever the size of the rows."""
    seen, store = [], pipeline.stored

    def stored(df, label):
        seen.append(store(df, label))
        return seen[-1]

    monkeypatch.setattr(pipeline, "stored", stored)
    named = pipeline.language_id(spark, docs, "")
    assert [t.columns for t in seen] == [["_digest"]] and seen[0].count() < docs.count() / 2
    want = [r for r in docs.collect() if r.text and any(map(str.isalpha, r.text))]
    assert rows(named) == sorted(map(repr, (tuple(r) for r in want)))
