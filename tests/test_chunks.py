"""Large documents in byte ranges against the reader of whole documents."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annoweave.plans.load import load_documents, load_lines
from annoweave.schemas import MEMBERS, TABLES
from annoweave.sources import chunks
from annoweave.sources.documents import read_documents
from conftest import annotation, dataset, image, taxon


def members(raw):
    out = {}
    for name in MEMBERS:
        df = raw[name].drop("_order")
        casts = [f"cast({f.name} as string) {f.name}" for f in df.schema.fields]
        out[name] = sorted((tuple(r) for r in df.selectExpr(*casts).collect()), key=repr)
    return out


def odd_document(size=40):
    """Brackets, quotes and backslashes inside texts, nested values, and members nobody asked for."""
    images = [{**image(i), "file_name": 'a"]}\\' * (i % 4) + "\\" * (i % 5) + "é[{,:"} for i in range(size)]
    found = [annotation(i, i % size) for i in range(2 * size)]
    return dataset(images, found, other=[[1, [2, "]"]], {"images": [{"id": 99}]}], more={"images": [1, 2, {"a": [3]}]},
                   word="images\\", nothing=None, categories=[taxon(1, "x, y: [z]")], attributes=[])


@pytest.mark.parametrize("chunk", [7, 200, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_same_rows_as_whole_documents(spark, document, chunk, indent, tmp_path):
    path = tmp_path / "one.json"
    path.write_text(json.dumps(odd_document(6 if chunk == 7 else 40), indent=indent))
    assert members(chunks.read_large_documents(spark, str(path), chunk_bytes=chunk)) == members(
        read_documents(spark, str(path)))


def test_many_documents_and_order(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"d{n}.json").write_bytes(b"\xef\xbb\xbf" * (n == 1) + json.dumps(odd_document(5)).encode())
    raw = chunks.read_large_documents(spark, str(tmp_path), chunk_bytes=200)
    rows = raw["images"].orderBy("_order").select("_order.path", "id").collect()
    assert [r.id for r in rows] == [0, 1, 2, 3, 4] * 3
    assert raw["info"].count() == 3 and raw.damaged.count() == 0


def test_damaged_documents_and_elements(spark, tmp_path):
    (tmp_path / "cut.json").write_text(json.dumps(odd_document(5))[:-9])
    (tmp_path / "quote.json").write_text('{"images":[{"id":1}], "x": "}')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "array.json").write_text("[1]")
    (tmp_path / "up.json").write_text('{"images":[]}}{')
    (tmp_path / "good.json").write_text('{"images":[{"id":1}, 5, {"id" 2}, {"id":"x"}, null], "info":[{"year":1}], "licenses":{"id":1}}')
    raw = chunks.read_large_documents(spark, str(tmp_path), chunk_bytes=5)
    assert [r.id for r in raw["images"].collect()] == [1, None]
    damaged = sorted((r.source.rsplit("/", 1)[1], r.text.strip()) for r in raw.damaged.collect())
    assert [t for s, t in damaged if s == "good.json"] == ['5', '{"id" 2}', '{"id":1}', '{"year":1}']
    assert [s for s, _ in damaged if s != "good.json"] == ["array.json", "cut.json", "quote.json", "up.json"]
    assert [r.fields for r in raw.unconverted.collect()] == ["id"]


def test_other_encodings_and_missing_paths_raise(spark, tmp_path):
    (tmp_path / "wide.json").write_bytes('{"images":[]}'.encode("utf-16"))
    with pytest.raises(Exception, match="not UTF-8"):
        chunks.read_large_documents(spark, str(tmp_path / "wide.json"))["images"].count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        chunks.read_large_documents(spark, str(tmp_path / "none.json"))


def test_empty_members(spark, tmp_path):
    path = tmp_path / "e.json"
    for text in ("{}", '{"images":[ ], "annotations":[\n]}', '{"images":null,"info":null}'):
        path.write_text(text)
        raw = chunks.read_large_documents(spark, str(path), chunk_bytes=4)
        assert all(raw[name].count() == 0 for name in MEMBERS) and raw.damaged.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.integers() | st.text(alphabet='a"\\[]{},: é', max_size=6),
                    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text('k"\\:', max_size=3), inner, max_size=3),
                    max_leaves=12), st.integers(1, 40))
def test_cutting_at_any_byte(value, chunk):
    """Elements of a document, for any ranges, without Spark around it."""
    import tempfile
    whole = {"a": [value, [value]], "b": {"x": value}, "c": [], "d": value, 'e"\\': [{"y": value}]}
    data = json.dumps(whole, ensure_ascii=False).encode()
    with tempfile.NamedTemporaryFile(suffix=".json") as file:
        file.write(data)
        file.flush()
        got, member, array, quoted, depth = [], None, None, False, 0
        for start in range(0, len(data), chunk):
            rows = list(chunks._elements("file:" + file.name, start, min(start + chunk, len(data)), quoted, depth))
            for pos, own, kind, text in rows[:-1]:
                if kind is not None or array:
                    got.append((own if own is not None else member, json.loads(text)))
            member = rows[-1][1] if rows[-1][1] is not None else member
            array = rows[-1][2] if rows[-1][2] is not None else array
            part = chunks.np.frombuffer(data[start:start + chunk], dtype=chunks.np.uint8)
            before = start - len(data[:start].rstrip(b"\\"))
            quotes, _, steps = chunks._marks(part, before, quoted)
            quoted, depth = (len(quotes) + quoted) % 2 == 1, depth + int(steps.sum())
        want = []
        for name, found in whole.items():
            want += [(name, item) for item in found] if isinstance(found, list) else (
                [(name, found)] if isinstance(found, dict) else [])
        assert got == want and depth == 0 and not quoted


def test_one_large_document_loads_like_lines(spark, tmp_path):
    """Many ranges, several tasks, and the tables of the JSON-lines load."""
    draw = random.Random(5)
    content = dataset([image(i) for i in range(3000)],
                      [annotation(i, draw.randrange(3300), draw.randrange(1, 5)) for i in range(6000)])
    path, lines = tmp_path / "large.json", tmp_path / "lines"
    path.write_text(json.dumps(content))
    lines.mkdir()
    for name, rows in content.items():
        (lines / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows if isinstance(rows, list) else [rows])))
    index = chunks.structural_index(spark, str(path), 100_000)
    assert index.count() == -(-path.stat().st_size // 100_000) > 8
    one = load_documents(spark, str(path), str(tmp_path / "one"), chunk_bytes=100_000)
    other = load_lines(spark, str(lines), str(tmp_path / "other"))
    for name in TABLES:
        assert sorted(one[name].collect(), key=repr) == sorted(other[name].collect(), key=repr)


def test_elements_are_parsed_once(spark, document):
    """What uses a member reads columns that are stored already."""
    raw = chunks.read_large_documents(spark, document(odd_document(5)), chunk_bytes=200)
    for df in (raw["annotations"], raw.damaged, raw.unconverted):
        assert "from_json" not in df._jdf.queryExecution().toString()


def test_little_is_read_to_finish_an_element(tmp_path):
    path = tmp_path / "many.json"
    path.write_text(json.dumps(dataset([image(i) for i in range(10_000)], [])))
    read = []

    class Counting:
        def __init__(self, file):
            self.file = file

        def seek(self, at):
            return self.file.seek(at)

        def read(self, size):
            piece = self.file.read(size)
            read.append(len(piece))
            return piece

    with open(path, "rb") as file:
        whole = file.read()
        at = whole.index(b'{"id": 500,')
        element = chunks._finish(Counting(file), at, False, 2, True)
    assert json.loads(element) == image(500) and sum(read) < 1 << 14
    assert len(whole) > 1 << 20
