import hashlib

import pytest

from annoweave.llm import fingerprints as fp

TEXT = "\n".join(f"paragraph {i} has words that tell it apart number {i * i}, and more of them" for i in range(40))


def brute_rows(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[:len(t) - cut] + following[:cut]
        a, b, c = (fp.fingerprint(x) for x in (t, edited, following))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b,
                    fp.likeness(a, b), fp.likeness(a, c)))
    return out


def test_equal_texts_alone_have_equal_roots():
    texts = ["", "a", "a ", "a\n", "a\n\n", "a b", "a\nb", "ab", TEXT, TEXT + "\n", TEXT.upper()]
    roots = [fp.fingerprint(t)[:32] for t in texts]
    assert len(set(roots)) == len(texts)
    assert roots == [fp.fingerprint(t)[:32] for t in texts]


def test_likeness_follows_the_edit():
    a = fp.fingerprint(TEXT)
    small = fp.fingerprint(TEXT.replace("number 400", "number four hundred"))
    half = fp.fingerprint(TEXT[: len(TEXT) // 2])
    assert fp.likeness(a, a) == 1.0
    assert 0.95 < fp.likeness(a, small) < 1.0
    assert 0.6 < fp.likeness(a, half) < 0.75
    assert fp.likeness(a, fp.fingerprint("")) == 0.0
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint(None)) == 1.0
    assert fp.likeness(a, half) == fp.likeness(half, a)


def test_branches_locate_the_edit():
    changed = TEXT.replace("number 400", "number four hundred")
    a, b = fp.fingerprint(TEXT), fp.fingerprint(changed)
    (place,) = fp.edits(a, b)
    sections = [s.split(",") for s in a.partition(":")[2].split("|")]
    assert sum(len(s) for s in sections[:place[0]]) + place[1] == 20
    assert fp.edits(a, a) == []


def test_texts_without_spaces_still_compare():
    long = "".join(chr(0x4E01 + (i * i) % 5000) for i in range(4000))
    assert 0.7 < fp.likeness(fp.fingerprint(long), fp.fingerprint(long[:3000] + "x" * 1000)) < 0.8


@pytest.mark.parametrize("partitions", ["1", "4", "13"])
def test_equals_brute_force(spark, docs, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = [tuple(r) for r in fp.compare_with_next(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute_rows([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_single_document_and_empty_table(spark, nothing, cluttered):
    one = spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")
    (row,) = fp.compare_with_next(one).collect()
    assert (row.doc_id, row.n_chars, row.near_next) == (7, 8, 1.0)
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert fp.compare_with_next(nothing).collect() == []
    assert fp.compare_with_next(cluttered).count() == cluttered.count()
