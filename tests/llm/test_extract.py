import math
from collections import defaultdict

import pytest

from annoweave.llm import extract, queries
from annoweave.llm.dom import parse
from annoweave.llm.urls import host_of

SCHEMA = "page_id long, url string, html string"
STORY = "the ferry left the pier at noon and nobody on the deck knew why it turned back so early that day. "


def main(source, low=()):
    return " ".join(extract.main_blocks(source, frozenset(low), extract.Keys()))


def story(i, size=3):
    return "".join(f"<p>{STORY}Number {i * 7 + k} was a {'very ' * (k + i % 3)}long trip.</p>" for k in range(size))


def page(i, body=None):
    """A page without telling tags or names."""
    return (f"<html><body><div class='k1'><div>Harbour news</div><span>today</span></div><div class='k2'>{body or story(i)}</div>"
            "<div class='k3'>All rights reserved by the harbour office.</div></body></html>")


def run(spark, rows, **options):
    found = extract.extract(spark.createDataFrame(rows, SCHEMA), **options)
    assert found.columns == ["page_id", "url", "blocks"]
    return sorted(((r["page_id"], " ".join(r["blocks"])) for r in found.collect()), key=repr)


def site(n=12, host="h.example"):
    return [(i, f"http://{host}/{i}", page(i)) for i in range(n)]


def text_of(i):
    return main(f"<article>{story(i)}</article>")


def test_repeated_branches_go_and_the_varied_one_stays(spark):
    assert dict(run(spark, site())) == {i: text_of(i) for i in range(12)}


def test_copies_of_one_article_stay(spark):
    rows = site() + [(100 + i, f"http://h.example/copy{i}", page(3)) for i in range(30)]
    found = dict(run(spark, rows))
    assert all(found[100 + i] == text_of(3) for i in range(30)) and found[5] == text_of(5)


def test_a_single_page_keeps_what_nothing_tells_apart(spark):
    assert run(spark, site(1)) == [(0, f"Harbour news today {text_of(0)} All rights reserved by the harbour office.")]


def test_join_gives_the_same_as_broadcast(spark, monkeypatch):
    rows = site() + site(9, "other.example") + [(None, None, page(1)), (77, "no host", page(2)), (78, "http://h.example/", None)]
    want = run(spark, rows)
    monkeypatch.setattr(extract, "BROADCAST_NODES", 0)
    assert run(spark, rows) == want


def test_tree_equals_entropies_by_hand(spark, monkeypatch):
    rows = site(7) + site(2, "other.example") + [(50, "http://h.example/x", "<p>alone")]
    styles, content, paths = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int)), {}
    keys = extract.Keys()
    for _, url, source in rows:
        seen_styles, seen = defaultdict(list), set()
        below = [(parse(source), ())]
        while below:
            block, above = below.pop()
            path = (*above, (block.tag, block.label))
            node = url.split("/")[2], path
            block.key = keys[block.parent.key if block.parent else 0, block.tag, block.label]
            paths[node] = block.key
            seen_styles[node].append([(b.tag, b.label) for b in block.blocks])
            seen.update((node, f) for text in block.runs for f in extract.features(text))
            below.extend((b, path) for b in reversed(block.blocks))
        for node, style in seen_styles.items():
            styles[node][repr(style)] += 1
        for node, feature in seen:
            content[node][feature] += 1
    want = {}
    for node, found in styles.items():
        m = sum(found.values())
        presentation = -sum(n / m * math.log(n / m, m) for n in found.values()) if m > 1 else 1.0
        total = part = 0
        for other, counted in content.items():
            pages = sum(styles[other].values())
            if other[0] == node[0] and other[1][:len(node[1])] == node[1]:
                total += sum(counted.values())
                part += sum(n * (1 - (math.log(n, pages) if pages > 1 else 0)) for n in counted.values())
        fade = 0.9 ** len(found)
        want[node[0], paths[node]] = (m, (1 - fade) * presentation + fade * (part / total if total else 1.0))
    monkeypatch.setattr(extract, "_HELD", 5)
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {(r["host"], r["node"]): (r["pages"], r["importance"])
           for r in extract.style_tree(pages.withColumn("host", host_of(pages["url"]))).collect()}
    assert got.keys() == want.keys()
    for node, (m, importance) in want.items():
        assert got[node] == (m, pytest.approx(importance, abs=1e-8))


@pytest.mark.parametrize("source, text", [
    ("<article>a<b>b</b>c<br>d  \n e&nbsp;&amp;&#233;</article>", "abc d e &é"),
    ("<nav>n</nav><header>h</header><main><h1>T</h1><article>x<aside>s</aside></article></main><footer>f</footer>", "T x"),
    ("<article><header><h1>T</h1></header><p>one<p>two<footer>f</footer></article>", "T one two"),
    ("<div class='cookie-notice'>c</div><div id='adBanner'>a</div><p>read heading</p><form>f</form>", "read heading"),
    ("<article><p>x</p></article><article class='comment'><p>a very long remark of a reader</p></article>", "x"),
    ("<section id='comments'><div><p>remark</p></div></section><p>x</p>", "x"),
    ("<div class='with-sidebar'><article>x</article><div class='sidebar'>s</div></div>", "x"),
    ("<p>a<script>var t='</p><p>b';</script>c</p><style>p{}</style><!-- <p>d --><p>e", "ac e"),
    ("<ul><li><a href=1>menu</a><li><a href=2>more</a></ul><ul><li>one <a>two</a> three<li>four</ul>", "one two three four"),
    ("<p title='a>b' x=\"'>\">t</p>", "t"), ("<p it's>a</p><p>b's</p>", "a b's"), ("a < b <3 </ > c", "a < b <3 c"),
    ("<p>x</p><p y='unclosed>z</p>", "x z"), ("x<a", "x"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ("</div></p>x</section>y", "xy"), ("<p hidden>h</p><p style='Display: none'>n</p><p aria-hidden=true>a</p>v", "v"),
    ("<title>t</title><textarea><p>a</textarea><select><option>o</select>x", "x"), ("", ""), ("<nav>only</nav>", ""),
    ("<script>never closed <p>x", ""), ("<!-- never closed <p>x", ""), ("plain text", "plain text"),
])
def test_pages(source, text):
    assert main(source) == text


def test_null_page_and_very_deep_and_long_ones():
    assert extract.main_blocks(None, frozenset(), extract.Keys()) == []
    assert main("<div>" * 5000 + "x" + "</div>" * 5000 + "y") == "x y"
    assert len(main("<p>word</p>" * 50_000).split()) == 50_000
    assert main("<a " * 300_000) == "" and main("<p x='" * 1001 + ">y") in ("", "y")
    assert len(main("<" * 300_000)) == 300_000


def test_odd_tables(spark):
    assert run(spark, []) == []
    rows = [(1, "http://a/", "<p>x"), (1, "http://a/", "<p>x"), (None, None, None), (2, "", "")]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 as host", "7 as node", "7 as low", "7 as n")
    found = sorted([(r["page_id"], r["blocks"]) for r in extract.extract(pages).collect()], key=repr)
    assert found == sorted([(1, ["x"]), (1, ["x"]), (None, []), (2, [])], key=repr)


def test_query_over_given_pages(spark):
    found = queries.op11_html_extraction(spark, "/root/testdata/sf0.001")
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    for r, source in found.join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"),
                                "page_id").select("text", "n_chars", "html").rdd.map(lambda r: (r, r["html"])).collect():
        inner = source[source.index("<article>"):source.index("</article>")]
        assert r["text"] == main(inner) and r["n_chars"] == len(r["text"]) > 0
