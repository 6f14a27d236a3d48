from html import escape

from corpusmill.llm import templates as T

from .util import collect

SCHEMA = "page_id long, url string, html string, text string, host string, id int, token int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", "h", 1, 2) for i, u, h in rows], SCHEMA)


def page(body, n=0):
    return (f'<!DOCTYPE html><html><head><title>Site &amp; {n}</title><style>p{{}}</style><script>var t="</p><article>";</script>'
            f'</head><body class="single has-sidebar comments-open"><header><a href="/">Home</a></header><nav><ul><li><a href="/a">A'
            f'</a></li></ul></nav><!-- <article>no</article> --><div class="ad">Buy {n}</div>{body}'
            f'<aside>Side</aside><form><label>Mail</label><input value="x"></form><footer>&copy; host</footer></body></html>')


def test_article_without_its_surroundings(spark):
    body = ("<article><h1>T &lt;b&gt; &amp;amp; é</h1><p><b>First\n line<br>goes&nbsp;on</b><p>Second <a href='x>y'>link</a>."
            "<ul><li>one<li>two</ul><div class='share'>Share</div><section id='comments'><p>Nice!</p></section>"
            "<table><tr><td>c1<td>c2</table><p hidden>no</p><noscript>no</noscript></article>")
    rows = [(1, "http://h.org/1", page(body))]
    got = collect(T.extract(pages(spark, rows)), "id", "text", "host")
    assert got == [(1, "T <b> &amp; é\nFirst line goes on\nSecond link.\none\ntwo\nc1\nc2", "h.org")]


def test_template_texts_and_link_lists_without_telling_names(spark):
    """No element or class tells what is menu or notice here: only that they come from the template does."""
    rows = [(i, f"https://u:p@Site.example:80/{i}?q", f"<html><body><div><ul><li><a href='/x'>Start {i % 4}</a></li><li><a href='/y'>All"
             f"</a></li></ul></div><div><p>We use tea.</p></div><div><p>Story {i} begins.</p><p>It ends {i}.</p></div>"
             f"<div>Printed in Rome</div></body></html>") for i in range(20)]
    alone = [(100, "http://other.example/", rows[0][2])]
    got = {r[0]: r[1:] for r in collect(T.extract(pages(spark, rows + alone)), "id", "text", "n_template")}
    assert all(got[i][0] == f"Story {i} begins.\nIt ends {i}." for i in range(20))
    assert got[100] == ("Start 0\nAll\nWe use tea.\nStory 0 begins.\nIt ends 0.\nPrinted in Rome", 0) and got[0][1] > 10


def test_a_page_that_breaks_the_order_keeps_its_texts(spark):
    one = "<html><body><div><p>Same words.</p></div><section><p>Text {0}</p></section></body></html>"
    rows = [(i, "http://h.org", one.format(i)) for i in range(15)]
    rows.append((15, "http://h.org", "<html><body><section><p>Text 15</p></section><div><p>Same words.</p></div></body></html>"))
    got = dict(collect(T.extract(pages(spark, rows)), "id", "text"))
    assert got[3] == "Text 3" and got[15] == "Text 15\nSame words."


def test_classes_are_tokens_of_equal_vectors(spark):
    rows = [(i, "http://h.org", "<body><h1>t</h1>" + "<p><i>x</i>" * (1 + i % 3) + "</body>") for i in range(12)]
    found = T.templates(T.token_sums(pages(spark, rows))).collect()[0]["tokens"]
    kinds = {}
    for t in found:
        kinds.setdefault(t["kind"], []).append(t["token"])
    sizes = sorted(len(x) for x in kinds.values())
    assert sizes == [3, 5]      # p, i, its end; body, h1, its text and end, the body's end
    assert [t["place"] for t in found] == sorted(t["place"] for t in found)


def test_classes_have_a_least_size(spark):
    """A pair of tags on half of the pages is no class; one of three tokens is."""
    rows = [(i, "http://h.org", "<body><h1>t</h1>" + "<em>x</em>" * (i % 2) + "<div><u>x</u></div>" * (i % 3 > 0) + "</body>")
            for i in range(12)]
    found = T.templates(T.token_sums(pages(spark, rows))).collect()[0]["tokens"]
    kinds = [t["kind"] for t in found]
    assert sorted(kinds.count(k) for k in set(kinds)) == [4, 5]


def _template(*classes):
    """Classes (pages, tags in order) of tags that stand in nothing."""
    key = {name: T._key(0, T.mark(name, "").label) for _, names in classes for name in names}
    return T.Template([{"kind": no, "pages": n, "token": key[name], "is_text": False, "menu": False}
                       for no, (n, names) in enumerate(classes) for name in names])


def test_nested_classes_and_their_slots():
    # elements without content, so that every tag has the empty path
    whole = _template((20, ["hr", "img", "wbr"]), (15, ["area", "col", "embed"]))
    good, places = whole.nest(T.pieces("<hr><area><col>one<embed><area><col><embed>two<img><wbr>three"))
    assert good == {0, 1}
    assert [places[i] for i in (3, 8, 11)] == [((0, 1), (1, 2)), ((0, 1),), ()]
    assert [x[0] for x in T.slots("<hr><area><col>one<embed>two<img><wbr>", whole)] == [((0, 1), (1, 2)), ((0, 1),)]


def test_a_class_out_of_order_or_across_another_is_not_valid():
    whole = _template((20, ["hr", "img", "wbr"]), (15, ["area", "col", "embed"]))
    assert whole.nest(T.pieces("<hr><col><area><embed><img><wbr>"))[0] == {0}
    assert whole.nest(T.pieces("<hr><area><img><col><embed><wbr>"))[0] == {0}
    assert whole.nest(T.pieces("<area><hr><col><img><wbr><embed>"))[0] == {0}
    assert whole.nest(T.pieces("<hr><img><area><col><embed>x"))[0] == {1}
    assert whole.nest(T.pieces("<hr><img>x"))[1][-1] == ()


def test_copies_on_one_host_keep_their_text(spark):
    rows = [(i, "http://h.org/a", page(f"<article><p>The same {i % 2}.</p></article>", i)) for i in range(30)]
    rows += [(99, "http://h.org/a", rows[0][2])] * 2
    got = collect(T.extract(pages(spark, rows)), "id", "text")
    assert len(got) == 32 and all(t == f"The same {i % 2}." for i, t in got if i != 99)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "not a url", ""), (3, "http://h.org", "no markup & more"), (None, "http://h.org", "<p>a < b <p>c"),
            (5, "http://h.org", "<article><p>cut off &amp"), (6, "http://h.org", '<p class="never closed>x</p>'), (7, "", "</p></div>"),
            (8, "http://h.org", "<div class='ad'><main><p>kept</p></main></div>"), (9, "http://h.org", "<article>" + "<div>" * 3000 + "deep"),
            (10, "http://h.org", "<article>" + "<p>w</p>" * 20_000 + "</article>")]
    got = dict(collect(T.extract(pages(spark, rows)), "id", "text"))
    assert got[1] == got[2] == got[7] == "" and got[3] == "no markup & more" and got[None] == "a < b\nc"
    assert got[5] == "cut off &" and got[8] == "kept" and got[9] == "deep" and got[10].count("\n") == 19_999
    assert T.extract(pages(spark, [])).count() == 0


def test_query_columns_and_a_round_trip(spark, tmp_path):
    texts = ["Über & <unter>", "a  b\tc", 'q"uote\'s']
    rows = [(i, f"http://h{i % 2}.org", page(f"<article><h1>{escape(t)}</h1><p>{escape(t)} {i}</p></article>", i))
            for i, t in enumerate(texts * 8)]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    want = {(i, f"http://h{i % 2}.org", s := f"{' '.join(t.split())}\n{' '.join(t.split())} {i}", len(s))
            for i, t in enumerate(texts * 8)}
    assert set(collect(T.query(spark, str(tmp_path)), "page_id", "url", "text", "n_chars")) == want
