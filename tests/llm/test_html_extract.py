import html
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import html_extract as H

PAGES = "page_id long, url string, html string"


def random_forest(seed):
    r = random.Random(seed)
    pages = []
    for _ in range(3):
        p = H.Page()
        for k in range(r.randint(0, 6)):
            top = r.randrange(len(p.parent))
            p.add(top, r.choice(["p", "div", H.TEXT]), None, False, 0)
        for k, t in enumerate(p.tag):
            p.text[k] = "some text." if t == H.TEXT else None
        pages.append(p)
    return pages


def test_marginals_match_enumeration():
    for seed in range(12):
        pages = random_forest(seed)
        f = H.forest(pages)
        rng = np.random.default_rng(seed)
        unary, pair = rng.normal(size=(len(f.parent), 2)), rng.normal(size=(2, 2, 2))
        belief, edges = H.sum_product(f, unary, pair)
        for k in range(len(pages)):
            a, b = f.first[k], f.first[k + 1]
            weight, node, edge = 0.0, np.zeros((b - a, 2)), np.zeros((b - a, 2, 2))
            for x in itertools.product((0, 1), repeat=b - a):
                s = sum(unary[a + i, x[i]] for i in range(b - a)) + sum(pair[f.leaf[a + i], x[f.parent[a + i] - a], x[i]] for i in range(1, b - a))
                e = np.exp(s)
                weight += e
                for i in range(b - a):
                    node[i, x[i]] += e
                    if i:
                        edge[i, x[f.parent[a + i] - a], x[i]] += e
            assert np.allclose(belief[a:b], node / weight) and np.allclose(edges[a + 1 : b], edge[1:] / weight)


def texts(source):
    page, _ = H.parse(source)
    path = lambda i: "" if i <= 0 else f"{path(page.parent[i])}/{page.tag[i]}"
    return [(path(page.parent[i]), t) for i, t in enumerate(page.text) if t is not None]


def test_parser():
    assert texts("<p>a<b>b<br>c<p>d</p>e") == [("/p", "a"), ("/p/b", "b"), ("/p/b", "c"), ("/p", "d"), ("", "e")]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == [("/ul/li", "a"), ("/ul/li", "b"), ("/ul/li/ul/li", "c"), ("/ul/li", "d"), ("", "e")]
    assert texts('<script>var t="</p>";</script>x<!-- <p>y --><img src="q">z</nope>') == [("", "x"), ("", "z")]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>4") == [("/table/tr/td", "1"), ("/table/tr/td", "2"), ("/table/tr/td", "3"), ("", "4")]
    assert texts("a < b <") == [("", "a < b <")] and texts("") == [] and texts("<script>never closed") == [] and texts("<p") == []


def page(seed, wrap="article"):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet".split()) for _ in range(n)).capitalize() + "."
    body = [say(r.randint(8, 40)) for _ in range(r.randint(1, 6))]
    menu = "".join(f'<li><a href="/{k}">{say(2)}</a>' for k in range(r.randint(2, 7)))
    return f"<html><head><title>{say(4)}</title></head><body><nav><ul>{menu}</ul></nav><div class='ad'>{say(5)}</div><{wrap}>" + "".join(f"<p>{b}" for b in body) + f"</{wrap}><footer>&copy; {say(5)}</footer>", "\n".join(body)


def test_held_out_pages_that_do_not_say(spark):
    rows = [(i, "u", page(i)[0]) for i in range(60)] + [(i, "u", page(i, "div")[0]) for i in range(60, 120)]
    df = spark.createDataFrame(rows, PAGES)
    model = H.fit(df, max_pages=40)
    got = {x.page_id: x.content for x in H.extract(df, model).collect()}
    assert sum(got[i] == page(i, "article" if i < 60 else "div")[1] for i in range(120)) >= 110


def test_awkward_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (None, "u", "<p>x"), (4, "u", "just text &amp; more"), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "<article>" + "<p>word word word.</p>" * 5000), (7, "u", "\x00<\x01>")]
    df = spark.createDataFrame(rows, PAGES).withColumn("content", F.lit(1)).withColumn("text_nodes", F.lit("x"))
    for model in (H.fit(df), H.Model(np.zeros(H.FEATURES), np.zeros((2, 2, 2)))):
        got = H.extract(df, model).collect()
        assert len(got) == 8
        assert [x.content for x in got if x.page_id == 1] == [None] and [x.content for x in got if x.page_id == 2] == [""]
        assert len({x.content for x in got if x.page_id is None}) == 1
    none = spark.createDataFrame([], PAGES)
    assert H.extract(none, H.fit(none)).count() == 0


def leaf_texts(source):
    page, _ = H.parse(source)
    return [html.unescape(t).strip() for t in page.text if t is not None]


def test_letters_that_grow_in_lower_case_and_quoted_angles():
    source = "<p>" + "\u0130" * 30 + "</p><SCRIPT>var a = '<p>no</p>';</Script><p>after it</p><style>x</STYLE ><p>end</p>"
    assert leaf_texts(source) == ["\u0130" * 30, "after it", "end"]
    assert leaf_texts('<a title="a > b" href="x">link</a>') == ["link"]
    assert leaf_texts("<a title='1 > 0' b>one</a> <img alt = \"a>b\"> two") == ["one", "two"]
    assert leaf_texts("<p don't>it's <b>here</b></p>") == ["it's", "here"]
    assert leaf_texts('<a title="open>text</a> rest') == ["text", "rest"]
    assert leaf_texts("<script>a</scripty>b</\u017fcript>c</script>d") == ["d"]
    assert leaf_texts("<a " + "=" * 50_000 + "\"" * 50_000 + ">z") == ["z"]


def test_empty_table_ties_and_clashing_names(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    model = H.fit(none)
    assert H.extract(none, model).count() == 0
    some = spark.createDataFrame([(1, "u", "<p>a</p><p>b</p>"), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "1 as content", "'x' as html", "2 as URL")
    assert sorted(map(tuple, H.extract(some, model).collect()), key=repr) == [(1, "u", "a\nb", 2, 2), (None, None, None, 0, 0)]
