import numpy as np
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weir.functions import links, render
from weir.functions.text import decoded, target
from weir.operators import graph, matrix, pagerank, topk
from weir.sources import readers

CRAWL = """Alpha:<html><head/><body><a href="../x/Skip.html">out</a><div id="bodyContent"><p><a href="../../a/Beta.html">b</a><a>nohref</a><a href="./c/Gam%20ma.html">g</a></p><div id="other"><a href="./c/Gam%20ma.html">g2</a></div><a href="http://e.org/z/Ext.html">abs</a><a href="./u/User~1.html">t</a></div><a href="./x/After.html">after</a></body></html>
Beta:<html><body><div id="BODYCONTENT"><a href="./a/Alpha.html">R & D</a></div></body></html>
Broken:<html><body><div id="bodyContent"><a href="./a/Alpha.html">x</body></html>
User~2:<html><body><div id="bodyContent"><a href="./a/Alpha.html">x</a></div></body></html>
Lonely:<html><body><div id="content"><a href="./a/Alpha.html">x</a></div></body></html>"""
TOY = [("A", "B"), ("A", "C"), ("A", "C"), ("B", "C"), ("B", "D"), ("C", "A")]


@pytest.fixture(scope="module")
def crawl(spark, tmp_path_factory):
    import bz2

    path = tmp_path_factory.mktemp("crawl") / "pages.bz2"
    path.write_bytes(bz2.compress(CRAWL.encode()))
    return links.strict_links(readers.pages(readers.lines(spark, str(path)))).cache()


@pytest.fixture(scope="module")
def toy(spark):
    edges = spark.createDataFrame(TOY, "src string, dst string")
    return graph.nodes(edges, spark.createDataFrame([("E",)], "page string")), edges


def ranks(df):
    return {r.page: r.rank for r in df.collect()}


def test_strict_links(crawl):
    assert {r.page: r.links for r in crawl.collect()} == {"Alpha": ["Beta", "Gam ma", "Gam ma"], "Beta": ["Alpha"], "Lonely": []}


def test_vertices(crawl):
    found = graph.vertices(crawl)
    assert {r.page: len(r.links) for r in found.collect()} == {"Alpha": 3, "Beta": 1, "Gam ma": 0, "Lonely": 0}
    nodes = graph.nodes(graph.edges_of(crawl), crawl.select("page"))
    assert {r.page for r in graph.dangling(nodes).collect()} == {"Gam ma", "Lonely"}
    assert {r.page for r in graph.no_inlink(nodes).collect()} == {"Lonely"}


def test_entities_are_fatal_without_a_doctype():
    body = '<html><body><div id="bodyContent"><a href="./a/B.html">x&nbsp;</a></div></body></html>'
    assert links.hrefs(body) is None
    assert links.hrefs('<!DOCTYPE html PUBLIC "x" "http://e.org/x.dtd">' + body) == ["./a/B.html"]


def test_a_second_content_element_counts_and_a_nested_one_nests():
    html = '<r><div id="bodyContent"><div id="bodyContent"><a href="1"/></div><a href="2"/></div><a href="3"/><DIV id="bodycontent"><A href="4"/></DIV></r>'
    assert links.hrefs(html) == ["1", "2", "4"]


def test_a_line_without_a_colon_fails(spark):
    with pytest.raises(Exception, match="no colon"):
        readers.pages(spark.createDataFrame([("none",)], "value string")).collect()


def test_targets(spark):
    given_ = ["./a/.html", "./x/A%7E.html", "./x/A+B.html", "x/A.html", "./x/A%zz.html", None]
    found = spark.createDataFrame([(x,) for x in given_], "l string").select(target(F.col("l")).alias("t"), decoded(F.col("l")).alias("d")).collect()
    assert [r.t for r in found] == ["a/", None, "A B", None, "A%zz", None]
    assert found[4].d == "./x/A%zz.html"


def test_duplicate_records(spark):
    rows = spark.createDataFrame([("P", []), ("P", ["b", "a"]), ("P", ["b"]), ("Q", [])], "page string, links array<string>")
    assert {r.page: r.links for r in graph.merged_pages(rows, "first").collect()} == {"P": ["b"], "Q": []}
    assert {r.page: sorted(r.links) for r in graph.merged_pages(rows).collect()} == {"P": ["a", "b", "b"], "Q": []}


def test_adjacency_text_breaks_names_with_commas(spark):
    rows = spark.createDataFrame([("P", ["a, b", "c"]), ("Q", [])], "page string, links array<string>")
    page, found = render.split_adjacency(render.adjacency_line(F.col("page"), F.col("links")))
    assert sorted(map(tuple, rows.select(page, found).collect())) == [("P", ["a", "b", "c"]), ("Q", [])]


STEPS = {
    1: {"A": 0.268, "B": 0.154666666667, "C": 0.296333333333, "D": 0.183, "E": 0.098},
    2: {"A": 0.329653333333, "B": 0.153703333333, "C": 0.29537, "D": 0.143503333333, "E": 0.07777},
    10: {"A": 0.333079218927, "B": 0.15691334608, "C": 0.317970376781, "D": 0.129405933681, "E": 0.062631124531},
}


@pytest.mark.parametrize(("steps", "variant"), [(1, "adjacency"), (2, "adjacency"), (10, "adjacency"), (10, "row"), (10, "column")])
def test_pagerank(toy, steps, variant):
    found = ranks(pagerank.pagerank(*toy, steps, variant=variant))
    assert found == pytest.approx(STEPS[steps], abs=1e-11) and sum(found.values()) == pytest.approx(1)


def test_lagged_ranks_lack_the_last_spread(toy):
    nodes, edges = toy
    before = pagerank.pagerank(nodes, edges, 2).join(graph.dangling(nodes), "page").agg(F.sum("rank")).first()[0]
    lagged, whole = (ranks(pagerank.pagerank(nodes, edges, 3, variant=v)) for v in ("lagged", "adjacency"))
    assert lagged == pytest.approx({k: v - 0.85 * before / 5 for k, v in whole.items()})


def test_pagerank_without_dangling_pages_and_without_any(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "A")], "src string, dst string")
    assert ranks(pagerank.pagerank(graph.nodes(edges), edges, 3)) == pytest.approx({"A": 0.5, "B": 0.5})
    none = edges.where("src = 'x'")
    assert ranks(pagerank.pagerank(graph.nodes(none), none)) == {}


@settings(max_examples=2, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcde"), st.sampled_from("abcdef")), min_size=1, max_size=12))
def test_variants_agree_and_ranks_add_up(spark, pairs):
    edges = spark.createDataFrame(pairs, "src string, dst string")
    found = [ranks(pagerank.pagerank(graph.nodes(edges), edges, 1, variant=v)) for v in ("adjacency", "row", "column")]
    assert found[0] == pytest.approx(found[1]) and found[0] == pytest.approx(found[2]) and sum(found[0].values()) == pytest.approx(1)


def test_dictionary_is_dense_and_ordered(spark):
    pages = spark.createDataFrame([(f"p{i % 37}",) for i in range(100)], "page string")
    found = {r.page: r.page_id for r in graph.dictionary(pages).collect()}
    assert [p for p, _ in sorted(found.items(), key=lambda x: x[1])] == sorted(found) and sorted(found.values()) == list(range(37))


def test_matrix_forms(toy, spark):
    nodes, edges = toy
    pages = graph.dictionary(nodes)
    m = matrix.transition(matrix.numbered(edges, pages)).cache()
    dense = np.zeros((5, 5))
    for r in m.collect():
        dense[r.row_id, r.col_id] = r.weight
    assert dense[2, 0] == pytest.approx(2 / 3) and dense.sum(0) == pytest.approx([1, 1, 1, 0, 0])
    key = lambda df: sorted((r.row_id, r.col_id, round(r.weight, 12)) for r in df.collect())
    assert key(matrix.entries(matrix.rows(m))) == key(m) == key(matrix.entries(matrix.columns(m)))
    vector = spark.createDataFrame([(i, float(i + 1)) for i in range(5)], "col_id long, value double")
    for small in (True, False):
        product = {r.row_id: r.value for r in matrix.times(m, vector, small).collect()}
        assert product == pytest.approx({i: x for i, x in enumerate(dense @ np.arange(1, 6)) if x})


def test_top_breaks_ties_by_name_and_keeps_order(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0)], "page string, rank double")
    assert [r.page for r in topk.top(rows, 2).collect()] == ["c", "b"]
    assert "TakeOrderedAndProject" in topk.top(rows, 2)._jdf.queryExecution().executedPlan().toString()
    pages = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "page_id long, page string")
    named = topk.top_named(rows.join(pages, "page").select("page_id", "rank"), pages, 2)
    assert [r.page for r in named.collect()] == ["c", "b"]


def test_rendered_ranks(spark):
    row = spark.createDataFrame([("p", 0.000945)], "page string, rank double")
    found = row.select(render.named_rank(F.col("page"), F.col("rank")), render.rank_named(F.col("rank"), F.col("page")), render.pair(F.col("rank"), F.col("page"))).first()
    assert tuple(found) == ("p:0.000945000000000", "9.45E-4:p", "(9.45E-4,p)")


def test_a_page_with_many_inlinks_is_one_stub(spark):
    """Vertices of pages that were only linked to come from distinct targets; no list grows with inlinks."""
    rows = spark.createDataFrame([(f"P{k}", ["Hub", f"P{k - 1}"] * 3) for k in range(1, 60)], "page string, links array<string>")
    found = graph.vertices(rows)
    assert {r.page: len(r.links) for r in found.collect()} == {"Hub": 0, "P0": 0} | {f"P{k}": 6 for k in range(1, 60)}


def test_ranks_of_hubs_equal_plain_iteration(spark):
    """A hub that all link to and one that links to all, repeats included, in all forms."""
    pairs = [(f"a{k}", "hub") for k in range(40)] + [("out", f"a{k}") for k in range(40)] + [("a1", "hub"), ("a2", "a3"), ("hub", "sink")]
    names = sorted({x for p in pairs for x in p})
    links_of = {n: [d for s, d in pairs if s == n] for n in names}
    wanted = {n: 1 / len(names) for n in names}
    for _ in range(4):
        lost = sum(wanted[n] for n in names if not links_of[n])
        wanted = {n: (0.15 + 0.85 * lost) / len(names) + 0.85 * sum(wanted[s] / len(links_of[s]) for s, d in pairs if d == n) for n in names}
    edges = spark.createDataFrame(pairs, "src string, dst string")
    for variant in ("adjacency", "row", "column"):
        assert ranks(pagerank.pagerank(graph.nodes(edges), edges, 4, variant=variant)) == pytest.approx(wanted)


def test_dangling_mass_of_no_ranks(spark):
    none = spark.createDataFrame([], "page string, rank double, dangling boolean")
    assert pagerank.dangling_mass(none).first().mass == 0
