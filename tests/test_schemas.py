"""Sources and operators give the shapes that schemas.py names."""

from pyspark.sql import functions as F

from weir import schemas
from weir.functions import links
from weir.operators import graph, matrix, pagerank
from weir.sources import readers


def shape(df):
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def named(schema):
    return [(f.name, f.dataType.simpleString()) for f in schema]


def test_shapes(spark, tmp_path):
    (tmp_path / "x").write_text("A:<r/>\n")
    lines = readers.lines(spark, str(tmp_path / "x"))
    assert shape(lines) == named(schemas.LINE)
    assert shape(readers.readings(lines)) == named(schemas.READING)
    pages = readers.pages(lines)
    assert shape(pages) == named(schemas.PAGE_LINE)
    found = links.strict_links(pages)
    assert shape(found) == named(schemas.PAGE_LINKS)
    edges = spark.createDataFrame([("a", "b")], schemas.EDGE)
    assert shape(graph.edges_of(found)) == named(schemas.EDGE)
    nodes = graph.nodes(edges)
    assert shape(nodes.select("page", "out_degree", "dangling")) == named(schemas.NODE)
    pages = graph.dictionary(nodes)
    assert shape(pages) == named(schemas.DICTIONARY)
    assert shape(matrix.transition(matrix.numbered(edges, pages))) == named(schemas.ENTRY)
    assert shape(pagerank.pagerank(nodes, edges, 1)) == named(schemas.RANK)
    assert shape(nodes.select(F.lit("a").alias("page"), F.lit(0.5).alias("rank"))) == named(schemas.RANK)
