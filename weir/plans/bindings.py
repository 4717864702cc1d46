"""The registered queries outside weir.llm: operators applied to the driver's tables, and their oracle SQL."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import links, load, render
from ..functions.text import fields, target, words, year_of
from ..operators import graph, matrix, means, pagerank, topk
from ..runtime import cut, work_dir
from ..sources import readers, sinks


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/sink-{uuid.uuid4().hex}"


VIEWED = {"mean_min": "view", "mean_max": "purchase"}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("element"), "value")


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means.word_count(_table(spark, sf_dir, "documents"), "text")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))


def group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where("element = 'purchase'")
    return means.group_mean(rows, "user_id").select("user_id", F.round("mean", 9).alias("mean"))


def group_values_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = means.group_values(_events(spark, sf_dir).where("element = 'purchase'"), "user_id")
    return rows.select("user_id", F.size("values").cast("long").alias("n"), F.round(means.list_mean(F.col("values")), 6).alias("mean"))


def conditional_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = means.conditional_means(_events(spark, sf_dir), "user_id", "day", of=VIEWED)
    return out.select("user_id", "day", *(F.round(c, 9).alias(c) for c in VIEWED))


def partial_merge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    halves = [means.partial_means(rows.where(half), "user_id", "day", of=VIEWED) for half in ("value < 50", "NOT value < 50")]
    out = means.merged_means(halves[0].unionByName(halves[1]), "user_id", "day", columns=tuple(VIEWED))
    return out.select("user_id", "day", *(F.round(c, 9).alias(c) for c in VIEWED))


RETURNED = {"mean_tmin": "A", "mean_tmax": "R"}


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("station"), F.date_format("l_shipdate", "yyyyMMdd").alias("date"), F.col("l_returnflag").alias("element"), F.col("l_quantity").alias("value")
    )
    return means.yearly_means(rows, of=RETURNED)


def yearly_series_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _yearly(spark, sf_dir).select("station", "year", *(F.round(c, 9).alias(c) for c in RETURNED))


def yearly_series_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested, then laid out again with each year's place in its station's series."""
    nested = means.series(_yearly(spark, sf_dir))
    return nested.select("station", F.posexplode("series").alias("place", "s")).select("station", F.col("place").cast("long").alias("place"), "s.year", *(F.round(f"s.{c}", 9).alias(c) for c in RETURNED))


def year_zero_null_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = means.zero_filled(_yearly(spark, sf_dir), tuple(RETURNED))
    return filled.select("station", "year", *(F.round(c, 9).alias(c) for c in RETURNED))


def series_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = means.series(_yearly(spark, sf_dir))
    return nested.select(render.series_line(F.col("station").cast("string"), F.col("series")).alias("line"))


def csv_parse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    written = events.select(F.concat_ws(",", F.col("user_id"), F.date_format("ts", "yyyyMMdd"), "event_type", F.col("event_id"), F.lit(""), F.lit("")).alias("value"))
    rows = readers.elements(readers.readings(written, "long"), "view", "purchase")
    return rows.select("station", year_of(F.col("date")).alias("year"), "element", "value")


def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing empty fields don't count; empty ones before others do."""
    events = _table(spark, sf_dir, "events")
    line = F.concat_ws(",", F.col("event_id"), F.when(F.col("event_id") % 2 == 0, "x").otherwise(""), F.when(F.col("event_id") % 3 == 0, "y").otherwise(""), F.lit(""))
    return events.select("event_id", F.size(fields(line)).cast("long").alias("n_fields"))


def _hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select(F.col("url").alias("src"), F.explode(links.lenient_hrefs(F.col("html"))).alias("dst"))


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(links.lenient_hrefs(F.col("html"))).alias("place", "href")).select("page_id", F.col("place").cast("long").alias("place"), "href")


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict profile's rule for targets, on links made of the lenient profile's."""
    made = link_extract(spark, sf_dir).select("page_id", "place", F.concat(F.lit("../w"), "href", F.lit(".html")).alias("href"))
    return made.select("page_id", "place", target(F.col("href")).alias("page"))


def strict_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed pages made of the documents' words, through the strict extractor: each links to its own words, and
    German ones don't parse."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1).alias("w"))
    anchors = F.array_join(F.transform("w", lambda w: F.concat(F.lit('<a href="./x/'), w, F.lit('.html">l</a>'))), "")
    html = F.concat(F.lit('<html><body><a href="./x/out.html">o</a><div id="BodyContent"><p>'), anchors, F.when(F.col("lang") == "de", "").otherwise("</p>"), F.lit("</div></body></html>"))
    lines = docs.select(F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(":"), html).alias("value"))
    return links.strict_links(readers.pages(lines)).select("page", F.array_join("links", ",").alias("links"))


def _links_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(F.col("url").alias("page"), links.lenient_hrefs(F.col("html")).alias("links"))


def page_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.vertices(_links_of_pages(spark, sf_dir)).select("page", F.size("links").cast("long").alias("n_links"))


def pages_first_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one name made by cutting urls to their host: of several the one with links that comes first."""
    rows = _links_of_pages(spark, sf_dir).select(F.substring_index("page", "/", 3).alias("page"), "links")
    return graph.merged_pages(rows, "first").select("page", F.array_join("links", " ").alias("links"))


def pages_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _links_of_pages(spark, sf_dir).select(F.substring_index("page", "/", 3).alias("page"), "links")
    return graph.merged_pages(rows).select("page", F.array_join(F.array_sort("links"), " ").alias("links"))


def adjacency_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through page~~a, b: a link that holds a comma and a space becomes two."""
    rows = _links_of_pages(spark, sf_dir).select("page", F.transform("links", lambda x: F.when(F.length(x) % 2 == 0, F.concat(x, F.lit(", x"))).otherwise(x)).alias("links"))
    page, found = render.split_adjacency(render.adjacency_line(F.col("page"), F.col("links")))
    return rows.select(page.alias("page"), F.size(found).cast("long").alias("n_links"))


def _cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is a link: of parts and suppliers to each other, with repeats, by returned or accepted; of the
    rest, by the supplier's number, of parts to the page of their line's number, which links to nobody, and of the page
    of their day, which nobody links to, to parts."""
    item = _table(spark, sf_dir, "lineitem")
    part, supplier = F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("S"), "l_suppkey")
    line, day = F.concat(F.lit("L"), "l_linenumber"), F.concat(F.lit("D"), F.date_format("l_shipdate", "yyyyMMdd"))
    returned, accepted, even = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A", F.col("l_suppkey") % 2 == 0
    return item.select(
        F.when(returned, part).when(accepted, supplier).when(even, part).otherwise(day).alias("src"),
        F.when(returned, supplier).when(accepted, part).when(even, line).otherwise(part).alias("dst"),
    )


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(_cyclic(spark, sf_dir))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)


def vertex_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).agg(F.count("*").alias("n"))


def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).where("out_degree > 0").select("page", "out_degree")


def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).where("in_degree > 0").select("page", "in_degree")


def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dangling(_graph(spark, sf_dir))


def no_inlink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.no_inlink(_graph(spark, sf_dir))


def page_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dictionary(_graph(spark, sf_dir))


def _matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = _cyclic(spark, sf_dir)
    pages = cut(graph.dictionary(graph.nodes(edges)))
    return matrix.transition(matrix.numbered(edges, pages)), pages


def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _matrix(spark, sf_dir)
    return found.select("row_id", "col_id", F.round("weight", 12).alias("weight"))


def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _matrix(spark, sf_dir)
    return matrix.rows(found).select("row_id", F.size("entries").cast("long").alias("n"), F.round(F.aggregate("entries", F.lit(0.0), lambda a, e: a + e["weight"]), 9).alias("weight"))


def matrix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed by column and laid out again: each column adds up to one."""
    found, _ = _matrix(spark, sf_dir)
    return matrix.entries(matrix.columns(found)).groupBy("col_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 9).alias("weight"))


def _ranked(spark: SparkSession, sf_dir: str, iterations: int, variant: str) -> DataFrame:
    edges = cut(_cyclic(spark, sf_dir))
    return pagerank.pagerank(graph.nodes(edges), edges, iterations, variant=variant)


def _ranks(iterations: int, variant: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _ranked(spark, sf_dir, iterations, variant).select("page", F.round("rank", 9).alias("rank"))

    return query


def dangling_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _ranked(spark, sf_dir, 1, "adjacency").join(_graph(spark, sf_dir).select("page", "dangling"), "page")
    return pagerank.dangling_mass(ranks).select(F.round("mass", 9).alias("mass"))


def total_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank.total(_ranked(spark, sf_dir, 3, "adjacency")).select(F.round("total", 9).alias("total"))


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).select("page", F.col("in_degree").cast("double").alias("rank"))


def topk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By inlinks, whole numbers, so that ties are many and exact."""
    return topk.top(_degrees(spark, sf_dir), 100)


def topk_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = cut(graph.dictionary(_graph(spark, sf_dir)))
    ranks = _degrees(spark, sf_dir).join(pages, "page").select("page_id", "rank")
    return topk.top_named(ranks, pages, 100)


def topk_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topk.top(_degrees(spark, sf_dir), 100)
    return best.select(render.named_rank(F.col("page"), F.col("rank")).alias("line"))


def topk_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k as each of the three kinds of result file has it."""
    best = cut(topk.top(_degrees(spark, sf_dir), 100))
    page, rank = F.col("page"), F.col("rank")
    forms = {"named": render.named_rank(page, rank), "ranked": render.rank_named(rank, page), "pair": render.pair(rank, page)}
    return best.select(F.explode(F.array(*(F.struct(F.lit(k).alias("form"), v.alias("line")) for k, v in forms.items()))).alias("x")).select("x.*")


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks to nine decimals, so that ties and order don't depend on the order of additions."""
    return _ranked(spark, sf_dir, 10, "adjacency").select("page", F.round("rank", 9).alias("rank"))


def pagerank_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(_best(spark, sf_dir), 100)


def pagerank_top_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(_best(spark, sf_dir), 100).select(render.named_rank(F.col("page"), F.col("rank")).alias("line"))


def pagerank_top_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By ids, as the matrix forms rank pages; names come last."""
    pages = cut(graph.dictionary(_graph(spark, sf_dir)))
    ranks = _ranked(spark, sf_dir, 10, "column").join(pages, "page").select("page_id", F.round("rank", 9).alias("rank"))
    return topk.top_named(ranks, pages, 100)


def _crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl made of the documents, as lines: each page links to its own words and to the next document. German pages
    don't parse, Spanish names hold a tilde, and French pages have a lone ampersand, which is repaired."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1).alias("w"))
    names = F.concat("w", F.array(F.concat(F.lit("D"), (F.col("doc_id") + 1).cast("string"))))
    anchors = F.array_join(F.transform(names, lambda w: F.concat(F.lit('<a href="./x/'), w, F.lit('.html">l</a>'))), "")
    between, end = F.when(F.col("lang") == "fr", " & ").otherwise(""), F.when(F.col("lang") == "de", "").otherwise("</p>")
    html = F.concat(F.lit('<html><body><div id="bodyContent"><p>'), between, anchors, end, F.lit("</div></body></html>"))
    name = F.concat(F.when(F.col("lang") == "es", "D~").otherwise("D"), F.col("doc_id").cast("string"))
    return docs.select(F.concat(name, F.lit(":"), html).alias("value"))


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as bz2 files and read back: from lines to pages with their links."""
    folder = _folder(spark)
    sinks.value_text(_crawl(spark, sf_dir), F.col("value"), folder, "bzip2")
    return cut(links.strict_links(readers.pages(readers.lines(spark, f"{folder}/*.bz2"))))


def crawl_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.vertices(_crawled(spark, sf_dir)).select("page", F.size("links").cast("long").alias("n_links"))


def crawl_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From lines of a crawl to the hundred pages of highest rank."""
    crawled = cut(graph.vertices(_crawled(spark, sf_dir)))
    edges = cut(graph.edges_of(crawled))
    ranks = pagerank.pagerank(graph.nodes(edges, crawled.select("page")), edges, 10)
    return topk.top(ranks.select("page", F.round("rank", 9).alias("rank")), 100)


def two_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of lines read as one input."""
    folder = _folder(spark)
    sinks.value_text(_table(spark, sf_dir, "customer"), F.col("c_name"), f"{folder}/customers")
    sinks.value_text(_table(spark, sf_dir, "supplier"), F.col("s_name"), f"{folder}/suppliers", "bzip2")
    return readers.lines(spark, f"{folder}/customers", f"{folder}/suppliers").groupBy("value").agg(F.count("*").alias("n"))


def single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k in one file, read back in its order."""
    folder = _folder(spark)
    sinks.single_text(topk.top(_degrees(spark, sf_dir), 100), render.named_rank(F.col("page"), F.col("rank")), folder)
    found = cut(readers.lines(spark, folder).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")))
    files = found.select("file").distinct().count()
    # A hundred rows, in one file.
    place = F.row_number().over(Window.orderBy("at")).cast("long")
    return found.select(place.alias("place"), F.col("value").alias("line"), F.lit(files).cast("long").alias("n_files"))


def station_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each station, in how many partitions its years lie, and whether each follows what it should."""
    dealt = means.partitioned_by_station(_yearly(spark, sf_dir), 8)
    rows = cut(dealt.select("station", "year", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    here = F.struct("station", "year")
    before = F.lag(here).over(Window.partitionBy("part").orderBy("at"))
    checked = rows.select("station", "part", F.coalesce(before < here, F.lit(True)).alias("after"))
    return checked.groupBy("station").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"), F.bool_and("after").alias("in_order"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of means and of run times, read back."""
    found = means.group_mean(_events(spark, sf_dir).where("element = 'purchase'"), "user_id")
    path = sinks.station_log(found.select(F.col("user_id").alias("station"), F.round("mean", 9).alias("mean")), _folder(spark), datetime.datetime(2020, 1, 2, 15, 4), [40.0, 20.0, 60.0])
    return readers.lines(spark, path).select("value", F.lit(path.rsplit("/", 1)[-1]).alias("log"))


def means_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of lines of means; a missing mean is the word null."""
    found = means.conditional_means(_events(spark, sf_dir), "user_id", of=VIEWED)
    half = [F.round(F.when(F.col("user_id") % 2 == 0, F.col("mean_min")), 9), F.round("mean_max", 9)]
    station = F.col("user_id").cast("string")
    return found.select(render.means_line(station, *half).alias("line"), render.bar_line(station, half[1]).alias("bar"))


def csv_short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views have no value, so their lines are too short and left out."""
    value = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_id").cast("string"))
    written = _table(spark, sf_dir, "events").select(F.concat_ws(",", F.col("user_id"), F.date_format("ts", "yyyyMMdd"), "event_type", value, F.lit(""), F.lit("")).alias("value"))
    return readers.readings(written, "long")


def fib_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return events.select("event_id", load.fib(spark, F.lit(17) + F.col("event_id") * 0).alias("fib"))


def text_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts written as keyed lines, and as bz2 lines of values; both read back and compared."""
    folder, counts = _folder(spark), word_count(spark, sf_dir)
    sinks.keyed_text(counts, F.col("word"), F.col("cnt"), f"{folder}/keyed")
    sinks.value_text(counts, F.concat_ws("\t", "word", F.col("cnt")), f"{folder}/values", "bzip2")
    keyed, values = readers.lines(spark, f"{folder}/keyed"), readers.lines(spark, f"{folder}/values/*.bz2")
    both = keyed.select("value", F.lit(1).alias("k"), F.lit(0).alias("v")).union(values.select("value", F.lit(0), F.lit(1)))
    return both.groupBy("value").agg(F.sum("k").alias("keyed"), F.sum("v").alias("plain"))


def many_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several results beside each other, read back as one."""
    folder, nodes = _folder(spark), cut(_graph(spark, sf_dir))
    sinks.many({"dangling": graph.dangling(nodes), "no_inlink": graph.no_inlink(nodes)}, folder)
    rows = [readers.table(spark, f"{folder}/{name}").select(F.lit(name).alias("output"), "page") for name in ("dangling", "no_inlink")]
    return rows[0].unionByName(rows[1])


QUERIES = {
    f.__name__: f
    for f in (
        word_count, tokens, group_mean, group_values_list, conditional_means, partial_merge_means, yearly_series_long, yearly_series_nested,
        year_zero_null_fill, series_rendered, csv_parse_filter, csv_fields, link_extract, link_targets, strict_pages, page_vertices,
        pages_first_record, pages_concatenated, adjacency_round_trip, graph_nodes, vertex_count, out_degree, in_degree, dangling, no_inlink,
        page_dictionary, transition_matrix, matrix_rows, matrix_columns, dangling_mass, total_rank, topk_pages, topk_named, topk_rendered,
        fib_load, text_sinks, many_sinks, topk_formats, pagerank_top, pagerank_top_rendered, pagerank_top_named, crawl_vertices, crawl_top, two_paths,
        single_file, station_partitions, log_lines, means_rendered, csv_short_lines,
    )
} | {
    "pagerank_step": _ranks(1, "adjacency"),
    "pagerank_10": _ranks(10, "adjacency"),
    "pagerank_row": _ranks(10, "row"),
    "pagerank_column": _ranks(10, "column"),
    "pagerank_lagged": _ranks(10, "lagged"),
}

_EVENTS = "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type AS element, value FROM events"
_MEANS = f"""
    SELECT user_id, day, round(avg(value) FILTER (WHERE element = 'view'), 9) AS mean_min, round(avg(value) FILTER (WHERE element = 'purchase'), 9) AS mean_max
    FROM ({_EVENTS}) WHERE element IN ('view', 'purchase') GROUP BY user_id, day"""
_YEARLY = """
    SELECT l_partkey AS station, strftime(l_shipdate, '%Y') AS year, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS mean_tmin,
           avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS mean_tmax
    FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL"""
_WORDS = r"SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM documents"
_HREFS = """regexp_extract_all(html, 'href="([^"]*)"', 1)"""
_EDGES = """edges AS MATERIALIZED (
        SELECT CASE WHEN l_returnflag = 'A' THEN 'S' || l_suppkey WHEN l_returnflag = 'R' OR l_suppkey % 2 = 0 THEN 'P' || l_partkey
                    ELSE 'D' || strftime(l_shipdate, '%Y%m%d') END AS src,
               CASE WHEN l_returnflag = 'R' THEN 'S' || l_suppkey WHEN l_returnflag = 'A' OR l_suppkey % 2 <> 0 THEN 'P' || l_partkey
                    ELSE 'L' || l_linenumber END AS dst
        FROM lineitem),
    nodes AS MATERIALIZED (
        SELECT page, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, sum(o) = 0 AS dangling
        FROM (SELECT src AS page, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY page)"""
_PAGES = "pages_d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY page) - 1 AS page_id, page FROM nodes)"
_MATRIX = f"""{_EDGES}, {_PAGES},
    matrix AS MATERIALIZED (
        SELECT d.page_id AS row_id, s.page_id AS col_id, count(*) / any_value(n.out_degree) AS weight
        FROM edges JOIN pages_d s ON s.page = src JOIN pages_d d ON d.page = dst JOIN nodes n ON n.page = src GROUP BY 1, 2)"""


def _rank_ctes(iterations: int, lagged: bool = False, edges: str = _EDGES) -> str:
    out = [f"{edges}, r0 AS MATERIALIZED (SELECT page, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for k in range(1, iterations + 1):
        p = f"r{k - 1}"
        spread = "0" if lagged and k == iterations else f"(SELECT coalesce(sum(rank), 0) FROM {p} JOIN nodes USING (page) WHERE dangling)"
        out.append(f"""g{k} AS MATERIALIZED (
        SELECT dst AS page, sum(rank / out_degree) AS got FROM edges JOIN {p} ON {p}.page = src JOIN nodes ON nodes.page = src GROUP BY dst),
    r{k} AS MATERIALIZED (
        SELECT page, (0.15::DOUBLE + 0.85::DOUBLE * {spread}) / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * coalesce(got, 0) AS rank
        FROM nodes LEFT JOIN g{k} USING (page))""")
    return "WITH " + ",\n    ".join(out)


_CRAWL = """crawl AS (SELECT 'D' || doc_id AS page, list_append(regexp_extract_all(text, '[A-Za-z]+'), 'D' || (doc_id + 1)) AS w
              FROM documents WHERE lang NOT IN ('de', 'es')),
    edges AS MATERIALIZED (SELECT page AS src, unnest(w) AS dst FROM crawl),
    nodes AS MATERIALIZED (
        SELECT page, CAST(sum(o) AS BIGINT) AS out_degree, sum(o) = 0 AS dangling
        FROM (SELECT src AS page, 1 AS o FROM edges UNION ALL SELECT dst, 0 FROM edges) GROUP BY page)"""
_TOP = "SELECT page, round(rank, 9) AS rank FROM r10 ORDER BY round(rank, 9) DESC, page DESC LIMIT 100"
_TEN = _rank_ctes(10) + " SELECT page, round(rank, 9) AS rank FROM r10"

ORACLES = {
    "word_count": f"SELECT word, count(*) AS cnt FROM (SELECT unnest(w) AS word FROM ({_WORDS})) GROUP BY word",
    "tokens": f"SELECT doc_id, len(w) AS n_words FROM ({_WORDS})",
    "group_mean": f"SELECT user_id, round(avg(value), 9) AS mean FROM ({_EVENTS}) WHERE element = 'purchase' GROUP BY user_id",
    "group_values_list": f"SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM ({_EVENTS}) WHERE element = 'purchase' GROUP BY user_id",
    "conditional_means": _MEANS,
    "partial_merge_means": _MEANS,
    "yearly_series_long": f"SELECT station, year, round(mean_tmin, 9) AS mean_tmin, round(mean_tmax, 9) AS mean_tmax FROM ({_YEARLY})",
    "yearly_series_nested": f"""SELECT station, row_number() OVER (PARTITION BY station ORDER BY year) - 1 AS place, year, round(mean_tmin, 9) AS mean_tmin,
        round(mean_tmax, 9) AS mean_tmax FROM ({_YEARLY})""",
    "year_zero_null_fill": f"""SELECT station, year, round(CASE WHEN mean_tmin IS NULL AND lead(year) OVER w IS NOT NULL THEN 0 ELSE mean_tmin END, 9) AS mean_tmin,
        round(CASE WHEN mean_tmax IS NULL AND lead(year) OVER w IS NOT NULL THEN 0 ELSE mean_tmax END, 9) AS mean_tmax
        FROM ({_YEARLY}) WINDOW w AS (PARTITION BY station ORDER BY year)""",
    "csv_parse_filter": """SELECT CAST(user_id AS VARCHAR) AS station, strftime(ts, '%Y') AS year, event_type AS element, event_id AS value
        FROM events WHERE event_type IN ('view', 'purchase')""",
    "csv_fields": "SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 3 WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_fields FROM events",
    "link_extract": f"SELECT page_id, generate_subscripts(h, 1) - 1 AS place, unnest(h) AS href FROM (SELECT page_id, {_HREFS} AS h FROM pages)",
    "link_targets": f"""SELECT page_id, place, CASE WHEN p <> '' THEN p END AS page
        FROM (SELECT page_id, place, regexp_extract(url_decode('../w' || href || '.html'), '^\\..*/([^~]+)\\.html$', 1) AS p
              FROM (SELECT page_id, generate_subscripts(h, 1) - 1 AS place, unnest(h) AS href FROM (SELECT page_id, {_HREFS} AS h FROM pages)))""",
    "strict_pages": """SELECT 'D' || doc_id AS page, array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ',') AS links FROM documents WHERE lang <> 'de' """,
    "page_vertices": f"""WITH l AS (SELECT url AS page, unnest({_HREFS}) AS dst FROM pages),
        v AS (SELECT url AS page FROM pages UNION SELECT dst FROM l)
        SELECT page, count(dst) AS n_links FROM v LEFT JOIN l USING (page) GROUP BY page""",
    "pages_concatenated": f"""WITH l AS (SELECT regexp_extract(url, '^([^/]*/){{0,2}}[^/]*') AS page, {_HREFS} AS h FROM pages)
        SELECT page, array_to_string(list_sort(flatten(list(h))), ' ') AS links FROM l GROUP BY page""",
    "pages_first_record": f"""WITH l AS (SELECT regexp_extract(url, '^([^/]*/){{0,2}}[^/]*') AS page, {_HREFS} AS h FROM pages)
        SELECT page, array_to_string(coalesce(min(h) FILTER (WHERE len(h) > 0), []), ' ') AS links FROM l GROUP BY page""",
    "adjacency_round_trip": f"""SELECT url AS page, len(h) + len(list_filter(h, lambda x: length(x) % 2 = 0)) AS n_links FROM (SELECT url, {_HREFS} AS h FROM pages)""",
    "graph_nodes": f"WITH {_EDGES} SELECT * FROM nodes",
    "vertex_count": f"WITH {_EDGES} SELECT count(*) AS n FROM nodes",
    "out_degree": f"WITH {_EDGES} SELECT page, out_degree FROM nodes WHERE out_degree > 0",
    "in_degree": f"WITH {_EDGES} SELECT page, in_degree FROM nodes WHERE in_degree > 0",
    "dangling": f"WITH {_EDGES} SELECT page FROM nodes WHERE dangling",
    "no_inlink": f"WITH {_EDGES} SELECT page FROM nodes WHERE in_degree = 0",
    "page_dictionary": f"WITH {_EDGES}, {_PAGES} SELECT page_id, page FROM pages_d",
    "transition_matrix": f"WITH {_MATRIX} SELECT row_id, col_id, round(weight, 12) AS weight FROM matrix",
    "matrix_rows": f"WITH {_MATRIX} SELECT row_id, count(*) AS n, round(sum(weight), 9) AS weight FROM matrix GROUP BY row_id",
    "matrix_columns": f"WITH {_MATRIX} SELECT col_id, count(*) AS n, round(sum(weight), 9) AS weight FROM matrix GROUP BY col_id",
    "pagerank_step": _rank_ctes(1) + " SELECT page, round(rank, 9) AS rank FROM r1",
    "pagerank_10": _TEN,
    "pagerank_row": _TEN,
    "pagerank_column": _TEN,
    "pagerank_lagged": _rank_ctes(10, True) + " SELECT page, round(rank, 9) AS rank FROM r10",
    "dangling_mass": _rank_ctes(1) + " SELECT round(sum(rank), 9) AS mass FROM r1 JOIN nodes USING (page) WHERE dangling",
    "total_rank": _rank_ctes(3) + " SELECT round(sum(rank), 9) AS total FROM r3",
    "topk_pages": f"WITH {_EDGES} SELECT page, CAST(in_degree AS DOUBLE) AS rank FROM nodes ORDER BY rank DESC, page DESC LIMIT 100",
    "topk_named": f"WITH {_EDGES}, {_PAGES} SELECT page_id, page, CAST(in_degree AS DOUBLE) AS rank FROM nodes JOIN pages_d USING (page) ORDER BY rank DESC, page_id DESC LIMIT 100",
    "topk_rendered": f"WITH {_EDGES} SELECT printf('%s:%.15f', page, CAST(in_degree AS DOUBLE)) AS line FROM nodes ORDER BY in_degree DESC, page DESC LIMIT 100",
    "topk_formats": f"""WITH {_EDGES}, best AS (SELECT page, CAST(in_degree AS DOUBLE) AS rank FROM nodes ORDER BY rank DESC, page DESC LIMIT 100)
        SELECT 'named' AS form, printf('%s:%.15f', page, rank) AS line FROM best
        UNION ALL SELECT 'ranked', rank || ':' || page FROM best UNION ALL SELECT 'pair', '(' || rank || ',' || page || ')' FROM best""",
    "pagerank_top": f"{_rank_ctes(10)} {_TOP}",
    "pagerank_top_rendered": f"{_rank_ctes(10)} SELECT printf('%s:%.15f', page, rank) AS line FROM ({_TOP})",
    "pagerank_top_named": f"{_rank_ctes(10)}, {_PAGES} SELECT page_id, page, rank FROM ({_TOP}) JOIN pages_d USING (page)",
    "crawl_vertices": f"WITH {_CRAWL} SELECT page, out_degree AS n_links FROM nodes",
    "crawl_top": f"{_rank_ctes(10, edges=_CRAWL)} {_TOP}",
    "two_paths": "SELECT value, count(*) AS n FROM (SELECT c_name AS value FROM customer UNION ALL SELECT s_name FROM supplier) GROUP BY value",
    "single_file": f"""WITH {_EDGES} SELECT row_number() OVER (ORDER BY in_degree DESC, page DESC) AS place, printf('%s:%.15f', page, CAST(in_degree AS DOUBLE)) AS line,
        CAST(1 AS BIGINT) AS n_files FROM nodes ORDER BY place LIMIT 100""",
    "station_partitions": f"SELECT station, count(*) AS n, CAST(1 AS BIGINT) AS parts, true AS in_order FROM ({_YEARLY}) GROUP BY station",
    "log_lines": f"""SELECT value, '2020_01_02_03_04' AS log FROM (
        SELECT user_id || '|' || round(avg(value), 9) AS value FROM ({_EVENTS}) WHERE element = 'purchase' GROUP BY user_id
        UNION ALL SELECT unnest(['Average Running Time:40.0 ms', 'Minimum Running Time:20.0 ms', 'Maximum Running Time:60.0 ms']))""",
    "means_rendered": f"""SELECT concat_ws(', ', user_id, coalesce(CAST(lo AS VARCHAR), 'null'), coalesce(CAST(hi AS VARCHAR), 'null')) AS line, concat_ws('|', user_id, hi) AS bar
        FROM (SELECT user_id, round(avg(value) FILTER (WHERE element = 'view' AND user_id % 2 = 0), 9) AS lo, round(avg(value) FILTER (WHERE element = 'purchase'), 9) AS hi
              FROM ({_EVENTS}) WHERE element IN ('view', 'purchase') GROUP BY user_id)""",
    "csv_short_lines": """SELECT CAST(user_id AS VARCHAR) AS station, strftime(ts, '%Y%m%d') AS date, event_type AS element, event_id AS value
        FROM events WHERE event_type <> 'view'""",
    "series_rendered": f"""SELECT station || ', [' || string_agg('(' || year || ', ' || lo || ', ' || hi || ')', ', ' ORDER BY year) || ']' AS line
        FROM (SELECT station, year, coalesce(CAST(mean_tmin AS VARCHAR), CASE WHEN lead(year) OVER w IS NULL THEN 'null' ELSE '0' END) AS lo,
                     coalesce(CAST(mean_tmax AS VARCHAR), CASE WHEN lead(year) OVER w IS NULL THEN 'null' ELSE '0' END) AS hi
              FROM ({_YEARLY}) WINDOW w AS (PARTITION BY station ORDER BY year)) GROUP BY station""",
    "fib_load": "SELECT event_id, CAST(1597 AS BIGINT) AS fib FROM events",
    "text_sinks": f"""SELECT word || chr(9) || cnt AS value, CAST(1 AS BIGINT) AS keyed, CAST(1 AS BIGINT) AS plain
        FROM (SELECT word, count(*) AS cnt FROM (SELECT unnest(w) AS word FROM ({_WORDS})) GROUP BY word)""",
    "many_sinks": f"WITH {_EDGES} SELECT 'dangling' AS output, page FROM nodes WHERE dangling UNION ALL SELECT 'no_inlink', page FROM nodes WHERE in_degree = 0",
}
