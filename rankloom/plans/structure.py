"""Graphs, intervals, joins, audits, text clean-up and event windows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.context import scratch
from rankloom.functions import predicates
from rankloom.functions import text as tx
from rankloom.operators import audit, graph, intervals, joins, packing, ranking
from rankloom.plans.registry import query
from rankloom.sources import tables as src
from rankloom.sources.tables import table
from rankloom.streaming import windows


def world(spark, sf):
    """Regions, nations, customers and suppliers as a graph; links have a strength and go both ways."""
    nation, customer, supplier = (table(spark, sf, t) for t in ("nation", "customer", "supplier"))
    link = lambda df, a, b, w: df.select(a.alias("src"), b.alias("dst"), F.lit("of").alias("forward"), F.lit("has").alias("backward"), F.lit(w).alias("weight"))
    id_ = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    links = link(nation, id_("n", "n_nationkey"), id_("r", "n_regionkey"), graph.WEAK).unionByName(link(customer, id_("c", "c_custkey"), id_("n", "c_nationkey"), graph.NORMAL)).unionByName(link(supplier, id_("s", "s_suppkey"), id_("n", "s_nationkey"), graph.STRONG))
    edges = graph.two_way(links)
    names = {"r": "Region", "n": "Nation", "c": "Customer", "s": "Supplier"}
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    nodes = edges.select(F.col("src").alias("node")).distinct().withColumn("label", label[F.substring("node", 1, 1)])
    return nodes, edges


LINKS_SQL = """lk AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 1.0::DOUBLE AS weight FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 0.5::DOUBLE FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 0.25::DOUBLE FROM supplier),
    e AS (SELECT src, dst, weight::DOUBLE AS weight FROM lk UNION ALL SELECT dst, src, weight::DOUBLE FROM lk)"""


@query(
    f"""WITH RECURSIVE {LINKS_SQL}, w AS (SELECT 's1' AS node, 0.0::DOUBLE AS cost, ['s1'] AS path UNION ALL SELECT e.dst, w.cost + e.weight, list_append(w.path, e.dst) FROM w JOIN e ON w.node = e.src WHERE w.cost + e.weight <= 2.5 AND NOT list_contains(w.path, e.dst))
    SELECT 's1' AS root, node, round(min(cost), 6) AS cost FROM w GROUP BY node"""
)
def graph_sssp_cost(spark, sf):
    _, edges = world(spark, sf)
    roots = spark.createDataFrame([("s1",)], "root string")
    return graph.shortest_paths(graph.project(edges), roots, 2.5).select("root", "node", F.round("cost", 6).alias("cost"))


def described(spark, sf):
    """The world's nodes with a name, a path, a text and the vector of their number: suppliers are issues, customers methods, nations classes."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").alias("vector"))

    def part(name, letter, label, key, text, path):
        rows = table(spark, sf, name).select(F.col(key).cast("long").alias("k"), text.alias("text"), path.alias("file_path"))
        return rows.join(vectors, "k", "left").select(F.concat(F.lit(letter), F.col("k")).alias("node"), F.lit(label).alias("label"), F.substring_index("text", " ", 1).alias("name"), "file_path", "vector", "text")

    c, n = F.col("c_name"), F.col("n_name")
    parts = [part("supplier", "s", "Issue", "s_suppkey", F.concat(F.col("s_name"), F.lit(" in nation x.building and customer#000000001")), F.lit(None).cast("string"))]
    parts.append(part("customer", "c", "Method", "c_custkey", F.concat(c, F.lit(" "), F.col("c_mktsegment")), F.concat(F.lit("src/x."), F.lower("c_mktsegment"))))
    parts.append(part("nation", "n", "Class", "n_nationkey", F.lower(n), F.concat(F.lit("src/"), F.lower(n))))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SCORED_SQL = f"""{LINKS_SQL}, w AS (SELECT 's1' AS node, 0.0::DOUBLE AS cost, ['s1'] AS path UNION ALL SELECT e.dst, w.cost + e.weight, list_append(w.path, e.dst) FROM w JOIN e ON w.node = e.src WHERE w.cost + e.weight <= 2.5 AND NOT list_contains(w.path, e.dst)),
    best AS (SELECT node, min(cost) AS cost FROM w GROUP BY node),
    raw AS (SELECT 's' || s_suppkey AS node, 'Issue' AS label, s_suppkey AS k, s_name || ' in nation x.building and customer#000000001' AS text, NULL AS file_path FROM supplier
      UNION ALL SELECT 'c' || c_custkey, 'Method', c_custkey, c_name || ' ' || c_mktsegment, 'src/x.' || lower(c_mktsegment) FROM customer UNION ALL SELECT 'n' || n_nationkey, 'Class', n_nationkey, lower(n_name), 'src/' || lower(n_name) FROM nation),
    nodes AS (SELECT raw.*, split_part(text, ' ', 1) AS name, embedding::DOUBLE[] AS v FROM raw JOIN embeddings ON vec_id = k),
    parts AS (SELECT n.node, n.label, n.name, n.file_path, r.text AS root_text, list_dot_product(r.v, n.v) / (sqrt(list_dot_product(r.v, r.v)) * sqrt(list_dot_product(n.v, n.v))) AS cosine, 1 - levenshtein(r.text, n.text)::DOUBLE / greatest(length(r.text), length(n.text)) AS likeness, cost
      FROM best JOIN nodes n USING (node) JOIN nodes r ON r.node = 's1' WHERE n.node <> 's1' AND NOT (n.label = 'Method' AND contains(n.name, 'test') AND NOT contains(n.name, 'pytest')))"""


@query(f"WITH RECURSIVE {SCORED_SQL} SELECT node, label, round(cosine, 6) AS cosine, round(likeness, 6) AS likeness, round(cost, 6) AS cost FROM parts")
def graph_components(spark, sf):
    found = graph.components(reached(spark, sf), described(spark, sf))
    return found.select("node", "label", *[F.round(c, 6).alias(c) for c in ("cosine", "likeness", "cost")])


def reached(spark, sf):
    _, edges = world(spark, sf)
    return graph.shortest_paths(graph.project(edges), spark.createDataFrame([("s1",)], "root string"), 2.5)


@query(
    f"""WITH RECURSIVE {SCORED_SQL}, grid AS (SELECT unnest([0.6, 0.8])::DOUBLE AS decay, 0.3::DOUBLE AS weight),
    scored AS (SELECT node, decay, weight, round(CASE WHEN label = 'Issue' THEN cosine * pow(decay, cost) ELSE (weight * cosine + (1 - weight) * likeness) * pow(decay, cost)
        + 0.1 * (CASE WHEN length(name) > 3 AND contains(lower(root_text), lower(name)) THEN 1 ELSE 0 END + CASE WHEN contains(lower(root_text), lower(string_split(file_path, '/')[-1])) THEN 0.5 ELSE 0 END) END, 9) AS score, 1 AS other FROM parts CROSS JOIN grid
      UNION ALL SELECT 's1', decay, weight, 2.0, 0 FROM grid)
    SELECT node, decay, weight, round(score, 6)::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY decay, weight ORDER BY other, score DESC, node)::INT AS rank FROM scored)"""
)
def graph_scored_retrieval(spark, sf):
    ranked = graph.rerank_components(graph.components(reached(spark, sf), described(spark, sf)), [(0.6, 0.3), (0.8, 0.3)], boost=0.1)
    return ranked.select("node", "decay", "weight", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {LINKS_SQL}, p1 AS (SELECT ['s1', dst] AS path, dst AS node, 1 AS distance FROM e WHERE src = 's1'), p2 AS (SELECT list_append(path, dst) AS path, dst AS node, 2 AS distance FROM p1 JOIN e ON node = src WHERE NOT list_contains(path, dst)),
    p3 AS (SELECT list_append(path, dst) AS path, dst AS node, 3 AS distance FROM p2 JOIN e ON node = src WHERE node LIKE 'r%' AND NOT list_contains(path, dst)), f AS (SELECT * FROM p2 UNION ALL SELECT * FROM p3),
    s AS (SELECT node, min(distance) AS distance FROM f WHERE node LIKE 'n%' OR node LIKE 'c%' GROUP BY node)
    SELECT f.node, f.distance, count(DISTINCT path[2]) AS support, array_to_string(min(path), '>') AS path FROM f JOIN s ON f.node = s.node AND f.distance = s.distance GROUP BY ALL"""
)
def evidence_paths(spark, sf):
    nodes, edges = world(spark, sf)
    found = graph.evidence_paths(edges, nodes, "s1", ["Customer", "Supplier"], ["Customer", "Supplier", "Nation"], ["Nation", "Customer"], 3)
    return found.where("distance >= 2").select("node", "distance", "support", F.array_join("path", ">").alias("path"))


def page_links(spark, sf):
    """Links between the hosts and the top folders that pages name: (src, dst)."""
    pages = table(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://(?:www\.|m\.)?([^/]+)", 1).alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1))).alias("dst"))
    links = pages.distinct()
    return links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


PAGES_SQL = """pl AS (SELECT DISTINCT regexp_extract(url, '^https?://(?:www\\.|m\\.)?([^/]+)', 1) AS src, unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)) AS dst FROM pages), pe AS (SELECT src, dst FROM pl UNION SELECT dst, src FROM pl)"""


@query(
    f"WITH {PAGES_SQL}, n AS (SELECT DISTINCT src AS node FROM pe), deg AS (SELECT src, count(*) AS degree FROM pe GROUP BY src), r AS (SELECT min(node) AS root, count(*) AS n FROM n), s0 AS (SELECT node, CASE WHEN node = root THEN 1.0 ELSE 0.0 END::DOUBLE AS s FROM n, r), "
    + ", ".join(f"s{k} AS (SELECT node, 0.15 / r.n + 0.85 * coalesce(f, 0) AS s FROM n CROSS JOIN r LEFT JOIN (SELECT dst, sum(s / degree) AS f FROM pe JOIN deg USING (src) JOIN s{k - 1} ON node = pe.src GROUP BY dst) ON dst = node)" for k in range(1, 9))
    + " SELECT node, round(s / (SELECT max(s) FROM s8), 6) AS score FROM s8"
)
def ppr_scores(spark, sf):
    edges = page_links(spark, sf)
    root = edges.agg(F.min("src")).first()[0]
    return graph.rank_scores(edges, root, rounds=8).select("node", F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {PAGES_SQL}, w AS (SELECT min(src) AS node FROM pe UNION SELECT dst FROM w JOIN pe ON node = src) SELECT (SELECT min(src) FROM pe) AS root, node FROM w")
def page_link_closure(spark, sf):
    edges = page_links(spark, sf)
    return graph.closure(edges, edges.agg(F.min("src").alias("root"))).select("root", "node")


def spans(spark, sf):
    """Order intervals in days since 1992: from order date to the last shipment."""
    day = lambda c: F.datediff(F.col(c), F.lit("1992-01-01").cast("date"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("start"))
    last = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(day("l_shipdate")).alias("end"))
    return orders.join(last, "o_orderkey").where("end >= start")


SPANS_SQL = """sp AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS start, "end" FROM orders JOIN (SELECT l_orderkey, max(date_diff('day', DATE '1992-01-01', l_shipdate::DATE))::INT AS "end" FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
    WHERE "end" >= date_diff('day', DATE '1992-01-01', o_orderdate::DATE)), pt AS (SELECT DISTINCT o_custkey, start + 10 AS point FROM sp)"""


@query(f"""WITH {SPANS_SQL} SELECT o_custkey, point, o_orderkey, start, "end" FROM (SELECT pt.o_custkey, point, o_orderkey, start, "end", row_number() OVER (PARTITION BY pt.o_custkey, point ORDER BY "end" - start, start DESC, o_orderkey) AS n FROM pt JOIN sp ON pt.o_custkey = sp.o_custkey AND point BETWEEN start AND "end") WHERE n = 1""")
def innermost_interval(spark, sf):
    sp = spans(spark, sf)
    points = sp.select("o_custkey", (F.col("start") + 10).alias("point")).distinct()
    return intervals.innermost(points, sp, "o_custkey", tie=("o_orderkey",), width=64).select("o_custkey", "point", "o_orderkey", "start", "end")


@query(f"""WITH {SPANS_SQL}, i AS (SELECT o_orderkey, o_custkey, start + 5 AS s, start + 6 AS e FROM sp) SELECT o_orderkey, outer_o_orderkey FROM (SELECT i.o_orderkey, sp.o_orderkey AS outer_o_orderkey, row_number() OVER (PARTITION BY i.o_custkey, i.o_orderkey ORDER BY "end" - start, start, sp.o_orderkey) AS n FROM i JOIN sp ON i.o_custkey = sp.o_custkey AND start <= s AND e <= "end") WHERE n = 1""")
def enclosing_interval(spark, sf):
    sp = spans(spark, sf).withColumn("name", F.col("o_orderkey"))
    inner = sp.select("o_orderkey", "o_custkey", (F.col("start") + 5).alias("start"), (F.col("start") + 6).alias("end"))
    return intervals.enclosing(inner, sp, "o_custkey", "o_orderkey", width=64).select("o_orderkey", "outer_o_orderkey")


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), r AS (SELECT event_id AS near_id, user_id, ts AS near_ts FROM events WHERE event_type = 'view')
    SELECT event_id, near_id FROM (SELECT event_id, near_id, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(near_ts)), near_ts, near_id) AS n FROM l JOIN r USING (user_id)) WHERE n = 1""")
def nearest_event(spark, sf):
    events = table(spark, sf, "events")
    left = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'view'").select(F.col("event_id").alias("near_id"), "user_id", F.col("ts").alias("near_ts"))
    return intervals.nearest(left, right, "user_id", "ts", "near_ts", "near_id").select("event_id", "near_id")


@query("""WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS d FROM events), b AS (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS base FROM d) SELECT user_id, min(d)::INT AS first, max(d)::INT AS last, count(*) AS length FROM b GROUP BY user_id, base""")
def line_islands(spark, sf):
    days = table(spark, sf, "events").select("user_id", F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("d"))
    return intervals.islands(days, "user_id", "d").select("user_id", "first", "last", "length")


@query(f"""WITH {SPANS_SQL} SELECT a.o_orderkey AS o_orderkey, min(greatest(0, b.start - a."end", a.start - b."end"))::BIGINT AS gap FROM sp a JOIN sp b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey GROUP BY 1""")
def interval_gap(spark, sf):
    return intervals.least_gap(spans(spark, sf), "o_custkey", "o_orderkey").select("o_orderkey", F.col("gap").cast("long").alias("gap"))


@query("""WITH c AS (SELECT user_id, quantile_disc(epoch_us(ts), 0.5) AS cutoff FROM events GROUP BY user_id) SELECT event_id, epoch_us(ts) <= cutoff AS created_visible, (epoch_us(ts) <= cutoff AND coalesce(epoch_us(ts) + (value * 1000000)::BIGINT <= cutoff, false)) AS content_visible FROM events JOIN c USING (user_id)""")
def cutoff_visible(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("created"), F.round(F.col("value") * 1000000).cast("long").alias("v"))
    events = events.withColumn("updated", F.col("created") + F.col("v"))
    cutoffs = events.groupBy("user_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY created)").cast("long").alias("cutoff"))
    return audit.visible(events, cutoffs, "user_id").select("event_id", "created_visible", "content_visible")


@query("""WITH e AS (SELECT o_orderkey AS k, o_orderdate AS t FROM orders WHERE o_orderkey % 7 <> 0), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS t FROM orders WHERE o_orderkey % 11 <> 0)
    SELECT CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' WHEN e.t IS NOT DISTINCT FROM a.t THEN 'match' ELSE 'mismatch' END AS state, count(*) AS n FROM e FULL JOIN a ON e.k = a.k GROUP BY state""")
def cutoff_audit(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("t"))
    late = F.when(F.col("k") % 5 == 0, F.col("t") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("t"))
    return audit.cutoff_audit(orders.where("k % 7 <> 0"), orders.where("k % 11 <> 0").withColumn("t", late), "k", "t")


@query("SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON length(b.text) > 0 AND contains(d.text, b.text)")
def leakage_flags(spark, sf):
    return audit.contained_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("""WITH h AS (SELECT source, doc_id, sha256(coalesce(text, '') || chr(31) || lang) AS digest FROM documents), f AS (SELECT source, digest, row_number() OVER (PARTITION BY source ORDER BY first, digest)::INT AS slot FROM (SELECT source, digest, min(doc_id) AS first FROM h GROUP BY source, digest)) SELECT doc_id, slot FROM h JOIN f USING (source, digest)""")
def dedupe_slots(spark, sf):
    return packing.evaluation_slots(table(spark, sf, "documents"), "source", "doc_id", "text", "lang").select("doc_id", "slot")


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents")
def digest_manifest(spark, sf):
    return audit.digest_manifest(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT 'left' AS side, o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2) UNION ALL SELECT DISTINCT 'right', l_orderkey FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def pool_assertions(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return joins.unmatched(orders, table(spark, sf, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("k")), ["k"]).select("side", "k")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderkey % 3 = 0 AS updated FROM orders")
def merge_update(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return joins.merge_update(orders, orders.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey", ["o_orderstatus"])


@query("""WITH d AS (SELECT doc_id, text, lang, sha256(text) AS h FROM documents) SELECT a.doc_id, b.doc_id IS NOT NULL AS reused FROM d a LEFT JOIN d b ON b.doc_id = a.doc_id - 1 AND a.h = b.h""")
def reuse_by_hash(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    earlier = docs.select((F.col("doc_id") + 1).alias("doc_id"), "text", F.lit(True).alias("reused"))
    return joins.reuse_by_hash(docs, earlier, "doc_id", "text", ["reused"]).select("doc_id", F.coalesce("reused", F.lit(False)).alias("reused"))


@query("""WITH p AS (SELECT DISTINCT replace(p_type, ' ', '.') AS name FROM part), s AS (SELECT name, unnest(generate_series(1, len(string_split(name, '.')))) AS n FROM p), k AS (SELECT DISTINCT string_split(p_type, ' ')[1] AS module FROM part UNION SELECT DISTINCT array_to_string(string_split(p_type, ' ')[1:2], '.') FROM part WHERE p_size % 2 = 0),
    h AS (SELECT name, n, module FROM s JOIN k ON module = array_to_string(string_split(name, '.')[1:n], '.')) SELECT name, arg_max(module, n) AS module FROM h GROUP BY name""")
def longest_prefix(spark, sf):
    part = table(spark, sf, "part")
    names = part.select(F.regexp_replace("p_type", " ", ".").alias("name")).distinct()
    split = F.split("p_type", " ")
    known = part.select(split[0].alias("module")).union(part.where("p_size % 2 = 0").select(F.array_join(F.slice(split, 1, 2), "."))).distinct()
    return joins.longest_prefix(names, known, "name", "module").select("name", "module")


@query("""WITH f AS (SELECT DISTINCT regexp_replace(url, '^https?://[^/]+/|[?#].*$', '', 'g') AS path FROM pages), c AS (SELECT DISTINCT path FROM f WHERE path LIKE '%/%'), s AS (SELECT path, unnest(generate_series(1, len(string_split(path, '/')))) AS k FROM c)
    SELECT DISTINCT CASE WHEN k = 1 THEN '.' ELSE array_to_string(string_split(path, '/')[1:k - 1], '/') END AS parent, array_to_string(string_split(path, '/')[1:k], '/') AS child, k = len(string_split(path, '/')) AS child_is_file FROM s""")
def folder_links(spark, sf):
    paths = table(spark, sf, "pages").select(F.regexp_replace("url", r"^https?://[^/]+/|[?#].*$", "").alias("path")).where("path LIKE '%/%'").distinct()
    return src.folders(paths)


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), '<[^>]*>', ' ', 'g'), '[ \\t\\n]+', ' ', 'g'), ' ') AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links, length(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS cleaned FROM pages""")
def html_strip_links(spark, sf):
    pages = table(spark, sf, "pages")
    cleaned = F.regexp_replace(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), r"\n{3,}", "\n\n")
    return pages.select("page_id", src.html_ticket(F.col("html"))["title"].alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.length(cleaned).cast("long").alias("cleaned"))


@query("""SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 98) || chr(10) || '...' || chr(10) || right(text, 97) END AS ends,
    length(CASE WHEN length(t) > 80 THEN rtrim(left(t, 77)) || '...' ELSE t END) AS compacted FROM (SELECT *, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') AS t FROM documents)""")
def text_budgets(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tx.token_proxy(t).alias("tokens"), tx.truncate_keep_ends(t, 200).alias("ends"), F.length(tx.compact(t, 80)).cast("long").alias("compacted"))


@query("""SELECT a.doc_id AS doc_id, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 6) AS likeness FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents) a JOIN (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents) b ON b.doc_id = a.doc_id + 1""")
def levenshtein_similarity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("t"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return docs.join(after, "doc_id").select("doc_id", F.round(tx.levenshtein_similarity(F.col("t"), F.col("u")), 6).alias("likeness"))


@query("""SELECT p_partkey, contains(lower(p_name), 'test') AND NOT contains(lower(p_name), 'pytest') AS test, lower(p_name) LIKE '%.py' AS source, regexp_replace(regexp_replace(p_name, '^[ab]/', ''), '^(\\./)+', '') AS path, trim(split_part(split_part(p_name, ' = ', 1), '(', 1), ' ') AS symbol FROM part""")
def path_predicates(spark, sf):
    from rankloom.functions.identity import repository_path, symbol_base

    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", predicates.is_test_name(n).alias("test"), predicates.is_source(n, ("py",)).alias("source"), repository_path(n).alias("path"), symbol_base(n).alias("symbol"))


@query("""SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(source || '|' || doc_id))::INT AS rank FROM documents) WHERE rank <= 5""")
def stable_random(spark, sf):
    return ranking.stable_random_order(table(spark, sf, "documents"), "source", "doc_id").where("rank <= 5").select("doc_id", "rank")


@query("""WITH f AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) SELECT source, sha256(string_agg(printf('%02d. %s :: %s', rank::INT, doc_id::VARCHAR, lang_), chr(10) ORDER BY rank)) AS digest FROM (SELECT f.*, d.lang AS lang_ FROM f JOIN documents d USING (doc_id) WHERE rank <= 20) GROUP BY source""")
def window_binding(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("file"), F.col("lang").alias("signature"))
    return packing.render_window(ranking.rank_by(docs, "source", "doc_id"), 20, "source").select("source", F.sha2("window", 256).alias("digest"))


def event_values():
    return {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)}


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    """Run as a stream: the folder's file is read, aggregated by window in complete state, and each batch replaces the table written."""
    events = table(spark, sf, "events")
    state, out = scratch(spark, "events-state"), scratch(spark, "events-tumbling")
    stream = windows.tumbling(windows.stream(spark, sf, events.schema, "events.parquet"), "6 hours", ["event_type"], event_values())
    sink = stream.writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out))
    sink.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT s AS window_start, s + INTERVAL 12 HOURS AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 6 HOURS, ts), time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS]) AS s FROM events) GROUP BY ALL")
def events_sliding(spark, sf):
    return windows.sliding(table(spark, sf, "events"), "12 hours", "6 hours", ["event_type"], event_values())


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 4 HOURS AS window_end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def events_sessions(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "4 hours", ["user_id"], event_values())


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def resume_missing(spark, sf):
    done = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return src.missing(table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("""WITH f AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages), p AS (SELECT host, path, string_split(path, '/') AS a FROM f)
    SELECT host, wanted, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY host, wanted ORDER BY likeness DESC, path)::INT AS rank FROM (SELECT w.host, w.path AS wanted, f.path, round((CASE WHEN w.a[:-2] = f.a[:-2] THEN 2000 ELSE 0 END) + (CASE WHEN greatest(length(w.a[-1]), length(f.a[-1])) = 0 THEN 0 ELSE 300.0 * (1 - levenshtein(w.a[-1], f.a[-1]) / greatest(length(w.a[-1]), length(f.a[-1]))) END) + 10 * len(list_intersect(w.a, f.a))
      + len(list_intersect(list_transform(generate_series(1, len(w.a) - 1), lambda i: w.a[i] || '/' || w.a[i + 1]), list_transform(generate_series(1, len(f.a) - 1), lambda i: f.a[i] || '/' || f.a[i + 1]))), 6) AS likeness FROM p w JOIN p f USING (host))) WHERE rank <= 2""")
def fuzzy_paths(spark, sf):
    files = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("path")).distinct()
    return joins.fuzzy_paths(files.withColumnRenamed("path", "wanted"), files, "host", 2).select("host", "wanted", "path", "rank")
