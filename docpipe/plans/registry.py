"""The queries over the given tables and their SQL, by inventory number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docpipe.functions import text as tx
from docpipe.functions import vector_math as vm
from docpipe.operators import chunking as ch
from docpipe.operators import headings as hd
from docpipe.operators import html_rows as hr
from docpipe.operators import outline as ol
from docpipe.operators import page_structure as ps
from docpipe.operators import records as rc
from docpipe.operators import search as se
from docpipe.operators import vectors as ve
from docpipe.plans import jobs

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outline(docs: DataFrame) -> DataFrame:
    """A document's lines as an outline: the whole, blocks of ten lines, single lines."""
    n = docs.where("text is not null").select(F.col("doc_id").alias("doc"), F.size(F.split("text", "\n")).alias("n"))
    seq = lambda step: F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))).alias("st")
    l0 = n.select("doc", F.lit(0).alias("st"), (F.col("n") - 1).alias("en"), F.lit(0).alias("lvl"))
    l1 = n.select("doc", seq(10), "n").select("doc", "st", F.least(F.col("st") + 9, F.col("n") - 1).alias("en"), F.lit(1).alias("lvl"))
    l2 = n.select("doc", seq(1)).select("doc", "st", F.col("st").alias("en"), F.lit(2).alias("lvl"))
    rows = l0.unionByName(l1).unionByName(l2)
    caption = F.concat(F.element_at(F.array(F.lit("D"), F.lit("$B"), F.lit("L")), F.col("lvl") + 1), F.col("st").cast("string"))
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("doc").orderBy("st", "lvl")) - 1).withColumn("caption", caption)


OUTLINE = """n AS (SELECT doc_id AS doc, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
rows0 AS (SELECT doc, 0 AS st, n - 1 AS en, 0 AS lvl FROM n UNION ALL
  SELECT doc, st, least(st + 9, n - 1), 1 FROM (SELECT doc, n, unnest(range(0, n, 10)) AS st FROM n) UNION ALL
  SELECT doc, st, st, 2 FROM (SELECT doc, unnest(range(0, n)) AS st FROM n)),
node AS (SELECT doc, st, en, lvl, row_number() OVER (PARTITION BY doc ORDER BY st, lvl) - 1 AS idx,
  ['D', '$B', 'L'][lvl + 1] || st AS caption FROM rows0),
par AS (SELECT c.doc, c.idx, c.lvl, c.caption, arg_min(p.idx, p.st * 1000000 - p.idx) AS parent FROM node c
  LEFT JOIN node p ON p.doc = c.doc AND p.lvl = c.lvl - 1 AND p.st <= c.st AND p.en >= c.en GROUP BY ALL)"""


def nodes_of(spark, d):
    return outline(table(spark, d, "documents"))


# --- records -------------------------------------------------------------------------------------------------------


@query("p1_search", """SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31'
  AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def p1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return rc.search_documents(o, "o_orderdate", "o_orderkey", "1997-12-31", ["1-URGENT", "2-HIGH"], "1995-01-01", "o_orderpriority", page_size=50)


@query("p2_unique_lookup", """SELECT w.d::VARCHAR AS d, w.p, count(o.o_orderkey)::BIGINT AS n, CASE count(o.o_orderkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status
  FROM (SELECT DISTINCT l_shipdate::DATE AS d, '1-URGENT' AS p FROM lineitem) w LEFT JOIN orders o ON o.o_orderdate::DATE = w.d AND o.o_orderpriority = w.p GROUP BY ALL""")
def p2(spark, d):
    cards = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("p"))
    wanted = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("d"), F.lit("1-URGENT").alias("p")).distinct()
    return rc.lookup_unique(cards, wanted, ["d", "p"]).withColumn("d", F.col("d").cast("string"))


@query("p3_current", """SELECT user_id, arg_min(event_id, event_id) FILTER (event_type = 'purchase') AS event_id, arg_min(value, event_id) FILTER (event_type = 'purchase') AS value FROM events GROUP BY user_id""")
def p3(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return rc.pick_current(e, "user_id", "event_id", F.col("event_type") == "purchase").select("user_id", "current.event_id", "current.value")


_CAP = "'7. * на 01.03.2025 (№ ' || o_orderkey || '-ФЗ от ' || strftime(o_orderdate, '%d.%m.%Y') || ')'"


@query("p4_caption", f"""SELECT o_orderkey, nullif(regexp_extract(c, '№\\s+(\\d+-[ФЗК]+)', 1), '') AS source_number,
  try_strptime(nullif(regexp_extract(c, ' от (\\d{{2}}[.]\\d{{2}}[.]\\d{{4}})', 1), ''), '%d.%m.%Y')::DATE::VARCHAR AS source_date
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE {_CAP} END AS c FROM orders)""")
def p4(spark, d):
    o = table(spark, d, "orders")
    made = F.concat(F.lit("7. * на 01.03.2025 (№ "), F.col("o_orderkey").cast("string"), F.lit("-ФЗ от "), F.date_format("o_orderdate", rc.DATE), F.lit(")"))
    return rc.with_caption_source(o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).otherwise(made).alias("c")), "c").drop("c").withColumn("source_date", F.col("source_date").cast("string"))


_ED = "(event_id % 90 + 1) || ' - от ' || strftime(ts, '%d.%m.%Y') || ' № ' || event_id || '-ФЗ (' || event_type || ')'"


@query("p5_editions", f"""SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_id END AS edition_id, event_id % 7 <> 0 AS is_ready, ts::DATE::VARCHAR AS edition_date,
  event_id || '-ФЗ' AS number, event_type AS comment FROM events""")
def p5(spark, d):
    e = table(spark, d, "events")
    value = F.when(F.col("event_id") % 7 == 0, F.lit("n")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(",1021")))
    text = F.concat((F.col("event_id") % 90 + 1).cast("string"), F.lit(" - от "), F.date_format("ts", rc.DATE), F.lit(" № "), F.col("event_id").cast("string"), F.lit("-ФЗ ("), "event_type", F.lit(")"))
    return rc.parse_editions(e.select("event_id", value.alias("value"), text.alias("text"))).drop("value", "text").withColumn("edition_date", F.col("edition_date").cast("string"))


@query("p6_edition_lookup", """WITH w AS (SELECT DISTINCT ts::DATE AS d, event_type FROM events WHERE value > 50)
  SELECT w.d::VARCHAR AS d, w.event_type, (SELECT min(event_id) FROM events e WHERE e.ts::DATE = w.d AND e.event_type = w.event_type) AS event_id FROM w""")
def p6(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("d"), "event_type", "event_id", "value")
    return rc.find_first(e, e.where("value > 50").select("d", "event_type").distinct(), ["d", "event_type"], "event_id", "event_id").withColumn("d", F.col("d").cast("string"))


@query("p7_paragraph_classes", "SELECT page_id AS doc, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS n_paragraphs FROM pages WHERE len(regexp_extract_all(html, '<p[ >]')) > 0")
def p7(spark, d):
    blocks = hr.html_rows(table(spark, d, "pages"), "page_id", "html")
    return rc.text_paragraphs(blocks).groupBy("doc").agg(F.count("*").alias("n_paragraphs"))


@query("p8_paragraph_ids", """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id::INT END AS pid FROM events""")
def p8(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", rc.paragraph_number(F.concat(F.when(F.col("event_id") % 3 == 0, "q").otherwise("p"), F.col("event_id").cast("string"))).alias("pid"))


@query("p9_p11_payload_filters", """SELECT doc_id, n_chars, (lang = 'en' AND n_chars > 100 AND n_chars < 5000) AS all_of, (lang = 'en' OR (n_chars > 100 AND n_chars < 5000)) AS any_of FROM documents""")
def p9(spark, d):
    c = [rc.Eq("lang", "en"), rc.Range("n_chars", 100, 5000)]
    return table(spark, d, "documents").select("doc_id", "n_chars", rc.build_filter(c).alias("all_of"), rc.build_filter(c, "or").alias("any_of"))


@query("p12_dimension", "SELECT vec_id, coalesce(len(embedding) = 64, false) AS dim_ok FROM embeddings")
def p12(spark, d):
    return rc.dimension_status(table(spark, d, "embeddings"), 64).select("vec_id", "dim_ok")


@query("p13_nulls", "SELECT doc_id, nullif(lang, '') AS lang, nullif(regexp_replace(source, 'src0', ''), '') AS source FROM documents")
def p13(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.null_if_empty(F.col("lang")).alias("lang"), tx.null_if_empty(F.regexp_replace("source", "src0", "")).alias("source"))


# --- pages ---------------------------------------------------------------------------------------------------------


@query("h1_h2_clean_blocks")
def h1(spark, d):
    b = hr.html_rows(table(spark, d, "pages"), "page_id", "html", drop=True)
    return b.select("doc", "seq", "tag", F.md5("clean_text").alias("text_md5"))


@query("h3_scrub", """SELECT page_id, md5(regexp_replace(replace(html, '<p', '<p class="ed"'), '\\s?class="edx?"', '', 'g')) AS h FROM pages""")
def h3(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(hr.scrub_attributes(F.replace("html", F.lit("<p"), F.lit('<p class="ed"')))).alias("h"))


@query("h5_links", """SELECT page_id, i::INT AS pos, l[i + 1] AS href FROM (SELECT page_id, l, unnest(range(0, len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))""")
def h5(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(hr.hrefs(F.col("html"))).alias("pos", "href"))


@query("h6_carry_forward", """SELECT conv_id, turn, md5(coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER
  (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '')) AS last_user FROM conversations""")
def h6(spark, d):
    c = rc.carry_last(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user", F.col("text"), "u")
    return c.select("conv_id", "turn", F.md5(F.coalesce("u", F.lit(""))).alias("last_user"))


@query("h7_h8_sections")
def h7(spark, d):
    return hr.group_sections(hr.html_rows(table(spark, d, "pages"), "page_id", "html")).select("doc", "section_index", "section_type", F.md5("content").alias("content_md5"))


@query("h9_metadata")
def h9(spark, d):
    return hr.doc_metadata(hr.html_rows(table(spark, d, "pages"), "page_id", "html")).select("doc", F.to_json("meta").alias("meta"))


@query("h10_plain_text", r"""WITH p AS (SELECT page_id AS doc, i, trim(replace(regexp_replace(regexp_replace(regexp_extract(x[i], '(?s)^[^>]*>(.*?)(</p>|<footer|<div|<h1|<ul|<nav|<article|$)', 1), '<[^>]*>', '', 'g'), '&quot;', '"', 'g'), '&amp;', '&')) AS t
  FROM (SELECT page_id, x, unnest(range(2, len(x) + 1)) AS i FROM (SELECT page_id, string_split_regex(html, '<p\b') AS x FROM pages)))
  SELECT doc, length(t)::INT AS n_chars, md5(t) AS text_md5 FROM (SELECT doc, string_agg(t, chr(10) || chr(10) ORDER BY i) AS t FROM p WHERE t <> '' GROUP BY doc)""")
def h10(spark, d):
    return hr.plain_text(hr.html_rows(table(spark, d, "pages"), "page_id", "html")).select("doc", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


_PLAIN = "replace(regexp_replace(regexp_replace({0}, '&quot;', '\"', 'g'), '&amp;?', '&', 'g'), chr(160), ' ')"  # the entities that pages hold in titles and articles
_INNER = "regexp_replace(regexp_extract(html, '(?s){0}', 1), '<[^>]*>', {1}, 'g')"
_TITLE, _H1 = (f"trim(regexp_replace({_PLAIN.format(_INNER.format(f'<{t}[^>]*>(.*?)</{t}>', chr(39) * 2))}, '\\s+', ' ', 'g'))" for t in ("title", "h1"))
_ARTICLE = _PLAIN.format(_INNER.format("</h1>(.*?)</article>", "' '"))


def _structure(spark, d):
    return ps.structure_rows(table(spark, d, "pages"), "page_id", "html")


@query("x1_heading_sections", f"""SELECT page_id AS doc, 0 AS section_index, {_H1} AS heading, 1 AS level, 'h1' AS tag, md5(regexp_replace({_ARTICLE}, '\\s+', '', 'g')) AS content_md5 FROM pages
  WHERE regexp_replace({_ARTICLE}, '\\s+', '', 'g') <> ''""")
def x1(spark, d):
    """The blanks of contents are left out of the digest."""
    return ps.sections(_structure(spark, d)).select("doc", "section_index", "heading", "level", "tag", F.md5(F.regexp_replace("content", r"\s+", "")).alias("content_md5"))


@query("x3_titles", f"SELECT page_id AS doc, coalesce(nullif({_TITLE}, ''), nullif({_H1}, '')) AS title FROM pages")
def x3(spark, d):
    return ps.page_titles(_structure(spark, d))


@query("x4_x5_metadata", """SELECT page_id AS doc, NULL::VARCHAR AS author, len(t)::BIGINT AS word_count, ceil(len(t) / 200.0)::BIGINT AS reading_minutes FROM (SELECT page_id, list_filter(string_split_regex(
  regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)', 1), '(?s)<!--.*?-->', '', 'g'), '</?[ab]( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g'), '\\s+'), lambda x: x <> '') AS t FROM pages)""")
def x4(spark, d):
    return ps.page_metadata(_structure(spark, d)).select("doc", "author", "word_count", "reading_minutes")


@query("job_structure_chunks")
def job_structure(spark, d):
    """Pages to sections to chunks with path, title and reading time."""
    out = jobs.structure_chunks(table(spark, d, "pages").select(F.col("page_id").alias("doc"), "html"), tokens=250)
    return out.select("id", "doc", "chunk_index", "total_chunks", "path", "hierarchy_level", "title", "reading_minutes", F.md5("content").alias("content_md5"))


# --- outline -------------------------------------------------------------------------------------------------------


@query("t1_toc", f"WITH {OUTLINE} SELECT doc, st, arg_max(en, lvl) AS en, arg_max(lvl, lvl) AS lvl FROM node WHERE lvl < 2 GROUP BY doc, st")
def t1(spark, d):
    n = nodes_of(spark, d).where("lvl < 2")
    c = n.select("doc", F.col("lvl").alias("pos"), F.concat(F.lit("p"), F.col("st").cast("string")).alias("np"), F.concat(F.lit("p"), F.col("en").cast("string")).alias("npe"), "caption", F.lit("u").alias("unit"), "lvl")
    return ol.toc_intervals(c).select("doc", "st", "en", "lvl")


@query("t2_attach", f"""WITH {OUTLINE}, toc AS (SELECT doc, st, arg_max(en, lvl) AS en, max(lvl) AS lvl FROM node WHERE lvl < 2 GROUP BY doc, st)
  SELECT b.doc, b.st, coalesce(t.en, b.st) AS en, coalesce(t.lvl, coalesce(last_value(t.lvl IGNORE NULLS) OVER (PARTITION BY b.doc ORDER BY b.st ROWS UNBOUNDED PRECEDING), 0) + 1) AS lvl
  FROM node b LEFT JOIN toc t ON t.doc = b.doc AND t.st = b.st WHERE b.lvl = 2""")
def t2(spark, d):
    n = nodes_of(spark, d)
    toc = n.where("lvl < 2").groupBy("doc", "st").agg(F.max_by(F.struct("en", "caption", "lvl"), "lvl").alias("r")).select("doc", "st", "r.*", F.lit("u").alias("unit"))
    blocks = n.where("lvl = 2").select("doc", F.col("st").alias("seq"), F.col("st").alias("pid"), F.lit("").alias("text"))
    return ol.attach_outline(blocks, toc).select("doc", "st", "en", "lvl")


@query("t3_parents", f"WITH {OUTLINE} SELECT doc, idx, parent FROM par")
def t3(spark, d):
    return ol.parents(nodes_of(spark, d)).select("doc", "idx", "parent")


@query("t4_ancestors", f"""WITH RECURSIVE {OUTLINE}, up AS (SELECT doc, idx, parent AS anc_idx FROM par WHERE parent IS NOT NULL
  UNION ALL SELECT up.doc, up.idx, par.parent FROM up JOIN par ON par.doc = up.doc AND par.idx = up.anc_idx WHERE par.parent IS NOT NULL)
  SELECT up.doc, up.idx, anc_idx, n2.lvl AS anc_lvl FROM up JOIN node n2 ON n2.doc = up.doc AND n2.idx = anc_idx""")
def t4(spark, d):
    return ol.ancestors(nodes_of(spark, d))


@query("t5_paths", f"""WITH RECURSIVE {OUTLINE}, down AS (SELECT doc, idx, replace(caption, '$', '') AS path FROM par WHERE parent IS NULL
  UNION ALL SELECT c.doc, c.idx, down.path || '->' || replace(c.caption, '$', '') FROM down JOIN par c ON c.doc = down.doc AND c.parent = down.idx) SELECT doc, idx, path FROM down""")
def t5(spark, d):
    return ol.paths(nodes_of(spark, d))


@query("t6_children", f"WITH {OUTLINE} SELECT doc, parent AS idx, array_to_string(list(idx ORDER BY idx), ',') AS children FROM par WHERE parent < idx GROUP BY doc, parent")
def t6(spark, d):
    return ol.children(nodes_of(spark, d)).select("doc", "idx", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


_WIDE = "wide AS (SELECT doc, idx, st, CASE WHEN lvl = 1 AND st % 20 = 0 THEN en + 5 ELSE en END AS en, lvl FROM node)"


def wide(spark, d):
    return nodes_of(spark, d).withColumn("en", F.when((F.col("lvl") == 1) & (F.col("st") % 20 == 0), F.col("en") + 5).otherwise(F.col("en")))


@query("t7_overlaps", f"""WITH {OUTLINE}, {_WIDE} SELECT a.doc, a.lvl, a.idx AS a_idx, b.idx AS b_idx FROM wide a JOIN wide b
  ON a.doc = b.doc AND a.lvl = b.lvl AND a.idx < b.idx AND a.st <= b.en AND b.st <= a.en""")
def t7(spark, d):
    return ol.overlaps(wide(spark, d))


@query("t8_sibling_conflicts", f"""WITH {OUTLINE} SELECT p.doc, p.idx AS parent, p.en - 1 AS st, p.en + 3 AS en FROM node p WHERE p.lvl = 1 AND EXISTS
  (SELECT 1 FROM par c JOIN node k ON k.doc = c.doc AND k.idx = c.idx WHERE c.doc = p.doc AND c.parent = p.idx AND c.parent < c.idx AND k.st <= p.en + 3 AND k.en >= p.en - 1)""")
def t8(spark, d):
    n = nodes_of(spark, d)
    return ol.sibling_conflicts(n.where("lvl = 1").select("doc", F.col("idx").alias("parent"), (F.col("en") - 1).alias("st"), (F.col("en") + 3).alias("en")), n)


@query("t9_stats", f"""WITH {OUTLINE}, k AS (SELECT doc, parent, count(*) AS k FROM par WHERE parent < idx GROUP BY ALL), s AS (SELECT doc, count(*) AS p, sum(k) AS c, max(k) AS m FROM k GROUP BY doc)
  SELECT node.doc, count(*)::BIGINT AS total_nodes, count(*) FILTER (lvl = 0)::BIGINT AS l0, count(*) FILTER (lvl = 1)::BIGINT AS l1, count(*) FILTER (lvl = 2)::BIGINT AS l2,
  coalesce(any_value(p), 0)::BIGINT AS nodes_with_children, coalesce(any_value(c), 0)::BIGINT AS total_children, coalesce(any_value(m), 0)::BIGINT AS max_children FROM node LEFT JOIN s USING (doc) GROUP BY node.doc""")
def t9(spark, d):
    s = ol.stats(nodes_of(spark, d))
    return s.select("doc", "total_nodes", *[F.col("by_level")[i].alias(f"l{i}") for i in range(3)], "nodes_with_children", "total_children", "max_children")


@query("t10_validate", f"""WITH {OUTLINE}, {_WIDE}, o AS (SELECT a.doc, count(*) AS w FROM wide a JOIN wide b ON a.doc = b.doc AND a.lvl = b.lvl AND a.idx < b.idx
  AND (a.st BETWEEN b.st AND b.en OR a.en BETWEEN b.st AND b.en) GROUP BY a.doc) SELECT doc, true AS is_valid, 0::BIGINT AS n_errors, coalesce(w, 0)::BIGINT AS n_warnings FROM n LEFT JOIN o USING (doc)""")
def t10(spark, d):
    return ol.validate(wide(spark, d))


@query("t11_level_cap", f"WITH {OUTLINE} SELECT doc, idx, lvl FROM node WHERE lvl < 2")
def t11(spark, d):
    return ol.cap_levels(nodes_of(spark, d), 2).select("doc", "idx", "lvl")


@query("t12_listing", f"WITH {OUTLINE} SELECT doc, idx AS ord, repeat('  ', lvl) || caption AS line FROM node")
def t12(spark, d):
    return ol.listing(nodes_of(spark, d))


@query("t13_header", f"WITH {OUTLINE} SELECT doc, idx, lang, source FROM node JOIN documents ON doc_id = doc")
def t13(spark, d):
    h = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang", "source")
    return ol.with_header(nodes_of(spark, d).select("doc", "idx"), h)


_LEVELS = """c AS (SELECT conv_id AS doc, turn AS idx, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 + length(text) % 4 END AS lvl, '$' || role || turn AS caption FROM conversations),
par AS (SELECT doc, idx, lvl, caption, (SELECT max(p.idx) FROM c p WHERE p.doc = c.doc AND p.idx < c.idx AND p.lvl < c.lvl) AS parent,
  coalesce((SELECT min(p.idx) - 1 FROM c p WHERE p.doc = c.doc AND p.idx > c.idx AND p.lvl <= c.lvl), (SELECT max(p.idx) FROM c p WHERE p.doc = c.doc)) AS en FROM c)"""


def levels(spark, d):
    """Conversations as headings: the level from role and length, in order of turns."""
    c = table(spark, d, "conversations")
    lvl = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3 + F.length("text") % 4)
    return c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), lvl.alias("lvl"), F.concat(F.lit("$"), "role", F.col("turn").cast("string")).alias("caption"))


@query("x2_heading_outline", f"""WITH RECURSIVE {_LEVELS}, down AS (SELECT doc, idx, 0 AS lvl, replace(caption, '$', '') AS path FROM par WHERE parent IS NULL
  UNION ALL SELECT p.doc, p.idx, down.lvl + 1, down.path || '->' || replace(p.caption, '$', '') FROM down JOIN par p ON p.doc = down.doc AND p.parent = down.idx)
  SELECT par.doc, par.idx::INT AS idx, par.en::INT AS en, down.lvl, par.lvl::INT AS level, parent::INT AS parent, path FROM par JOIN down ON down.doc = par.doc AND down.idx = par.idx""")
def x2(spark, d):
    return hd.heading_outline(levels(spark, d)).select("doc", "idx", "en", "lvl", "level", "parent", "path")


@query("x2_heading_ancestors", f"""WITH RECURSIVE {_LEVELS}, up AS (SELECT doc, idx, parent AS anc_idx FROM par WHERE parent IS NOT NULL
  UNION ALL SELECT up.doc, up.idx, par.parent FROM up JOIN par ON par.doc = up.doc AND par.idx = up.anc_idx WHERE par.parent IS NOT NULL),
  depth AS (SELECT doc, idx, count(*) AS n FROM up GROUP BY ALL) SELECT up.doc, up.idx::INT AS idx, anc_idx::INT AS anc_idx, coalesce(n, 0)::INT AS anc_lvl
  FROM up LEFT JOIN depth ON depth.doc = up.doc AND depth.idx = up.anc_idx""")
def x2_t4(spark, d):
    """The outline's own operator on outlines from headings."""
    return ol.ancestors(hd.heading_outline(levels(spark, d)).select("doc", "idx", "st", "en", "lvl", "caption"))


# --- chunks --------------------------------------------------------------------------------------------------------

_WORDS = "w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)"


@query("c1_word_windows", f"""WITH {_WORDS} SELECT doc_id, i::INT AS chunk_index, md5(array_to_string(w[i * 462 + 1 : i * 462 + 512], ' ')) AS content_md5
  FROM (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 512 THEN 1 ELSE ceil((len(w) - 512) / 462.0)::INT + 1 END)) AS i FROM w WHERE len(w) > 0)""")
def c1(spark, d):
    return ch.word_windows(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("c2_c4_token_windows")
def c2(spark, d):
    out = ch.token_windows(table(spark, d, "documents").select("doc_id", "text"), "text", most=256, overlap=25, keep=["doc_id"])
    return out.select("doc_id", "chunk_index", "token_count", "start_token", "end_token", "total_chunks", F.md5("content").alias("content_md5"))


@query("c5_plain_windows")
def c5(spark, d):
    out = ch.plain_windows(table(spark, d, "documents").select("doc_id", "text"), "text", most=256, overlap=25, keep=["doc_id"])
    return out.select("doc_id", "chunk_index", "token_count", "start_token", "end_token", F.md5("content").alias("content_md5"))


def _sections(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("uri"), F.lit(0).alias("section_index"), F.col("source").alias("article"), F.col("text").alias("content"))


_STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_PACKED = f"""WITH RECURSIVE p AS (SELECT uri, row_number() OVER (PARTITION BY uri ORDER BY j) AS i, p FROM (SELECT doc_id AS uri, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS j,
  {_STRIP.format("unnest(string_split(text, chr(10)))")} AS p FROM documents) WHERE p <> ''),
g AS (SELECT uri, i, length(p) AS held, 1 AS g, length(p) > 512 AS long FROM p WHERE i = 1
  UNION ALL SELECT p.uri, p.i, CASE WHEN g.long OR length(p) > 512 OR g.held + 1 + length(p) > 512 THEN length(p) ELSE g.held + 1 + length(p) END,
  g.g + CASE WHEN g.long OR length(p) > 512 OR g.held + 1 + length(p) > 512 THEN 1 ELSE 0 END, length(p) > 512 FROM g JOIN p ON p.uri = g.uri AND p.i = g.i + 1),
w AS (SELECT uri, g, p, 0 AS a, 0 AS b, 0 AS n FROM g JOIN p USING (uri, i) WHERE long
  UNION ALL SELECT uri, g, p, b, CASE WHEN b + 512 >= length(p) THEN length(p) ELSE b + 512 + coalesce(nullif(length(regexp_extract(substr(p, b + 513), '(?s)^[^.!?]*[.!?]')), 0), 0) END, n + 1 FROM w WHERE b < length(p)),
c AS (SELECT uri, g, 0 AS n, string_agg(p, chr(10) ORDER BY i) AS content, false AS is_overlap FROM g JOIN p USING (uri, i) WHERE NOT long GROUP BY uri, g
  UNION ALL SELECT uri, g, n, {_STRIP.format("substr(p, a + 1, b - a)")}, a > 0 FROM w WHERE n > 0)
SELECT uri, (row_number() OVER (PARTITION BY uri ORDER BY g, n) - 1)::INT AS chunk_index, count(*) OVER (PARTITION BY uri) AS total_chunks, length(content)::INT AS char_count, is_overlap, md5(content) AS content_md5 FROM c WHERE content <> ''"""


@query("c6_c10_paragraph_packing", _PACKED)
def c6(spark, d):
    out = ch.chunk_sections(_sections(spark, d), size=512, overlap=0, separator="\n")
    return out.select("uri", "chunk_index", "total_chunks", "char_count", "is_overlap", F.md5("content").alias("content_md5"))


@query("c7_overlap_packing")
def c7(spark, d):
    out = ch.chunk_sections(_sections(spark, d), size=512, overlap=50, separator="\n")
    return out.select("uri", "chunk_index", "total_chunks", "char_count", "is_overlap", F.md5("content").alias("content_md5"))


@query("c8_c9_char_windows")
def c9(spark, d):
    return ch.chunk_sections(_sections(spark, d), by_paragraphs=False).select("uri", "chunk_index", "total_chunks", "char_count", "is_overlap", F.md5("content").alias("content_md5"))


@query("c10_numbering", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, count(*) OVER (PARTITION BY conv_id) AS total_chunks FROM conversations")
def c10(spark, d):
    return ch.numbered(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("c11_c13_semantic_chunks")
def c11(spark, d):
    kind = F.when(F.col("role") == "user", "Header").when(F.col("role") == "system", "Title").otherwise("Citation")
    s = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").alias("section_index"), F.lit("").alias("heading"), F.coalesce("text", F.lit("")).alias("content"), kind.alias("section_type"))
    return ch.semantic_chunks(s, most=256, overlap=16).select("doc", "chunk_index", "total_chunks", "token_count", F.array_join("tags", ",").alias("tags"), F.md5("content").alias("content_md5"))


@query("c14_assembly", f"""WITH RECURSIVE {OUTLINE}, down AS (SELECT doc, idx, replace(caption, '$', '') AS path FROM par WHERE parent IS NULL
  UNION ALL SELECT c.doc, c.idx, down.path || '->' || replace(c.caption, '$', '') FROM down JOIN par c ON c.doc = down.doc AND c.parent = down.idx),
  line AS (SELECT node.doc, node.idx, list_filter(string_split_regex(string_split(text, chr(10))[st + 1], '\\s+'), lambda x: x <> '') AS w FROM node JOIN documents ON doc_id = node.doc WHERE lvl = 2)
  SELECT doc, idx, path, source, i::INT AS chunk_index, md5(array_to_string(w[i * 18 + 1 : i * 18 + 20], ' ')) AS content_md5 FROM
  (SELECT l.doc, l.idx, path, source, w, unnest(range(0, CASE WHEN len(w) <= 20 THEN 1 ELSE ceil((len(w) - 20) / 18.0)::INT + 1 END)) AS i
   FROM line l JOIN down ON down.doc = l.doc AND down.idx = l.idx JOIN documents ON doc_id = l.doc WHERE len(w) > 0)""")
def c14(spark, d):
    docs, n = table(spark, d, "documents"), nodes_of(spark, d)
    lines = docs.where("text is not null").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("st", "line"))
    nodes = n.join(lines.select("doc", "st", F.col("line").alias("text")).withColumn("lvl", F.lit(2)), ["doc", "st", "lvl"], "left")
    headers = docs.select(F.col("doc_id").alias("doc"), "source")
    out = jobs.assemble_chunks(nodes, headers, lambda rows: ch.word_windows(rows, "text", 20, 2))
    return out.select("doc", "idx", "path", "source", "chunk_index", F.md5("content").alias("content_md5"))


@query("c15_embedding_text", """SELECT doc_id, md5((CASE WHEN doc_id % 3 = 0 THEN 'Документ: ' || lang || ' ' || source || chr(10) ELSE '' END) ||
  (CASE WHEN doc_id % 2 = 0 THEN 'Статья: ' || source || chr(10) ELSE '' END) || text) AS h FROM documents""")
def c15(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", F.md5(tx.embedding_text(t, F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("text"))).alias("h"))


@query("c16_c17_previews", """SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS preview, substr(text, 11, 20) AS part, length(text)::BIGINT AS char_count,
  len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::BIGINT AS word_count FROM documents""")
def c16(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.preview(t, 50).alias("preview"), tx.char_slice(t, 10, 30).alias("part"), F.length(t).cast("long").alias("char_count"), F.size(tx.words(t)).cast("long").alias("word_count"))


# --- vectors -------------------------------------------------------------------------------------------------------


@query("e1_encode")
def e1(spark, d):
    return ve.encode(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.round("v", 4))


@query("e2_masked_mean", """WITH f AS (SELECT label, vec_id % 4 <> 0 AS m, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
  a AS (SELECT label, pos, sum(CASE WHEN m THEN v ELSE 0 END) / sum(CASE WHEN m THEN 1 ELSE 0 END) AS v FROM f GROUP BY ALL),
  z AS (SELECT label, sqrt(sum(v * v)) AS n FROM a GROUP BY label) SELECT label, (pos - 1)::INT AS pos, round(v / n, 5) AS v FROM a JOIN z USING (label)""")
def e2(spark, d):
    e = table(spark, d, "embeddings").select("label", "embedding", (F.col("vec_id") % 4 != 0).cast("int").alias("mask"))
    return ve.masked_mean(e, "label").select("label", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.round("v", 5))


@query("e3_normalize", """SELECT vec_id, round(e[1] / n, 5) AS first, round(sqrt(list_dot_product(list_transform(e, lambda x: x / n), list_transform(e, lambda x: x / n))), 5) AS norm
  FROM (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: 3 * x::DOUBLE) AS e FROM embeddings))""")
def e3(spark, d):
    v = vm.l2_normalize(F.transform(vm.doubles(F.col("embedding")), lambda x: 3 * x))
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.col("v")[0], 5).alias("first"), F.round(vm.norm(F.col("v")), 5).alias("norm"))


@query("e4_average", """SELECT label, (pos - 1)::INT AS pos, round(avg(v), 5) AS v FROM (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL""")
def e4(spark, d):
    return ve.average_vectors(table(spark, d, "embeddings"), "label").select("label", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.round("v", 5))


@query("e5_encode_long")
def e5(spark, d):
    return ve.encode_long(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.round("v", 4))


@query("e6_instruction", """SELECT conv_id, turn, md5((CASE WHEN contains(text, '?') OR contains(text, 'как') OR contains(text, 'почему') THEN 'Represent this question for searching relevant passages: '
  ELSE 'Represent this document for retrieval: ' END) || text) AS h FROM conversations""")
def e6(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(tx.with_instruction(F.col("text"))).alias("h"))


@query("e7_rerank_wrap", "SELECT item_id, CASE WHEN contains(t, '[CLS]') THEN t ELSE '[CLS]' || t || '[SEP]' END AS t FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '[CLS]' || text ELSE text END AS t FROM benchmark)")
def e7(spark, d):
    t = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("[CLS]"), "text")).otherwise(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", tx.rerank_wrap(t).alias("t"))


@query("e8_first_token", "SELECT label, round(arg_min(embedding[1], vec_id)::DOUBLE, 5) AS first FROM embeddings GROUP BY label")
def e8(spark, d):
    g = ve.first_token(table(spark, d, "embeddings"), "label", "vec_id")
    return g.select("label", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("e9_truncate", f"WITH {_WORDS} SELECT doc_id, md5(array_to_string(w[1:128], ' ')) AS h FROM w")
def e9(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(ve.truncated(tx.words(F.col("text")), 128), " ")).alias("h"))


@query("e10_similar_pairs", """SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
  / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, i, j LIMIT 5""")
def e10(spark, d):
    return se.similar_pairs(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")).withColumn("score", F.round("score", 5))


# --- search --------------------------------------------------------------------------------------------------------


def points(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    t = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return e.join(t, "vec_id", "left").select(F.col("vec_id").alias("id"), "embedding", "label", F.coalesce("text", F.lit("")).alias("text"), F.expr("vec_id div 5").alias("document_uri"), (F.col("vec_id") % 5).alias("chunk_index"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _knn_sql(score: str, order: str, where: str = "true", digits: int = 4) -> str:
    return f"""SELECT query_id, rank::INT AS rank, id, round(s, {digits}) AS score FROM (SELECT q.vec_id AS query_id, p.vec_id AS id, {score} AS s,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} {order}, p.vec_id) AS rank FROM embeddings q JOIN embeddings p ON q.vec_id % 20 = 0 AND {where}) WHERE rank <= 10"""


_P, _QV = "p.embedding::DOUBLE[]", "q.embedding::DOUBLE[]"
_COS = f"list_dot_product({_QV}, {_P}) / sqrt(list_dot_product({_QV}, {_QV})) / sqrt(list_dot_product({_P}, {_P}))"


def _knn(metric, where=None):
    return lambda spark, d: se.knn(_vectors(spark, d), _queries(spark, d), 10, metric, where and F.expr(where)).withColumn("score", F.round("score", 4))


query("v1_semantic_search", _knn_sql(_COS, "DESC", "p.label < 3"))(_knn("cosine", "label < 3"))
query("v2_dot", _knn_sql(f"list_dot_product({_QV}, {_P})", "DESC"))(_knn("dot"))
query("v2_euclid", _knn_sql(f"round(list_distance({_QV}, {_P}), 6)", "ASC", digits=6))(
    lambda spark, d: se.ranked(se.knn(_vectors(spark, d), _queries(spark, d), 20, "euclid").select("query_id", "id", F.round("score", 6).alias("score")), 10, False)
)
query("v10_query_batch", _knn_sql(_COS, "DESC"))(_knn("cosine"))


_KW = """kw AS (SELECT item_id AS query_id, unnest(list_filter(list_transform(string_split_regex(text, '\\s+'), lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')),
  lambda w: NOT list_contains(['и', 'в', 'на', 'с', 'по', 'для', 'что', 'это'], lower(w)) AND strlen(w) > 2)) AS kw FROM benchmark)"""


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("v3_keywords", f"WITH {_KW} SELECT query_id, kw, count(*)::BIGINT AS n FROM kw GROUP BY ALL")
def v3(spark, d):
    return se.keyword_rows(_asked(spark, d)).groupBy("query_id", "kw").agg(F.count("*").alias("n"))


def _pages(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.coalesce("html", F.lit("")).alias("text"))


@query("v4_keyword_search", f"""WITH {_KW}, t AS (SELECT query_id, count(*) AS n FROM kw GROUP BY ALL), h AS (SELECT query_id, page_id AS id, count(*) AS m FROM pages JOIN kw ON contains(html, kw) GROUP BY ALL)
  SELECT query_id, rank::INT AS rank, id, round(s, 6) AS score FROM (SELECT query_id, id, m / n AS s, row_number() OVER (PARTITION BY query_id ORDER BY m / n DESC, id) AS rank FROM h JOIN t USING (query_id)) WHERE rank <= 10""")
def v4(spark, d):
    return se.keyword_search(_pages(spark, d), _asked(spark, d), 10).withColumn("score", F.round("score", 6))


@query("v5_hybrid", f"""WITH {_KW}, q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS e FROM benchmark JOIN embeddings ON vec_id = item_id),
  p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, coalesce(text, '') AS text FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
  a AS (SELECT query_id, id, s AS a FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM
    (SELECT query_id, id, list_dot_product(q.e, p.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(p.e, p.e)) AS s FROM q, p)) WHERE r <= 20),
  k AS (SELECT kw.query_id, kw FROM kw JOIN q USING (query_id)), t AS (SELECT query_id, count(*) AS n FROM k GROUP BY ALL),
  h AS (SELECT query_id, id, count(*) AS m FROM p JOIN k ON contains(text, kw) GROUP BY ALL),
  b AS (SELECT query_id, id, m / n AS b FROM h JOIN t USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY m / n DESC, id) <= 20),
  c AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, coalesce(a, 0) * 0.7 + coalesce(b, 0) * 0.3 AS s FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id)
  SELECT query_id, rank::INT AS rank, id, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM c) WHERE rank <= 10""")
def v5(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"), "text").join(table(spark, d, "embeddings"), "vec_id").select(F.col("vec_id").alias("query_id"), "text", "embedding")
    return se.hybrid(points(spark, d), q, 10).withColumn("score", F.round("score", 4))


@query("v5_combine", """WITH a AS (SELECT label AS query_id, vec_id AS id, round(embedding[1]::DOUBLE, 4) AS score FROM embeddings WHERE vec_id % 2 = 0),
  b AS (SELECT label AS query_id, vec_id AS id, round(embedding[2]::DOUBLE, 4) AS score FROM embeddings WHERE vec_id % 3 = 0),
  c AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, coalesce(a.score, 0) * 0.7 + coalesce(b.score, 0) * 0.3 AS s FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id)
  SELECT query_id, rank::INT AS rank, id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM c) WHERE rank <= 10""")
def v5c(spark, d):
    e = table(spark, d, "embeddings")
    part = lambda k, i: e.where(F.col("vec_id") % k == 0).select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"), F.round(F.col("embedding")[i].cast("double"), 4).alias("score"))
    return se.combine(part(2, 0), part(3, 1), 0.7, 0.3, 10).withColumn("score", F.round("score", 6))


@query("v6_document_chunks", "SELECT vec_id AS id, vec_id // 5 AS document_uri, vec_id % 5 AS chunk_index FROM embeddings WHERE (vec_id // 5) IN (SELECT DISTINCT vec_id // 5 FROM embeddings WHERE label = 1)")
def v6(spark, d):
    p = points(spark, d)
    return se.document_chunks(p, p.where("label = 1").select("document_uri").distinct()).select("id", "document_uri", "chunk_index")


@query("v7_upsert", "SELECT vec_id AS id, CASE WHEN label = 2 THEN 'new' ELSE 'old' END AS version FROM embeddings WHERE label <= 4 OR label = 2")
def v7(spark, d):
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return se.upsert(p.where("label <= 4").select("id", F.lit("old").alias("version")), p.where("label = 2").select("id", F.lit("new").alias("version")))


_GONE = "(SELECT DISTINCT vec_id // 5 FROM embeddings WHERE label = 3)"


@query("v8_delete", f"SELECT vec_id AS id, vec_id // 5 AS document_uri FROM embeddings WHERE (vec_id // 5) NOT IN {_GONE}")
def v8(spark, d):
    p = points(spark, d)
    return se.delete_documents(p, p.where("label = 3").select("document_uri").distinct())[0].select("id", "document_uri")


@query("v8_deleted_counts", f"SELECT vec_id // 5 AS document_uri, count(*)::BIGINT AS deleted FROM embeddings WHERE (vec_id // 5) IN {_GONE} GROUP BY ALL")
def v8c(spark, d):
    p = points(spark, d)
    return se.delete_documents(p, p.where("label = 3").select("document_uri").distinct())[1]


@query("v9_s7_points", "SELECT sha256((vec_id // 5)::VARCHAR || chr(1) || (vec_id % 5)::VARCHAR) AS id, coalesce(text, '') AS embedding_text FROM embeddings LEFT JOIN documents ON doc_id = vec_id")
def v9(spark, d):
    p = points(spark, d).drop("id").withColumn("embedding_text", F.when(F.col("text") != "", F.col("text")))
    return se.to_points(p).select("id", "embedding_text")


@query("s9_records", """SELECT doc_id, lang, source, n_chars FROM documents""")
def s9(spark, d):
    one = F.to_json(F.struct("doc_id", "lang", "source", "n_chars"))
    back = F.from_json("j", "doc_id bigint, lang string, source string, n_chars bigint")
    return table(spark, d, "documents").select(one.alias("j")).select(back.alias("r")).select("r.*")


@query("job_section_chunks")
def job_sections(spark, d):
    """Pages to sections to semantic chunks with what the page says of itself."""
    out = jobs.page_section_chunks(table(spark, d, "pages").select(F.col("page_id").alias("doc"), "html"), most=256, overlap=16)
    return out.select("doc", "chunk_index", "total_chunks", "token_count", F.md5("content").alias("content_md5"), F.to_json("meta").alias("meta"))


def _line_pages(spark, d):
    """Documents' lines as pages with numbered paragraphs, the contents of these, and their headers."""
    docs, n = table(spark, d, "documents").where("text is not null"), nodes_of(spark, d).where("lvl < 2")
    line = lambda x, i: F.concat(F.lit('<p id="p'), i.cast("string"), F.lit('">'), F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>"))
    pages = docs.select(F.col("doc_id").alias("doc"), F.array_join(F.transform(F.split("text", "\n"), line), "").alias("html"))
    at = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    contents = n.select("doc", F.col("lvl").alias("pos"), at("st").alias("np"), at("en").alias("npe"), "caption", F.lit("u").alias("unit"), "lvl")
    return pages, contents, docs.select(F.col("doc_id").alias("doc"), "source")


@query("job_outline_chunks")
def job_outline(spark, d):
    """Documents' lines as pages with contents, through the whole outline job."""
    pages, contents, headers = _line_pages(spark, d)
    out = jobs.page_outline_chunks(pages, contents, headers, most=64, overlap=6)
    return out.select("doc", "idx", "path", "source", "chunk_index", "total_chunks", F.md5("content").alias("content_md5"))


@query("job_outline_rejects", f"""WITH {OUTLINE}, bad AS (SELECT doc, arg_min(st, lvl * 1000000 + st) AS st FROM node WHERE lvl < 2 AND doc % 7 = 3 AND lvl = 1 AND st % 20 = 0 GROUP BY doc),
  toc AS (SELECT doc, st, arg_max(en, lvl) AS en, max(lvl) AS lvl FROM node WHERE lvl < 2 AND doc NOT IN (SELECT doc FROM bad) GROUP BY doc, st),
  line AS (SELECT b.doc, b.st, coalesce(t.en, b.st) AS en, coalesce(t.lvl, coalesce(last_value(t.lvl IGNORE NULLS) OVER (PARTITION BY b.doc ORDER BY b.st ROWS UNBOUNDED PRECEDING), 0) + 1) AS lvl
    FROM node b LEFT JOIN toc t ON t.doc = b.doc AND t.st = b.st WHERE b.lvl = 2 AND b.doc NOT IN (SELECT doc FROM bad))
  SELECT doc, 'unreadable contents row' AS reason, 'p' || st || ':' AS detail FROM bad UNION ALL SELECT doc, 'level too deep', st || ':' || en || ':' || lvl FROM line WHERE lvl >= 2""")
def job_rejects(spark, d):
    """What the outline job leaves out, where some contents rows have no end and no more than two levels are wanted."""
    pages, contents, _ = _line_pages(spark, d)
    broken = (F.col("doc") % 7 == 3) & (F.col("lvl") == 1) & (F.regexp_replace("np", "p", "").cast("int") % 20 == 0)
    contents = contents.withColumn("npe", F.when(~broken, F.col("npe"))).withColumn("pos", F.col("lvl") * 1000000 + F.regexp_replace("np", "p", "").cast("int"))
    return jobs.outline_rejects(hr.html_rows(pages, "doc", "html"), contents, 2)


@query("job_section_points")
def job_points(spark, d):
    """Documents as sections, packed, led by title and article, encoded and numbered."""
    s = _sections(spark, d).withColumn("title", F.array("article"))
    out = jobs.section_points(s, separator="\n")
    return out.select("id", "document_uri", "chunk_index", F.md5("embedding_text").alias("text_md5"), F.size("embedding").alias("dim"))


@query("flagship_chunk_search")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents to word windows, numbered, encoded, searched by a batch of questions within one language."""
    docs = table(spark, d, "documents").where("lang = 'en'").select("doc_id", "text")
    chunks = ch.numbered(ch.word_windows(docs, "text", 128, 16).drop("text"), "doc_id", "chunk_index")
    pts = ve.encode(chunks, "content").select(F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), "embedding")
    q = ve.encode(_asked(spark, d), "text").select("query_id", "embedding")
    return se.knn(pts.where(vm.norm(F.col("embedding")) > 0), q.where(vm.norm(F.col("embedding")) > 0), 5, "cosine").withColumn("score", F.round("score", 4))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
