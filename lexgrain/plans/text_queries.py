"""Text functions over pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import crawl
from ..functions.words import FILLERS, FINITE, MONTHS, STOP_WORDS
from .registry import LINES, S, query, span_text, spread, squash, table, tidy, trim


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("seq", "line"))
    return docs.where("line <> ''")


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_STRIPPED = trim(tidy(squash("replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&sect;', '§'), '&nbsp;', ' '), '&amp;', '&')")))


@query(f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, {_STRIPPED} AS t FROM pages)")
def tx01_canonical_text(spark, sf_dir):
    t = T.strip_markup(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


_DECODED = "replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<(?:br|hr)\\b[^>]*>', chr(10), 'g'), '(?i)</(?:p|div|li|h[1-6]|section|article|tr|td|th)>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '\"'), chr(13), '')"


@query(
    f"""SELECT page_id, seq, md5(line) AS digest FROM (
      SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS seq FROM (
        SELECT page_id, list_filter(list_transform(string_split({_DECODED}, chr(10)), lambda x: {trim(squash('x'))}), lambda x: x <> '') AS ls FROM pages))"""
)
def tx02_page_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.page_lines(F.col("html"))).alias("seq", "line"))
    return rows.select("page_id", F.col("seq").cast("long").alias("seq"), F.md5(F.col("line").cast("binary")).alias("digest"))


@query("SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<title>.*?</title>') THEN regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1) END AS title FROM pages")
def tx04_first_tag(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.first_tag(F.col("html"), "title").alias("title"))


@query(f"SELECT doc_id, seq, schluessel FROM (SELECT doc_id, seq, {trim(squash('''regexp_replace(regexp_replace(regexp_replace(lower(line), '§+S*\\d+[a-z]?(?:S*(?:abs(?:atz|\\.)|satz|nummer|nr\\.|buchst(?:abe|\\.))S*\\d+[a-z]?)*', '§', 'g'), '\\b\\d[\\d.,]*\\b', '#', 'g'), '[„\"»«(),;:.]', ' ', 'g')''')).replace('S*', S + '*')} AS schluessel FROM ({LINES})) WHERE len(string_split(schluessel, ' ')) BETWEEN 2 AND 8")
def tx12_phrase_keys(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), T.phrase_key(F.col("line")).alias("schluessel"))
    return T.settled(rows, "schluessel").where("schluessel is not null")


@query(f"SELECT doc_id, seq, md5({span_text('line')}) AS digest FROM ({LINES})")
def tx13_span_text(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), F.md5(T.span_text(F.col("line")).cast("binary")).alias("digest"))


_CLEAN = trim(
    "regexp_replace(regexp_replace(regexp_replace("
    + trim(f"regexp_replace(regexp_replace({squash('line')}, ',{S}*,+', ',', 'g'), '{S}+([,;.])', '\\1', 'g')")
    + f", '\\A[,;:]{S}*', ''), '[.,;:]\\z', ''), '(?i)[,;]?{S}+(?:wenn|soweit|sofern|falls|und|oder|sowie|dass)\\z', '')"
)


@query(f"SELECT doc_id, seq, md5({_CLEAN}) AS digest FROM ({LINES})")
def tx14_clean_span(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), F.md5(T.clean_span(F.col("line")).cast("binary")).alias("digest"))


_MEANS = f"list_filter(regexp_extract_all(lower(line), '[a-zäöüß]{{4,}}'), lambda w: NOT list_contains({_list([*FINITE, *FILLERS])}, w))"


@query(
    f"""SELECT doc_id, seq, length(line) >= 4 AND len({_MEANS}) > 0
      AND NOT (len(ws) = 1 AND list_contains({_list(FINITE)}, lower(ws[1]))) AS gehaltvoll
    FROM (SELECT *, list_filter(regexp_split_to_array(line, '{S}+'), lambda w: w <> '') AS ws FROM ({LINES}))"""
)
def tx15_has_content(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), T.has_content(F.col("line")).alias("gehaltvoll"))


@query(
    f"""SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE {trim("CASE WHEN ende - 1 > 200 THEN substr(kopf, 1, ende) ELSE kopf END")} || ' […]' END AS kurz
    FROM (SELECT doc_id, text, kopf, greatest(CASE WHEN p1 > 0 THEN 400 - p1 ELSE 0 END, CASE WHEN p2 > 0 THEN 400 - p2 ELSE 0 END) AS ende FROM (
      SELECT doc_id, text, substr(text, 1, 400) AS kopf, strpos(reverse(substr(text, 1, 400)), ' .') AS p1, strpos(reverse(substr(text, 1, 400)), ' ;') AS p2 FROM documents))"""
)
def tx16_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 400).alias("kurz"))


def _tokens(c: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-zäöüß0-9]{{3,}}')), lambda w: NOT list_contains({_list(STOP_WORDS)}, w))"


@query(
    f"""WITH t AS (SELECT d.doc_id, {_tokens('d.text')} AS a, {_tokens('l.text')} AS b FROM documents d JOIN documents l ON l.doc_id = d.doc_id + 1)
    SELECT doc_id, len(a) AS n_tokens, CASE WHEN least(len(a), len(b)) > 0 THEN round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) ELSE 0.0 END AS deckung FROM t"""
)
def tx17_set03_token_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("a"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return docs.join(other, "doc_id").select("doc_id", F.size("a").cast("long").alias("n_tokens"), F.round(T.overlap(F.col("a"), F.col("b")), 6).alias("deckung"))


@query("SELECT page_id, seq, href, md5(label) AS digest FROM (SELECT page_id, generate_subscripts(h, 1) - 1 AS seq, unnest(h) AS href, unnest(l) AS label FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a href=\"([^\"]*)\"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a href=\"([^\"]*)\"[^>]*>(.*?)</a>', 2) AS l FROM pages))")
def tx20_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.links(F.col("html"))).alias("seq", "x"))
    return rows.select("page_id", F.col("seq").cast("long").alias("seq"), F.col("x.href").alias("href"), F.md5(F.col("x.label").cast("binary")).alias("digest"))


@query("SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?is)<nav.*?</nav>', '', 'g')) AS n_chars FROM pages")
def tx24_boilerplate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(T.drop_boilerplate(F.col("html"))).cast("long").alias("n_chars"))


TIME = f"(?i)\\b\\d{{1,2}}\\.{S}?(?:{'|'.join(MONTHS)}){S}?\\d{{4}}\\b|\\bVeranlagungszeitraum{S}?\\d{{4}}\\b|\\bab{S}?\\d{{4}}\\b|\\bBGBl\\.|\\bBStBl\\."


@query(
    f"""SELECT event_id, regexp_matches(t, '{TIME}') AND length(regexp_replace(regexp_replace(t, '{TIME}', ''), '[^A-Za-z0-9_äöüßÄÖÜ]', '', 'g')) < 12 AS nur_zeit
    FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ab 20' || (10 + event_id % 20) WHEN 1 THEN event_type || ' im Veranlagungszeitraum 2023' WHEN 2 THEN (1 + event_id % 28) || '. Dezember 2024, ' || event_type ELSE event_type END AS t FROM events)"""
)
def tx26_time_only(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.expr("CASE event_id % 4 WHEN 0 THEN 'ab 20' || (10 + event_id % 20) WHEN 1 THEN event_type || ' im Veranlagungszeitraum 2023' WHEN 2 THEN (1 + event_id % 28) || '. Dezember 2024, ' || event_type ELSE event_type END")
    return e.select("event_id", T.time_only(t).alias("nur_zeit"))


@query("SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), ' ')) AS text_hash FROM documents")
def tx27_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.filter(F.split("text", "\n", -1), lambda x: x != "")).alias("text_hash"))


@query("SELECT o_orderkey, concat_ws(' · ', nullif(o_orderstatus, ''), CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, strftime(o_orderdate, '%Y-%m-%d')) AS fundstelle, strftime(o_orderdate, '%Y-%m-%d') AS datum FROM orders")
def tx29_tx30_citation_label(spark, sf_dir):
    date = T.iso_date(F.date_format("o_orderdate", "yyyyMMdd"))
    label = T.citation(F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).otherwise(""), T.iso_date(F.col("o_orderdate").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("fundstelle"), date.alias("datum"))


@query("SELECT event_id, CASE WHEN (value::DECIMAL(20,2) * 5) % 10 = 5 THEN (floor(value * 500) + CASE WHEN above >= 0 THEN 1 ELSE 0 END) / 1000.0 ELSE (floor(value / 2 * 1000) + CASE WHEN above >= 0 THEN 1 ELSE 0 END) / 1000.0 END AS gerundet FROM (SELECT event_id, value, (high * 2000 - (floor(value / 2 * 1000) * 2 + 1)) + (value / 2 - high) * 2000 AS above FROM (SELECT event_id, value, (value / 2 * 134217729.0::DOUBLE) - ((value / 2 * 134217729.0::DOUBLE) - value / 2) AS high FROM events))")
def tx31_fixed3(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.fixed3(F.col("value") / 2).alias("gerundet"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM pages")
def tx32_escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escape_html(F.col("html")).cast("binary")).alias("digest"))


@query(
    f"""SELECT doc_id, seq, round(greatest(0.0, least(1.0, 1.0 - (CASE WHEN n < 3 THEN 0.25 ELSE 0 END) - (CASE WHEN n > 30 THEN 0.2 ELSE 0 END)
      - (CASE WHEN contains(line, ';') THEN 0.1 ELSE 0 END) - (CASE WHEN regexp_matches(line, '(?is)\\bund\\b.*\\boder\\b') THEN 0.1 ELSE 0 END))), 6) AS guete
    FROM (SELECT *, len(regexp_split_to_array({trim('line')}, '{S}+')) AS n FROM ({LINES}))"""
)
def mrg05_span_quality(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), F.round(T.quality(F.col("line")), 6).alias("guete"))


_OWN = "url || CASE page_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '/inhalt/' WHEN 2 THEN '.HTML?x=1#y' ELSE '/x.htm' END"


@query(f"SELECT page_id, starts_with(u, 'https://m') AND regexp_matches(regexp_extract(u, '^[a-z]+://[^/]+([^?#]*)', 1), '(?i)\\.html\\z|/inhalt/?\\z') AS intern FROM (SELECT page_id, {_OWN} AS u FROM pages)")
def flt05_internal_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", crawl.is_internal(F.expr(_OWN), ["https://m"]).alias("intern"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(m, '^\\d+$') THEN 'Nr. ' || m WHEN regexp_matches(m, '^[A-Za-z]\\)?$') THEN 'Buchst. ' || regexp_replace(m, '\\)$', '') ELSE m END AS marke, 'Abs. ' || l_linenumber AS absatz FROM (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 3 WHEN 0 THEN l_linenumber::VARCHAR WHEN 1 THEN lower(l_returnflag) || ')' ELSE l_linestatus || l_returnflag END AS m FROM lineitem)")
def tx09_prj02_paths(spark, sf_dir):
    m = F.expr("CASE l_orderkey % 3 WHEN 0 THEN cast(l_linenumber as string) WHEN 1 THEN lower(l_returnflag) || ')' ELSE l_linestatus || l_returnflag END")
    path = F.concat(F.lit("Abs. "), F.col("l_linenumber"), F.lit(" Satz 1 "), T.marker_name(m))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.marker_name(m).alias("marke"), T.absatz(path).alias("absatz"))


@query("SELECT p_partkey, lower(replace(regexp_replace(regexp_replace('§ ' || p_size || ' ' || p_brand, '^§+ *', ''), ' +', '-', 'g'), ' ', '-')) AS norm_id, regexp_replace(lower(p_brand || p_partkey), '[^a-z0-9]', '', 'g') AS kurz FROM part")
def prj01_flt01_ids(spark, sf_dir):
    label = F.concat(F.lit("§ "), F.col("p_size"), F.lit(" "), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.norm_id(label).alias("norm_id"), T.short_key(F.concat("p_brand", "p_partkey")).alias("kurz"))
