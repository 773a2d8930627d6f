"""Queries: facts and links of web pages, site dossiers, text scans."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import web
from leadloom.operators import governance, website
from leadloom.plans.base import derive, query, table, with_parts
from leadloom.plans.evidence import now

# Plain-SQL versions of the text steps, for DuckDB.
DECODED = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"
NO_TAGS = (r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), "
           r"'(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<svg\b[^>]*>.*?</svg>', ' ', 'g'), '<[^>]+>', ' ', 'g')")


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '[\\s\\x{{00a0}}]+', ' ', 'g'))"


VISIBLE = squeeze(DECODED.format(NO_TAGS.format("html")))


def page_frame(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("url", "html")


@query("page_titles", "SELECT url, " + squeeze(DECODED.format(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)")) + """ AS title FROM pages""")
def page_titles(spark, folder):
    return page_frame(spark, folder).select("url", web.page_title(F.col("html")).alias("title"))


@query("page_text", f"SELECT url, md5({VISIBLE}) AS text_hash, length({VISIBLE}) AS text_length FROM pages")
def page_text(spark, folder):
    text = F.coalesce(web.visible_text(F.col("html")), F.lit(""))
    return page_frame(spark, folder).select("url", F.md5(text).alias("text_hash"), F.length(text).alias("text_length"))


EMAIL_SQL = """
SELECT {key}, array_to_string(list_filter(list_transform(mails, lambda m: CASE
    WHEN regexp_matches(lower(m), '^[a-z0-9.!#$%&''*+/=?^_`{{|}}~-]+@[a-z0-9]([a-z0-9.-]*[a-z0-9])?\\.[a-z]{{2,63}}$')
      AND NOT regexp_matches(lower(m), '\\.(css|gif|ico|jpeg|jpg|js|png|svg|webp)$') AND NOT regexp_matches(lower(m), '@[23]x\\.') THEN lower(m) END),
  lambda m: m IS NOT NULL), ' ') AS raw FROM (SELECT {key}, regexp_extract_all({text}, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,63}}') AS mails FROM {source}) WHERE len(mails) > 0
"""
FIRST_SEEN = """
SELECT {key}, string_agg(m, ',' ORDER BY pos) AS emails FROM (
  SELECT {key}, m, min(pos) AS pos FROM (SELECT {key}, unnest(string_split(raw, ' ')) AS m, generate_subscripts(string_split(raw, ' '), 1) AS pos FROM found) WHERE m <> ''
  GROUP BY {key}, m) GROUP BY {key}
"""


@query("page_emails", with_parts(FIRST_SEEN.format(key="url"), found=EMAIL_SQL.format(
    key="url", text=DECODED.format("html"), source="pages")))
def page_emails(spark, folder):
    facts = website.page_facts(page_frame(spark, folder))
    return facts.select("url", "emails").where(F.size("emails") > 0)


@query("doc_contacts", with_parts(FIRST_SEEN.format(key="doc_id"), found=EMAIL_SQL.format(key="doc_id", text="text", source="documents")))
def doc_contacts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", web.emails_of_text(F.col("text")).alias("emails"))
    return docs.where(F.size("emails") > 0)


RULES = {"license": r"\b[Ll]icen[cs]e\b", "address": r"[a-z0-9]+@[a-z0-9.]+", "long-number": r"\d{6,}", "key": r"(?i)\b(?:api|secret|token)\b"}


@query("doc_rule_hits", "SELECT doc_id, rule, hits FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS rule, len(regexp_extract_all(text, '{pattern}')) AS hits FROM documents" for name, pattern in RULES.items())
    + ") WHERE hits > 0")
def doc_rule_hits(spark, folder):
    return governance.rule_hits(table(spark, folder, "documents").select("doc_id", "text"), "text", RULES)


SECRET_TEXT = """
SELECT doc_id, concat(text, CASE doc_id % 40 WHEN 0 THEN concat(' sk-', repeat('a1', 12)) WHEN 1 THEN ' -----BEGIN RSA PRIVATE KEY----- '
  WHEN 2 THEN concat('ghp_', repeat('Z9', 15)) WHEN 3 THEN concat(' AIza', repeat('q_', 13)) ELSE '' END) AS text FROM documents
"""


@query("doc_secrets", with_parts("""
SELECT doc_id, rule, hits FROM (SELECT doc_id, CASE doc_id % 40 WHEN 0 THEN 'service-key' WHEN 1 THEN 'private-key' WHEN 2 THEN 'repository-token'
  WHEN 3 THEN 'cloud-key' END AS rule, len(regexp_extract_all(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{30,}|\\bAIza[0-9A-Za-z_-]{25,}\\b')) AS hits
  FROM seeded) WHERE hits > 0""", seeded=SECRET_TEXT))
def doc_secrets(spark, folder):
    return governance.rule_hits(derive(spark, folder, SECRET_TEXT), "text")


# Words of the pages' own invented languages stand in for the business words.
LINK_RULES = (("the|and", 100, "english"), ("le|de", 90, "french"), ("[0-9]", 80, "numbered"), ("a", 65, "other"))


@query("page_links", with_parts(r"""
SELECT page AS url, target, label, priority, reason, position FROM (
  SELECT *, row_number() OVER (PARTITION BY page ORDER BY priority DESC, encode(target_coded)) AS position FROM (
    SELECT page, target, target_coded, max(priority) AS priority, arg_max(label, (priority, -pos)) AS label, arg_max(reason, (priority, -pos)) AS reason FROM (
      SELECT *, CASE WHEN regexp_matches(hay, '(?i)the|and') THEN 100 WHEN regexp_matches(hay, '(?i)le|de') THEN 90 WHEN regexp_matches(hay, '[0-9]') THEN 80
          WHEN regexp_matches(hay, '(?i)a') THEN 65 END::BIGINT AS priority,
        CASE WHEN regexp_matches(hay, '(?i)the|and') THEN 'english' WHEN regexp_matches(hay, '(?i)le|de') THEN 'french' WHEN regexp_matches(hay, '[0-9]') THEN 'numbered'
          WHEN regexp_matches(hay, '(?i)a') THEN 'other' END AS reason
      FROM (SELECT page, pos, label, origin || path AS target, origin || coded AS target_coded, coded || ' ' || label AS hay FROM (
        SELECT *, replace(replace(url_encode(path), '%2F', '/'), '%2C', ',') AS coded FROM (
        SELECT url AS page, pos, regexp_extract(lower(url), '^https?://[^/?#]+') AS origin, decoded AS path, label, regexp_replace(url, '#.*$', '') AS self FROM links))
        WHERE NOT regexp_matches(coded || ' ' || label, '(?i)blog') AND origin || coded <> self)) WHERE priority IS NOT NULL
    GROUP BY page, target, target_coded)) WHERE position <= 5""",
    anchors=r"""SELECT url, unnest(a) AS anchor, generate_subscripts(a, 1) AS pos FROM (
      SELECT url, regexp_extract_all(html, '(?is)<a\b[^>]*href=["''][^"'']+["''][^>]*>.*?</a>') AS a FROM pages)""",
    links="SELECT url, pos, " + DECODED.format(r"""regexp_extract(anchor, 'href=["'']([^"'']+)', 1)""") + " AS decoded, "
    + squeeze(DECODED.format(r"regexp_replace(regexp_extract(anchor, '(?is)>(.*)</a>', 1), '<[^>]+>', ' ', 'g')")) + " AS label FROM anchors"))
def page_links(spark, folder):
    links = website.priority_links(page_frame(spark, folder), LINK_RULES, "blog", 5)
    return links.withColumn("target", F.coalesce(F.try_url_decode(F.replace("target", F.lit("+"), F.lit("%2B"))), "target"))


HTML_PAGES = """
SELECT s_suppkey, concat('https://s', CAST(s_suppkey AS STRING), '.example/contact') AS url, concat(
  '<html><head><title>', s_name, ' &amp; Co</title>', CASE WHEN s_suppkey % 3 = 0 THEN concat('<script type="application/ld+json">{"@graph":[{"@type":["Thing","Organization"],"name":"',
    s_name, ' Ltd","email":"info@s', CAST(s_suppkey AS STRING), '.example","telephone":"+1 555 ', CAST(s_suppkey AS STRING),
    '","address":{"streetAddress":"Road 1","addressCountry":"N', CAST(s_nationkey AS STRING), '"},"sameAs":"https://wa.me/1555', lpad(CAST(s_suppkey AS STRING), 6, '0'), '"}]}</script>') ELSE '' END,
  '</head><body><a href="mailto:Sales%40s', CAST(s_suppkey AS STRING), '.example?subject=x">Mail</a><img src="/logo@2x.png"><a href="tel:+1-', CAST(s_suppkey AS STRING), '">Call</a>',
  CASE WHEN s_suppkey % 2 = 0 THEN '<p>Our  factory&#58; two lines.</p>' ELSE '<p>Trading only.</p>' END, '</body></html>') AS html FROM supplier
"""


@query("page_facts", with_parts("""
SELECT url, CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' Ltd' ELSE s_name || ' & Co' END AS title,
  'sales@s' || s_suppkey || '.example' || CASE WHEN s_suppkey % 3 = 0 THEN ',info@s' || s_suppkey || '.example' ELSE '' END AS emails,
  '+1-' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN ',+1 555 ' || s_suppkey ELSE '' END AS phones,
  CASE WHEN s_suppkey % 3 = 0 THEN '1555' || lpad(CAST(s_suppkey AS STRING), 6, '0') ELSE '' END AS whatsapp,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Road 1, N' || s_nationkey ELSE '' END AS addresses,
  CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' & Co Mail Call Our factory: two lines.' ELSE '' END AS factory_signals
FROM html_pages JOIN supplier USING (s_suppkey)""", html_pages=HTML_PAGES))
def page_facts(spark, folder):
    return website.page_facts(derive(spark, folder, HTML_PAGES).select("url", "html"))


@query("page_evidence", with_parts("""
SELECT kind, count(*) AS evidence_rows, round(sum(confidence), 2) AS confidence FROM (
  SELECT each_of('company-website', 'organization-name', 'business-email', 'business-phone', 'factory', 'whatsapp', 'business-address', 'second-email', 'second-phone') AS k,
    s_suppkey FROM html_pages) x, LATERAL (SELECT CASE k WHEN 'second-email' THEN 'business-email' WHEN 'second-phone' THEN 'business-phone' ELSE k END AS kind,
    CASE k WHEN 'organization-name' THEN 0.6 WHEN 'factory' THEN 0.55 ELSE 0.65 END::DOUBLE AS confidence)
WHERE CASE WHEN k IN ('whatsapp', 'business-address', 'second-email', 'second-phone') THEN s_suppkey % 3 = 0 WHEN k = 'factory' THEN s_suppkey % 2 = 0 ELSE TRUE END
GROUP BY kind""", html_pages=HTML_PAGES))
def page_evidence(spark, folder):
    facts = website.page_facts(derive(spark, folder, HTML_PAGES).select("url", "html"))
    return website.page_evidence(facts, now()).groupBy("kind").agg(
        F.count(F.lit(1)).alias("evidence_rows"), F.round(F.sum("confidence"), 2).alias("confidence"))


URLS = """
SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN concat('http://10.0.', CAST(page_id % 200 AS STRING), '.1/x') WHEN 2 THEN 'https://user:pw@example.com/'
  WHEN 3 THEN concat('https://example.com:', CAST(8000 + page_id % 100 AS STRING), '/') WHEN 4 THEN 'ftp://example.com/file' WHEN 5 THEN concat('not a url ', CAST(page_id AS STRING))
  WHEN 6 THEN 'https://db.internal/' ELSE concat('HTTPS://Shop', CAST(page_id AS STRING), '.Example:443/a#part') END AS url FROM pages
"""


@query("url_admission", with_parts("""
SELECT page_id, CASE page_id % 8 WHEN 0 THEN regexp_replace(url, '#.*$', '') WHEN 7 THEN 'https://shop' || page_id || '.example/a' END AS admitted,
  CASE page_id % 8 WHEN 1 THEN 'internal-host' WHEN 2 THEN 'credentials' WHEN 3 THEN 'port' WHEN 4 THEN 'scheme' WHEN 5 THEN 'not-a-url' WHEN 6 THEN 'internal-host' END AS refusal
FROM urls""", urls=URLS))
def url_admission(spark, folder):
    return derive(spark, folder, URLS).select("page_id", web.admitted_url("url").alias("admitted"), web.url_refusal("url").alias("refusal"))


# Pages form sites of twenty; the first page of a site links to all others, each of them to one page that does not exist.
SITE_PAGES = """
SELECT page_id, CAST(floor(page_id / 20) AS BIGINT) AS site, concat('https://site', CAST(CAST(floor(page_id / 20) AS BIGINT) AS STRING), '.example/', CAST(page_id % 20 AS STRING)) AS url,
  page_id % 20 = 0 AS is_root, NOT (page_id % 20 IN (3, 4) AND floor(page_id / 20) % 2 = 1) AND NOT (page_id % 20 = 0 AND floor(page_id / 20) % 5 = 4) AS readable FROM pages
"""


def _walk(spark: SparkSession, folder: str) -> DataFrame:
    pages = derive(spark, folder, SITE_PAGES)
    reason = F.element_at(F.array(*[F.lit(r) for r in ("contact", "about", "factory")]), (F.col("page_id") % 3 + 1).cast("int"))
    from_root = pages.where("NOT is_root").select(
        F.concat(F.lit("https://site"), "site", F.lit(".example/0")).alias("url"), F.col("url").alias("target"), reason.alias("reason"),
        (F.col("page_id") % 20).alias("position"))
    onward = pages.where("NOT is_root").select(
        "url", F.concat(F.lit("https://site"), "site", F.lit(".example/extra"), F.col("page_id") % 20).alias("target"), F.lit("legal").alias("reason"),
        F.lit(1).alias("position"))
    return website.walk_sites(pages.where("is_root").select(F.col("url").alias("root")), pages.select("url", "readable"),
                              from_root.unionByName(onward))


@query("site_walks", with_parts("""
, ranked AS (SELECT site, url, readable, page_id, reason, row_number() OVER (PARTITION BY site ORDER BY NOT first_of_reason, page_id) AS turn FROM (
  SELECT *, row_number() OVER (PARTITION BY site, reason ORDER BY page_id) = 1 AS first_of_reason FROM (
    SELECT *, CASE page_id % 3 WHEN 0 THEN 'contact' WHEN 1 THEN 'about' ELSE 'factory' END AS reason FROM site_pages WHERE NOT is_root))),
visits AS (SELECT site, turn, url, reason, readable FROM ranked UNION ALL
  SELECT site, 100 + turn, 'https://site' || site || '.example/extra' || page_id % 20, NULL, FALSE FROM ranked WHERE readable),
visited AS (SELECT *, row_number() OVER (PARTITION BY site, readable ORDER BY turn) AS visit FROM visits)
SELECT r.url AS root, v.url, CASE WHEN v.readable THEN v.reason END AS reason, v.readable, CASE WHEN v.readable THEN v.visit ELSE v.visit - 1 END AS visit
FROM site_pages r JOIN visited v ON v.site = r.site WHERE r.is_root AND r.readable
UNION ALL SELECT url, url, 'root', TRUE, 0 FROM site_pages WHERE is_root AND readable""", site_pages=SITE_PAGES).replace("\n, ranked", ", ranked", 1))
def site_walks(spark, folder):
    return _walk(spark, folder).select("root", "url", F.when(F.col("readable"), F.col("reason")).alias("reason"), "readable", "visit")


@query("site_dossiers", with_parts("""
, ranked AS (SELECT site, page_id, readable, row_number() OVER (PARTITION BY site ORDER BY NOT first_of_reason, page_id) AS visit FROM (
  SELECT *, row_number() OVER (PARTITION BY site, page_id % 3 ORDER BY page_id) = 1 AS first_of_reason FROM site_pages WHERE NOT is_root)),
kept AS (SELECT r.url AS root, v.page_id, v.visit FROM site_pages r JOIN ranked v ON v.site = r.site WHERE r.is_root AND r.readable AND v.readable
  UNION ALL SELECT url, page_id, 0 FROM site_pages WHERE is_root AND readable),
found AS (SELECT page_id, unnest(string_split(raw, ' ')) AS mail, generate_subscripts(string_split(raw, ' '), 1) AS pos FROM mails),
mailed AS (SELECT root, string_agg(mail, ',' ORDER BY seen) AS emails FROM (
  SELECT root, mail, min((visit, pos)) AS seen FROM kept JOIN found USING (page_id) WHERE mail <> '' GROUP BY root, mail) GROUP BY root)
SELECT root, count(*) AS page_count, arg_min(title, visit) FILTER (title IS NOT NULL) AS title, coalesce(any_value(emails), '') AS emails
FROM kept JOIN titles USING (page_id) LEFT JOIN mailed USING (root) GROUP BY root""", site_pages=SITE_PAGES,
    titles="SELECT page_id, nullif(" + squeeze(DECODED.format(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)")) + ", '') AS title FROM pages",
    mails=EMAIL_SQL.format(key="page_id", text=DECODED.format("html"), source="pages")).replace("\n, ranked", ", ranked", 1))
def site_dossiers(spark, folder):
    """All pages of all sites with the facts of their own html."""
    known = derive(spark, folder, SITE_PAGES).select("page_id", F.col("url").alias("site_url"))
    pages = table(spark, folder, "pages").select("page_id", "html").join(known, "page_id").select(F.col("site_url").alias("url"), "html")
    return website.site_dossiers(_walk(spark, folder), website.page_facts(pages)).select("root", "page_count", "title", "emails")
