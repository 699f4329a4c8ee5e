"""Links of pages, answers to texts, fields of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.text_columns import extract_fields, extract_links, map_text
from tablewright.plans.registry import query, table

KEPT = "!#$%&()*+,/:;=?@[]|^"
PATH_SQL = "url_encode(u)"
for _ch in KEPT:
    PATH_SQL = f"replace({PATH_SQL}, '%{ord(_ch):02X}', '{_ch}')"


@query("extract_links", f"""
    with m as (select page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as u from pages)
    select page_id, url, case when starts_with(u, '/') then regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || {PATH_SQL}
                              else u end as link from m""")
def _(spark, folder):
    return extract_links(table(spark, folder, "pages"), "html", 'href="([^"]+)"', base_url="url")


SITE_SQL = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"


# Links that are whole, malformed, from the root, and up some steps.
@query("extract_links_odd", f"""
    select page_id, unnest(['http://[bad/p', 'ftp://x.org/a b', '//[bad/x', {SITE_SQL} || '/root/p?q=1#f', {SITE_SQL} || '/up.html']) as link
    from pages""")
def _(spark, folder):
    odd = F.lit("".join(f'<a href="{u}">' for u in ("http://[bad/p", "ftp://x.org/a b", "//[bad/x", "/root/p?q=1#f", "/a/b/../../up.html")))
    pages = table(spark, folder, "pages").select("page_id", "url", odd.alias("html"))
    return extract_links(pages, "html", 'href="([^"]+)"', base_url="url").select("page_id", "link")


@query("extract_matches", """
    select page_id, url, unnest(regexp_extract_all(html, '<li>(<[^>]+>)?([^<]*)', 2)) as item from pages""")
def _(spark, folder):
    return extract_links(table(spark, folder, "pages"), "html", "<li>(?:<[^>]+>)?([^<]*)", out="item")


def word_counter():
    """Stands in for a model: a function from text to text that needs no network."""
    return lambda text: f" {len(text)} characters "


@query("text_map", "select doc_id, lang, length(text) || ' characters' as text_summary from documents")
def _(spark, folder):
    return map_text(table(spark, folder, "documents").select("doc_id", "lang", "text"), "text", word_counter).drop("text")


def answer_maker():
    return lambda text: '```json\n{"size": "' + str(len(text)) + '", "kind": "document"}\n```'


@query("text_extract", """
    select doc_id, cast(length(text) as varchar) as size, 'document' as kind, '' as absent from documents""")
def _(spark, folder):
    texts = table(spark, folder, "documents").select("doc_id", "text")
    return extract_fields(texts, "text", ["size", "kind", "absent"], make=answer_maker).drop("text")


@query("json_extract_columns", """
    select event_id, case when event_type = 'error' then '' else json_extract_string(props, '$.k') end as k, '' as absent
    from events""")
def _(spark, folder):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    answer = F.when(F.col("event_type") == "error", F.lit("Error: no answer")).otherwise(fenced)
    answers = table(spark, folder, "events").select("event_id", answer.alias("answer"))
    return extract_fields(answers, "answer", ["k", "absent"]).drop("answer")
