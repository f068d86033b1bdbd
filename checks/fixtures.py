"""Inputs derived from the test tables.

Each text runs unchanged in Spark SQL and in DuckDB; names in braces are other
fixtures or test tables. Every fixture covers its whole source table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

FIXTURES: dict[str, str] = {
    # repositories in rank order; names repeat, so the first by rank matters
    "f_catalog": """
        select p_partkey as rank,
               lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '-') as full_name,
               'https://github.com/' || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '-') as html_url,
               p_type, p_size, p_retailprice
        from {part}""",
    # raw search payloads: two results, none, a wrong shape, a failed search
    "f_search_raw": """
        select rank,
               case p_type
                 when 'PROMO' then '{"payload":{}}'
                 when 'LARGE' then '{"payload":{"results":[]}}'
                 when 'SMALL' then cast(null as string)
                 else '{"payload":{"results":[{"hl_name":"' || replace(replace(full_name, 'bolt', '<em>bolt</em>'), '/', '&#x2F;')
                      || '"},{"hl_name":"' || replace(full_name, '/', '&#x2F;') || '-docs"}]}}' end as js
        from {f_catalog}""",
    "f_search_api": """
        select rank,
               case p_type
                 when 'PROMO' then '{"message":"rate limit"}'
                 when 'SMALL' then '{"items":[]}'
                 else '{"items":[{"full_name":"' || full_name || '","html_url":"' || html_url
                      || '"},{"full_name":"' || full_name || '-fork","html_url":"' || html_url || '-fork"}]}' end as js
        from {f_catalog}""",
    # one request per customer: exact name, term, unknown, part of a name, other case
    "f_requests": """
        select c.c_custkey as req_id,
               case c.c_mktsegment
                 when 'FURNITURE' then k.full_name
                 when 'MACHINERY' then split_part(k.full_name, '/', 2)
                 when 'BUILDING' then k.full_name || '-zzz'
                 when 'AUTOMOBILE' then substr(k.full_name, 2)
                 else upper(k.full_name) end as q
        from {customer} c join {f_catalog} k on k.rank = c.c_custkey""",
    # stored settings: customers in debt have no row; keys are NULL, blank or set
    "f_settings": """
        select c_custkey as req_id,
               case when c_nationkey < 8 then cast(null as string) when c_nationkey < 14 then '  '
                    else 'key' || c_custkey end as github_api_key,
               case when c_nationkey % 5 = 0 then cast(null as boolean) else c_acctbal > 3000 end as use_api,
               case when c_nationkey % 7 = 0 then cast(null as int) else 1 + c_nationkey % 4 end as scraping_depth,
               case when c_nationkey % 6 = 0 then cast(null as int) else 4 + c_nationkey end as scraping_max_pages,
               case when c_nationkey % 4 = 0 then cast(null as boolean) else c_nationkey % 4 < 3 end as use_chrome,
               c_mktsegment = 'MACHINERY' or c_nationkey % 4 = 3 as use_firefox,
               case c_mktsegment when 'BUILDING' then 'True' when 'FURNITURE' then 't' when 'MACHINERY' then '1'
                    when 'AUTOMOBILE' then 'yes' end as save_pages
        from {customer}
        where c_acctbal >= 0""",
    # which candidate branches a repository has
    "f_branches": """
        select distinct full_name, 'main' as branch from {f_catalog} where p_size > 25
        union all
        select distinct full_name, 'master' from {f_catalog} where p_type = 'PROMO' or p_type = 'SMALL'
        union all
        select distinct full_name, 'latest' from {f_catalog} where p_retailprice < 950
        union all
        select distinct full_name, 'develop' from {f_catalog}""",
    "f_default_branches": """
        select full_name, case when min(p_size) > 20 then 'main' else 'develop' end as branch
        from {f_catalog} group by full_name""",
    # what the search answered per term and mode: an exact hit among others, a lone other one,
    # many, none, a wrong shape, no payload
    "f_answers": """
        select full_name as q, 'raw' as mode,
               case min(p_type) when 'PROMO' then '{"payload":{}}' when 'SMALL' then cast(null as string)
                 else '{"payload":{"results":[{"hl_name":"' || replace(full_name, '/', '&#x2F;') || '-docs"},{"hl_name":"<em>'
                      || replace(full_name, '/', '</em>&#x2F;') || '"}]}}' end as js
        from {f_catalog} group by full_name
        union all
        select full_name, 'api',
               case min(p_type) when 'LARGE' then '{"message":"rate limit"}'
                 else '{"items":[{"full_name":"' || full_name || '","html_url":"https://github.com/' || full_name || '"}]}' end
        from {f_catalog} group by full_name
        union all
        select substr(full_name, 6), 'raw', '{"payload":{"results":[{"hl_name":"' || min(full_name) || '"}]}}'
        from {f_catalog} group by 1
        union all
        select substr(full_name, 6), 'api', '{"items":[{"full_name":"' || min(full_name) || '","html_url":"x"},{"full_name":"other/fork","html_url":"y"}]}'
        from {f_catalog} group by 1
        union all
        select r_name, 'raw', '{"payload":{"results":[]}}' from (select distinct 'zzz' as r_name from {region}) z
        union all
        select r_name, 'api', '{"items":[]}' from (select distinct 'zzz' as r_name from {region}) z""",
    # repositories by the state of their archive
    "f_archive_state": """
        select full_name, case when min(p_size) < 8 then 'missing' when min(p_size) < 14 then 'bad' else 'good' end as state
        from {f_catalog} group by full_name""",
    # unpacked files: a document is a file of the repository with its number
    "f_files": """
        select d.doc_id, k.full_name,
               '/data/repos/' || k.full_name as root,
               '/data/repos/' || k.full_name || '/' || split_part(k.full_name, '/', 2) || '-main'
                 || case d.lang when 'en' then '/src' when 'fr' then '/src/docs' when 'de' then '/i18n' else '' end as dir,
               'doc' || d.doc_id || case when d.n_chars < 500 then '.bin' when d.n_chars < 900 then '.zip' else '.txt' end as file,
               d.n_chars >= 900 as supported,
               d.text as content
        from {documents} d join {f_catalog} k on k.rank = d.doc_id""",
    # raw addresses that exist: documents that were labelled good
    "f_raw_available": """
        select distinct 'https://raw.githubusercontent.com/' || f.full_name || '/main/'
               || case d.lang when 'en' then 'src/' when 'fr' then 'src/docs/' when 'de' then 'i18n/' else '' end
               || f.file as raw_url
        from {f_files} f join {documents} d on d.doc_id = f.doc_id join {labels} l on l.doc_id = d.doc_id
        where l.quality = 1""",
    "f_sites": """
        select page_id, url, regexp_extract(url, '//([^/?#]*)', 1) as host,
               regexp_extract(url, '([a-z]+[.][a-z]+)(?:[/?#]|$)', 1) as site
        from {pages}""",
    # several links per page, with cycles, self links and seven hub pages
    "f_links": """
        select distinct e.src, e.dst, s.host
        from (select page_id as src, (page_id * 2 + 1) % (select count(*) from {pages}) as dst from {pages}
              union all
              select page_id, (page_id * 2 + 2) % (select count(*) from {pages}) from {pages}
              union all
              select page_id, (page_id * 3 + 7) % (select count(*) from {pages}) from {pages}
              union all
              select page_id, page_id % 7 from {pages}) e
        join {f_sites} s on s.page_id = e.dst""",
    # pages of few hosts that link to each other in their text
    "f_docs_urls": """
        select page_id,
               'https://' || case when host like 'blog.%' or host like 'm.%' then host else site end
                 || '/p' || page_id || regexp_extract(url, '//[^/]*(/.*)$', 1) as url
        from {f_sites}""",
    "f_docs": """
        select u.page_id, u.url,
               p.html || '<a class="next" href="' || a.url || '">a</a><A HREF=''' || b.url || '''>b</A><area href="'
                 || c.url || '"><!-- <a href="' || d.url || '"> -->' as html
        from {f_docs_urls} u
        join {pages} p on p.page_id = u.page_id
        join {f_docs_urls} a on a.page_id = (u.page_id * 2 + 1) % (select count(*) from {pages})
        join {f_docs_urls} b on b.page_id = (u.page_id * 2 + 2) % (select count(*) from {pages})
        join {f_docs_urls} c on c.page_id = u.page_id % 7
        join {f_docs_urls} d on d.page_id = (u.page_id * 5 + 3) % (select count(*) from {pages})""",
    # pages with markup that patterns misread: marks in attributes, text elements, open ends
    "f_odd_pages": """
        select page_id, url,
               '<a title="1 > 0" href="/p' || page_id || '?a=1&amp;b=2&copy=3&#47;&eacute;">x</a>'
                 || '<textarea><a href="/in-text"></textarea><noscript><a href = /plain/ ></noscript>'
                 || '<script><!-- <script></script><a href="/in-script"> --></script><a data-href="/no" HREF=''/q>r''>'
                 || html || '<![CDATA[<a href="/in-data">]]><a href="/last"><!-- open <a href="/lost">' as html
        from {pages}""",
    # chat text with and without commands
    "f_messages": """
        select c.conv_id, c.conv_id || '-' || c.turn as msg_id,
               case when c.conv_id % 6 = 0 then '@getcode ' || k.full_name
                    when c.conv_id % 6 = 1 then '@getcode ' || substr(k.full_name, 6)
                    when c.conv_id % 6 = 2 then '@getcode  zzz '
                    when c.conv_id % 6 = 3 then '@getcodedoc ' || p.url
                    when c.conv_id % 6 = 4 then '@getcodedoc ' || h.url
                    else c.text end as msg
        from {conversations} c
        join {f_catalog} k on k.rank = c.conv_id
        join {f_docs_urls} p on p.page_id = c.conv_id
        join {f_docs_urls} h on h.page_id = c.conv_id % 7
        where c.role = 'user'""",
    "f_run_settings": """
        select m.msg_id as req_id, s.github_api_key, s.use_api, s.scraping_depth, s.scraping_max_pages,
               s.use_chrome, s.use_firefox
        from {f_messages} m join {f_settings} s on s.req_id = m.conv_id""",
    # commands of users over a month, with the time they were sent
    "f_timed_messages": """
        select cast(e.event_id as string) as msg_id, e.ts as sent_at,
               case e.event_type
                 when 'view' then '@getcode ' || k.full_name
                 when 'click' then '@getcode ' || k.full_name
                 when 'purchase' then '@getcodedoc ' || p.url
                 when 'signup' then '@getcode widget'
                 else 'thanks' end as msg
        from {events} e
        join {f_catalog} k on k.rank = e.user_id
        join {f_docs_urls} p on p.page_id = e.user_id""",
    # pages stored by an earlier run
    "f_existing": "select page_id, url from {f_sites} where site like '%.com'",
    # a remote tree: continents hold nations, nations hold customers, customers hold orders
    "f_tree": """
        select r_name as full_name, 'n' || n_nationkey as id, cast(null as string) as parent, n_name as name, 'dir' as type
        from {nation} join {region} on r_regionkey = n_regionkey
        union all
        select r_name, 'c' || c_custkey, 'n' || c_nationkey, c_name, 'dir'
        from {customer} join {nation} on n_nationkey = c_nationkey join {region} on r_regionkey = n_regionkey
        union all
        select r_name, 'o' || o_orderkey, 'c' || o_custkey, 'order-' || o_orderkey || '.txt',
               case o_orderstatus when 'P' then 'submodule' else 'file' end
        from {orders} join {customer} on c_custkey = o_custkey join {nation} on n_nationkey = c_nationkey
        join {region} on r_regionkey = n_regionkey""",
    # a tree of chains: a part's folder lies in that of the part before it, up to 200 deep
    "f_deep_tree": """
        select p_brand as full_name, 'd' || p_partkey as id,
               case when place % 200 = 1 then cast(null as string) else 'd' || before end as parent, 'p' || p_partkey as name, 'dir' as type
        from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as place,
                     lag(p_partkey) over (partition by p_brand order by p_partkey) as before from {part}) d
        union all
        select p_brand, 'f' || p_partkey, 'd' || p_partkey, p_name, case p_type when 'PROMO' then 'link' else 'file' end from {part}
        union all
        select p_brand, 'l' || p_partkey, 'd-' || p_partkey, 'lost', 'file' from {part}
        union all
        select p_brand, 'c' || p_partkey, 'c' || p_partkey, 'circle', 'dir' from {part}
        union all
        select p_brand, 'g' || p_partkey, 'c' || p_partkey, 'inside', 'file' from {part}""",
}

# The same rows for Spark where the order of joins counts: page texts are moved by the last one only.
_SPARK = {
    "f_docs": """
        select u.page_id, u.url,
               p.html || '<a class="next" href="' || u.a || '">a</a><A HREF=''' || u.b || '''>b</A><area href="'
                 || u.c || '"><!-- <a href="' || u.d || '"> -->' as html
        from (select u.page_id, u.url, a.url as a, b.url as b, c.url as c, d.url as d
              from {f_docs_urls} u
              join {f_docs_urls} a on a.page_id = (u.page_id * 2 + 1) % (select count(*) from {pages})
              join {f_docs_urls} b on b.page_id = (u.page_id * 2 + 2) % (select count(*) from {pages})
              join {f_docs_urls} c on c.page_id = u.page_id % 7
              join {f_docs_urls} d on d.page_id = (u.page_id * 5 + 3) % (select count(*) from {pages})) u
        join {pages} p on p.page_id = u.page_id""",
}

# Inputs that Spark moves by key: their files are far smaller than their rows in memory, and a broadcast by the
# size of the files passes through the driver. Not in f_files, whose texts would be moved instead.
_MOVED = {
    "f_requests": {"f_catalog"},
    "f_messages": {"f_catalog"},
    "f_timed_messages": {"f_catalog"},
    "f_run_settings": {"f_settings"},
}

_NAME = re.compile(r"\{([a-z_]+)\}")


def _needs(text: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(text)) if n in FIXTURES or n in TABLES]


def _fill(text: str, value) -> str:
    return _NAME.sub(lambda m: value(m[1]) if m[1] in FIXTURES or m[1] in TABLES else m[0], text)


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is read from the file once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or fixture as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = _SPARK.get(name, FIXTURES[name])
    inputs = {n: fixture(spark, sf_dir, n) for n in _needs(text)}
    inputs |= {n: inputs[n].hint("merge") for n in _MOVED.get(name, ())}
    # the formatter reads braces, so the text's own ones are doubled
    text = text.replace("{", "{{").replace("}", "}}")
    for n in inputs:
        text = text.replace("{{" + n + "}}", "{" + n + "}")
    return spark.sql(text, **inputs)


def oracle(text: str) -> str:
    """SQL for DuckDB: the fixtures a text names, each as a CTE, then the text."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in FIXTURES and name not in order:
            for n in _needs(FIXTURES[name]):
                visit(n)
            order.append(name)

    for n in _needs(text):
        visit(n)
    ctes = [f"{n} as ({_fill(FIXTURES[n], lambda m: m)})" for n in order]
    body = _fill(text, lambda m: m).strip()
    if body.lower().startswith("with "):
        body = body[5:]
        return "with recursive " + ",\n".join([*ctes, body])
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body
