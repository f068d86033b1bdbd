"""SQL that gives the expected rows of each query, written apart from the operators."""

from __future__ import annotations

from checks.fixtures import oracle

# host of an address, by splitting and not by pattern
_HOST = "split_part(split_part(split_part(split_part({}, '//', 2), '/', 1), '?', 1), '#', 1)"


def _host(url: str) -> str:
    return _HOST.replace("{}", url)


_RESOLVED = """
    r as (select q.req_id, coalesce(s.use_api, false) as use_api, s.github_api_key,
                 coalesce(s.scraping_depth, 3) as scraping_depth,
                 coalesce(s.scraping_max_pages, 100) as scraping_max_pages,
                 coalesce(s.use_chrome, true) as use_chrome, coalesce(s.use_firefox, false) as use_firefox
          from {f_requests} q left join {f_settings} s on s.req_id = q.req_id)"""

# results of every request: the first exact one, else all that contain the term
_FOUND = """
    exact as (select q.req_id, min(k.rank) as rank from {REQ} q join {f_catalog} k on k.full_name = q.q group by 1),
    found as (select q.req_id, q.q, k.rank, k.full_name, k.html_url, true as exact
              from exact e join {REQ} q on q.req_id = e.req_id join {f_catalog} k on k.rank = e.rank
              union all
              select q.req_id, q.q, k.rank, k.full_name, k.html_url, false
              from {REQ} q join {f_catalog} k on contains(lower(k.full_name), lower(q.q))
              where q.req_id not in (select req_id from exact))"""
_FOUND_REQUESTS = _FOUND.replace("{REQ}", "{f_requests}")

_OUTCOME = """
    outcome as (select q.req_id, q.q, count(f.rank) as n_results,
                       case count(f.rank) when 0 then 'not_found' when 1 then 'download' else 'list' end as status,
                       coalesce(bool_or(f.exact), false) as exact,
                       case when count(f.rank) = 1 then min(f.full_name) end as full_name,
                       case when count(f.rank) = 1 then min(f.html_url) end as html_url
                from {REQ} q left join found f on f.req_id = q.req_id group by 1, 2)"""
_MESSAGE = """
    case status when 'not_found' then 'Sorry I was unable to find any repository with the key: ' || q
                when 'download' then 'Start downloading repository: ' || full_name || ' ' || html_url
                else 'I found the following libraries on github:' end as message"""

_LINES = """
    many as (select req_id from found group by 1 having count(*) > 1),
    numbered as (select f.req_id, f.full_name, f.html_url,
                        row_number() over (partition by f.req_id order by f.rank) as line_no
                 from found f join many m on m.req_id = f.req_id)"""
_LIST = """
    select req_id, line_no, line_no || '. [' || full_name || '](' || html_url || ')' as line from numbered
    union all
    select req_id, 0, 'I found the following libraries on github:' from many"""

_FILE = """
    file as (select f.*, substr(dir, length(root) + 2) as below from {f_files} f),
    named as (select *, case when contains(below, '/') then substr(below, strpos(below, '/') + 1) else '' end as relpath
              from file),
    urled as (select *, 'https://raw.githubusercontent.com/' || full_name || '/main/'
                     || case relpath when '' then '' else relpath || '/' end || file as raw_url from named),
    ingested as (select u.*, case when supported then 'local'
                                  when raw_url in (select raw_url from {f_raw_available}) then 'raw'
                                  else 'failed' end as status from urled u)"""


def _walk(depth: str) -> str:
    return f"""
    walk as (select page_id as seed, site, page_id as node, 0 as depth from {{f_sites}}
             union
             select w.seed, w.site, l.dst, w.depth + 1
             from walk w join {{f_links}} l on l.src = w.node
             where w.depth < {depth} and (l.host = w.site or ends_with(l.host, '.' || w.site)))"""


_OWN_PAGES = """,
    nearest as (select seed, node, min(depth) as depth from walk group by 1, 2)
    select seed, node, depth from
    (select *, row_number() over (partition by seed order by depth, node) as place from nearest)
    where place <= case seed % 5 when 0 then 30 when 1 then 3 when 2 then 4 else 6 end"""

_SHORT_KEY = "list_extract(string_split(url, '/'), -2)"

_COMMANDS = """
    said as (select msg_id, trim(msg) as msg from {f_messages}),
    routed as (select msg_id, case when starts_with(msg, '@getcodedoc ') then 'getcodedoc' else 'getcode' end as cmd,
                      trim(substr(msg, strpos(msg, ' '))) as arg
               from said where starts_with(msg, '@getcodedoc ') or starts_with(msg, '@getcode '))"""

_CODE = (
    _COMMANDS
    + """,
    asked as (select msg_id as req_id, arg as q from routed where cmd = 'getcode'),"""
    + _FOUND.replace("{REQ}", "asked")
    + ","
    + _OUTCOME.replace("{REQ}", "asked")
    + """,
    modes as (select a.req_id,
                     case when coalesce(trim(s.github_api_key), '') = '' then 'raw' else 'api' end as search_mode,
                     case when coalesce(trim(s.github_api_key), '') <> '' and coalesce(s.use_api, false) then 'api' else 'zip' end as fetch_mode
              from asked a left join {f_run_settings} s on s.req_id = a.req_id),
    zips as (select full_name, min(case branch when 'main' then 1 when 'master' then 2 when 'latest' then 3 end) as pos
             from {f_branches} group by 1),
    chosen as (select o.*, m.search_mode, m.fetch_mode,
                      case when o.full_name is null then null
                           when m.fetch_mode = 'api' then d.branch
                           else case z.pos when 1 then 'main' when 2 then 'master' when 3 then 'latest' end end as branch
               from outcome o join modes m on m.req_id = o.req_id
               left join zips z on z.full_name = o.full_name
               left join {f_default_branches} d on d.full_name = o.full_name),"""
    + _FILE.split("ingested as")[0].rstrip().rstrip(",")
    + """,
    per_file as (select c.req_id, case when u.supported then 'local'
                                       when replace(u.raw_url, '/main/', '/' || c.branch || '/') in (select raw_url from {f_raw_available}) then 'raw'
                                       else 'failed' end as file_status
                 from chosen c join urled u on u.full_name = c.full_name where c.branch is not null),
    counts as (select req_id, count(*) as attempted, count_if(file_status = 'local') as n_local,
                      count_if(file_status = 'raw') as n_raw, count_if(file_status = 'failed') as n_failed
               from per_file group by 1),
    final as (select c.req_id, c.q, c.n_results,
                     case when c.status = 'download' and c.branch is null then 'download_failed' else c.status end as status,
                     c.exact, c.full_name, c.html_url, c.search_mode, c.fetch_mode, c.branch,
                     coalesce(n.attempted, 0) as attempted, coalesce(n.n_local, 0) as "local",
                     coalesce(n.n_raw, 0) as raw, coalesce(n.n_failed, 0) as failed, c.status as shown
              from chosen c left join counts n on n.req_id = c.req_id)"""
)

_ANSWERED = (
    _COMMANDS
    + """,
    asked as (select r.msg_id as req_id, r.arg as q,
                     case when coalesce(trim(s.github_api_key), '') = '' then 'raw' else 'api' end as search_mode,
                     case when coalesce(trim(s.github_api_key), '') <> '' and coalesce(s.use_api, false) then 'api' else 'zip' end as fetch_mode
              from routed r left join {f_run_settings} s on s.req_id = r.msg_id where r.cmd = 'getcode'),
    names as (select full_name, min(p_type) as kind from {f_catalog} group by 1),
    tails as (select substr(full_name, 6) as q, min(full_name) as full_name from {f_catalog} group by 1),
    solved as (select a.*, n.full_name is not null as known,
                      case when n.full_name is not null and a.search_mode = 'raw' then case n.kind when 'PROMO' then 'bad_payload' when 'SMALL' then 'empty' else 'download' end
                           when n.full_name is not null then case n.kind when 'LARGE' then 'bad_payload' else 'download' end
                           when t.q is null then 'not_found' when a.search_mode = 'raw' then 'download' else 'list' end as shown,
                      coalesce(n.full_name, t.full_name) as target
               from asked a left join names n on n.full_name = a.q left join tails t on t.q = a.q),
    zips as (select full_name, min(case branch when 'main' then 1 when 'master' then 2 end) as pos
             from {f_branches} group by 1),
    chosen as (select s.*, case when shown <> 'download' then null when s.fetch_mode = 'api' then d.branch
                                else case z.pos when 1 then 'main' when 2 then 'master' end end as branch,
                      case when s.fetch_mode = 'api' then 'good'
                           when not exists (select 1 from {f_files} f where f.full_name = s.target) then 'missing' else e.state end as state
               from solved s left join zips z on z.full_name = s.target left join {f_default_branches} d on d.full_name = s.target
               left join {f_archive_state} e on e.full_name = s.target),
    """
    + _FILE.split("ingested as")[0].strip().rstrip(",")
    + """,
    per_file as (select distinct c.target as full_name, c.fetch_mode, c.branch, u.doc_id, u.root, u.relpath, u.file, u.content,
                        case when supported then 'local'
                             when replace(u.raw_url, '/main/', '/' || c.branch || '/') in (select raw_url from {f_raw_available}) then 'raw'
                             else 'failed' end as status
                 from chosen c join urled u on u.full_name = c.target where c.branch is not null and c.state = 'good'),
    counts as (select full_name, fetch_mode, count(*) as attempted, count_if(status = 'local') as n_local,
                      count_if(status = 'raw') as n_raw, count_if(status = 'failed') as n_failed from per_file group by 1, 2),
    final as (select c.*, case when shown <> 'download' then shown when branch is null then 'download_failed'
                               when state = 'missing' then 'missing_archive' when state = 'bad' then 'bad_archive' else 'download' end as status,
                     case shown when 'download' then 1 when 'list' then 2 else 0 end as n_results,
                     coalesce(n.attempted, 0) as attempted, coalesce(n.n_local, 0) as n_local, coalesce(n.n_raw, 0) as n_raw,
                     coalesce(n.n_failed, 0) as n_failed
              from chosen c left join counts n on n.full_name = c.target and n.fetch_mode = c.fetch_mode and c.shown = 'download')"""
)

_DOCS = (
    _COMMANDS
    + """,
    asked as (select r.msg_id as req_id, r.arg as url, split_part(r.arg, '#', 1) as node, """
    + _host("r.arg")
    + """ as domain,
                     coalesce(s.scraping_depth, 3) as max_depth, coalesce(s.scraping_max_pages, 100) as max_pages,
                     coalesce(s.use_chrome, true) as use_chrome, coalesce(s.use_firefox, false) as use_firefox
              from routed r left join {f_run_settings} s on s.req_id = r.msg_id where r.cmd = 'getcodedoc'),
    crawls as (select node, max_depth, max_pages, domain, min(req_id) as seed from asked group by 1, 2, 3, 4),
    d_pages as (select page_id, url, html, split_part(url, '#', 1) as node from {f_docs}),
    d_links as (select distinct p.node as src, b.node as dst, """
    + _host("b.node")
    + """ as host
                from (select node, unnest(regexp_extract_all(split_part(html, '<!-- <a', 1),
                                                             '(?i)href=["'']([^"'']*)["'']', 1)) as href from d_pages) p
                join d_pages b on b.node = split_part(p.href, '#', 1)),
    walk as (select seed, domain, node, 0 as depth, max_depth, max_pages from crawls
             union
             select w.seed, w.domain, l.dst, w.depth + 1, w.max_depth, w.max_pages
             from walk w join d_links l on l.src = w.node
             where w.depth < w.max_depth and (l.host = w.domain or ends_with(l.host, '.' || w.domain))),
    nearest as (select seed, domain, node, max_pages, min(depth) as depth from walk group by 1, 2, 3, 4),
    kept as (select seed, domain, node, depth from
             (select *, row_number() over (partition by seed order by depth, node) as place from nearest)
             where place <= max_pages),
    per_crawl as (select k.seed, count(*) as n_found, count(p.node) as n_saved
                  from kept k left join (select distinct node from d_pages) p on p.node = k.node group by 1),
    final as (select a.req_id, a.url, a.domain, c.seed, a.max_depth, a.max_pages, a.use_chrome, a.use_firefox,
                     coalesce(n.n_found, 0) as n_found, coalesce(n.n_saved, 0) as n_saved
              from asked a join crawls c on c.node = a.node and c.max_depth = a.max_depth and c.max_pages = a.max_pages
              left join per_crawl n on n.seed = c.seed)"""
)

# the same with some addresses cut down to a path, and whether a request has settings of its own
_ODD_DOCS = (
    _DOCS.replace("r.arg as url", "_ARG as url").replace("split_part(r.arg, '#', 1)", "split_part(_ARG, '#', 1)")
    .replace(_host("r.arg"), f"case when _ARG = r.arg then {_host('r.arg')} else '' end")
    .replace("_ARG", "case when ends_with(r.msg_id, '3') then replace(r.arg, 'https://', '') else r.arg end")
    .replace("as use_firefox\n              from routed", "as use_firefox, s.req_id is not null as has_row\n              from routed")
    .replace("a.use_chrome, a.use_firefox,\n", "a.use_chrome, a.use_firefox, a.has_row,\n")
)

# the browser is picked by the first 32 bits of a digest of the run
_BROWSER = """
    case when use_chrome and use_firefox
         then case when ('0x' || substr(md5(cast(req_id as varchar)), 1, 8))::bigint % 2 = 0 then 'chromium' else 'firefox' end
         when use_chrome then 'chromium' when use_firefox then 'firefox' end as browser"""

_ARCHIVED = """
    archived as (select 'own' || (doc_id % 10) || '/rep' || doc_id as full_name, 'main/text.txt' as entry,
                        cast(octet_length(encode(text)) as bigint) as n, cast(0 as integer) as piece,
                        sha256(text) as digest, cast(null as varchar) as problem from {documents}
                 union all
                 select 'own' || (doc_id % 10) || '/rep' || doc_id, 'main/id.txt', length(cast(doc_id as varchar)), 0,
                        sha256(cast(doc_id as varchar)), null from {documents})"""

_HREF = """(select page_id, url, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
             '<a href="([^"]*)"', 1)) as href from {pages})"""
# every link of the pages starts at the root of its site
_ROOTED = f"split_part(url, '//', 1) || '//' || {_host('url')} || replace(href, '&amp;', '&')"

# files after a fetch, the same fetch twice again with changes, and a merge of copies
_STORED = """f as (select *, dir || '/' || file as path from {f_files}),
        stored as (
            select full_name, path, case when contains(path, '/src/') then content || chr(10) || '2' else content end as content
            from f where supported
            union all
            select full_name, path, content from f where not supported and full_name not in (select full_name from f where supported)
            union all
            select full_name, path || '.copy', content from f where not supported)"""

_TEXTS: dict[str, str] = {
    "read_search_raw": """
        select rank, pos - 1 as pos, name as full_name, 'https://github.com/' || name as html_url
        from (select rank, unnest(range(1, len(names) + 1)) as pos,
                     replace(replace(replace(unnest(names), '<em>', ''), '</em>', ''), '&#x2F;', '/') as name
              from (select rank, cast(json_extract_string(js, '$.payload.results[*].hl_name') as varchar[]) as names
                    from {f_search_raw} where js is not null))""",
    "read_search_api": """
        select rank, pos - 1 as pos, full_name, html_url
        from (select rank, unnest(range(1, len(names) + 1)) as pos, unnest(names) as full_name, unnest(urls) as html_url
              from (select rank, json_extract_string(js, '$.items[*].full_name') as names,
                           json_extract_string(js, '$.items[*].html_url') as urls
                    from {f_search_api} where js is not null))""",
    "search_payload_status": """
        select rank, 'raw' as mode, case when js is null then 'empty' when json_exists(js, '$.payload.results') then 'ok'
                                         else 'bad_payload' end as status from {f_search_raw}
        union all
        select rank, 'api', case when js is null then 'empty' when json_exists(js, '$.items') then 'ok'
                                 else 'bad_payload' end from {f_search_api}""",
    "read_requests_from_chat": "with " + _COMMANDS + " select msg_id, cmd, arg from routed",
    "unzip_entries": """
        select doc_id, 'main/text.txt' as entry, cast(octet_length(encode(text)) as bigint) as n,
               sha256(text) as digest, cast(null as varchar) as problem from {documents}
        union all
        select doc_id, 'main/id.txt', length(cast(doc_id as varchar)), sha256(cast(doc_id as varchar)), null from {documents}""",
    "read_repositories_zip": """
        select 'own' || (doc_id % 10) || '/rep' || doc_id as full_name,
               '/data/repos/own' || (doc_id % 10) || '/rep' || doc_id || '/main/' || unnest(['text.txt', 'id.txt']) as path
        from {documents}""",
    "archive_contents": "with " + _ARCHIVED + """
        select * from archived
        union all
        select 'own' || (doc_id % 10) || '/text' || doc_id, null, null, null, null, 'bad_archive' from {documents}""",
    "archives_stream": "with " + _ARCHIVED + " select * from archived",
    "list_deep_tree": """
        with placed as (select p_brand, p_partkey, p_name, p_type, row_number() over (partition by p_brand order by p_partkey) as place from {part}),
        named as (select *, string_agg('p' || p_partkey, '/') over (partition by p_brand, (place - 1) // 200 order by place) as above from placed)
        select p_brand as full_name, 'f' || p_partkey as id, above || '/' || p_name as path from named where p_type <> 'PROMO'""",
    "list_tree": """
        select r_name as full_name, 'o' || o_orderkey as id, n_name || '/' || c_name || '/order-' || o_orderkey || '.txt' as path
        from {orders} join {customer} on c_custkey = o_custkey join {nation} on n_nationkey = c_nationkey
        join {region} on r_regionkey = n_regionkey where o_orderstatus <> 'P'""",
    "read_repositories_api": """
        select r_name as full_name, '/data/repos/' || r_name || '/' || n_name || '/' || c_name || '/order-' || o_orderkey || '.txt' as path
        from {orders} join {customer} on c_custkey = o_custkey join {nation} on n_nationkey = c_nationkey
        join {region} on r_regionkey = n_regionkey where o_orderstatus <> 'P'""",
    "list_files": """
        select 'source=' || source || '/lang=' || lang as dir,
               cast(sum(octet_length(encode(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) + 1) as bigint) as n_bytes
        from {documents} group by 1""",
    "read_pages": f"select page_id, url, {_host('url')} as host, length(html) as n_chars from {{pages}}",
    "url_netloc": f"""
        select page_id, {_host('url')} as netloc, replace({_host('url')}, '.example', ' x.example') as with_blank,
               'me@' || {_host('url')} || ':8080' as with_port, {_host('url')} as host, '' as no_scheme
        from {{pages}}""",
    "strip_highlight": "select p_partkey, replace(p_name, ' ', '/') || '&amp;' || p_brand as name from {part}",
    "repo_urls": """
        select rank, 'https://github.com/' || full_name as repo_url,
               'https://github.com/' || full_name || '/archive/refs/heads/main.zip' as archive_url,
               split_part(full_name, '/', 1) as owner, split_part(full_name, '/', 2) as repo,
               '/data/repos/' || full_name || '.zip' as archive_path, '/data/repos/' || full_name as extraction_folder
        from {f_catalog}""",
    "raw_file_url": "with " + _FILE + " select doc_id, relpath, raw_url from ingested",
    "raw_file_url_parity": """
        with f as (select doc_id, full_name, file, split_part(dir, '/', 5) || substr(dir, length('/data/repos/' || full_name) + 1) as relpath
                   from {f_files})
        select doc_id, relpath, 'https://raw.githubusercontent.com/' || full_name || '/main/' || relpath || '/' || file as raw_url from f""",
    "page_key": f"select page_id, {_SHORT_KEY} as short_key, sha256(url) as key from {{pages}}",
    "allowed_domain": """
        select l.src, l.dst, l.host, s.site from {f_links} l join {f_sites} s on s.page_id = l.src
        join {f_sites} t on t.page_id = l.dst where t.site = s.site""",
    "handled_entries": """
        select full_name, type, count(*) as n from {f_tree} where type = 'file' or type = 'dir' group by 1, 2""",
    "to_flag": """
        select req_id, case save_pages when 'True' then true when 't' then true when '1' then true else false end as save_pages
        from {f_settings}""",
    "setting_flag": """
        select req_id, case when use_api is null then false else use_api end as use_api,
               case when use_chrome is null then true else use_chrome end as use_chrome from {f_settings}""",
    "resolved_settings": "with " + _RESOLVED + """
        select req_id, false as search_on_web, false as search_on_stack_overflow, use_api, github_api_key,
               scraping_depth, scraping_max_pages, use_chrome, use_firefox, false as use_webkit from r""",
    "search_and_fetch_mode": "with " + _RESOLVED + """
        select req_id, case when github_api_key like 'key%' then 'api' else 'raw' end as search_mode,
               case when github_api_key like 'key%' and use_api then 'api' else 'zip' end as fetch_mode,
               case when github_api_key is not null and use_api then 'api' else 'zip' end as fetch_mode_parity from r""",
    "pick_profile": "with " + _RESOLVED + " select req_id, " + _BROWSER + " from r",
    "resolve_href": f"""
        with p as (select page_id, url, 'k' || page_id as k, split_part(url, '//', 1) || '//' || {_host('url')} as site,
                          split_part(url, '#', 1) as bare, split_part(split_part(url, '#', 1), '?', 1) as plain from {{pages}}),
             q as (select *, regexp_extract(plain, '^(.*/)[^/]*$', 1) as folder,
                          regexp_extract(plain, '^(.*/)[^/]*/[^/]*$', 1) as above from p)
        select page_id, 'root' as form, site || '/' || k as abs_url from q
        union all select page_id, 'host', split_part(url, '//', 1) || '//h.org/' || k from q
        union all select page_id, 'absolute', 'http://h.org/' || k from q
        union all select page_id, 'fragment', bare || '#' || k from q
        union all select page_id, 'query', plain || '?q=' || k from q
        union all select page_id, 'relative', folder || k || '?a=1' from q
        union all select page_id, 'up', above || k from q
        union all select page_id, 'empty', bare from q""",
    "name_search": """
        select distinct q.q, k.rank from {f_requests} q join {f_catalog} k on contains(lower(k.full_name), lower(q.q))""",
    "name_index": """
        with terms as (select q from {f_requests} union select substr(full_name, 4, 2) from {f_catalog})
        select distinct q.q, k.rank from terms q join {f_catalog} k on contains(lower(k.full_name), lower(q.q))""",
    "find_repo": "with " + _FOUND_REQUESTS + " select req_id, q, rank, full_name, html_url, exact from found",
    "first_by_rank": """
        select req_id, rank, full_name, html_url from
        (select q.req_id, k.rank, k.full_name, k.html_url, row_number() over (partition by q.req_id order by k.rank) as place
         from {f_requests} q join {f_catalog} k on k.full_name = q.q) where place = 1""",
    "request_status": "with " + _FOUND_REQUESTS + "," + _OUTCOME.replace("{REQ}", "{f_requests}") + f"""
        select req_id, q, n_results, status, exact, full_name, html_url, {_MESSAGE} from outcome""",
    "result_count": "with " + _FOUND_REQUESTS + """
        select q.req_id, count(f.rank) as n_results from {f_requests} q left join found f on f.req_id = q.req_id group by 1""",
    "numbered_list": "with " + _FOUND_REQUESTS + "," + _LINES + _LIST,
    "first_branch": """
        select full_name, case when bool_or(branch = 'main') then 'main' when bool_or(branch = 'master') then 'master'
                               when bool_or(branch = 'latest') then 'latest' end as branch
        from {f_branches} group by 1""",
    "ingest_with_fallback": "with " + _FILE + " select doc_id, relpath, raw_url, status from ingested",
    "ingest_without_fallback": """
        select doc_id, case when supported then 'local' else 'failed' end as status from {f_files}""",
    "attempt_count": "with " + _FILE + """
        select full_name, count(*) as attempted, count_if(status = 'local') as "local", count_if(status = 'raw') as raw,
               count_if(status = 'failed') as failed from ingested group by 1""",
    "skip_existing": "select page_id, url from {pages} where url not in (select url from {f_existing})",
    "extract_links": f"select distinct page_id, {_ROOTED} as abs_url from {_HREF} h",
    "extract_links_all_tags": f"""
        with h as (select page_id, url, unnest(regexp_extract_all(
                     regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)href=["'']([^"'']*)["'']', 1)) as href from {{f_docs}})
        select distinct page_id, case when href like 'https://%' then href else {_ROOTED} end as abs_url from h""",
    "scan_links": f"select distinct page_id, {_ROOTED} as abs_url from {_HREF} h",
    "scan_odd_links": f"""
        select distinct page_id, {_ROOTED} as abs_url
        from (select * from {_HREF}
              union all
              select page_id, url, unnest(['/p' || page_id || '?a=1&b=2&copy=3/é', '/plain/', '/q>r', '/last']) from {{pages}}) h""",
    "crawl_sites": "with " + _walk("3") + " select seed, node, min(depth) as depth from walk group by 1, 2",
    "crawl_unlimited": "with " + _walk("4") + " select seed, node, min(depth) as depth from walk group by 1, 2",
    "page_cap": "with " + _walk("3") + """,
        nearest as (select seed, node, min(depth) as depth from walk group by 1, 2)
        select seed, node, depth from
        (select *, row_number() over (partition by seed order by depth, node) as place from nearest) where place <= 5""",
    "depth_limit": "with " + _walk("1 + w.seed % 3") + """,
        nearest as (select seed, node, min(depth) as depth from walk where depth > 0 group by 1, 2)
        select seed, node, depth from
        (select *, row_number() over (partition by seed order by depth, node) as place from nearest)
        where place <= 3 + seed % 9""",
    "crawl_own_limits": "with " + _walk("case w.seed % 4 when 0 then 4 when 1 then 1 else 2 end") + _OWN_PAGES,
    "crawl_resumed": "with " + _walk("case w.seed % 4 when 0 then 4 when 1 then 1 else 2 end") + _OWN_PAGES,
    "accumulate": "with " + _walk("2") + """,
        nearest as (select seed, node, min(depth) as depth from walk where depth > 0 group by 1, 2),
        stored as (select page_id as seed, page_id as node from {f_existing}),
        fresh as (select n.*, row_number() over (partition by n.seed order by n.depth, n.node) as place from nearest n
                  left join stored b on b.seed = n.seed and b.node = n.node where b.seed is null)
        select seed, node from stored
        union all
        select f.seed, f.node from fresh f
        where f.place + (select count(*) from stored b where b.seed = f.seed) <= 6""",
    "distinct_urls": f"select distinct {_host('url')} as host, {_ROOTED} as abs_url from {_HREF} h",
    "page_count": f"select {_host('url')} as host, count(distinct url) as n from {{pages}} group by 1",
    "sort_pages": f"""
        select {_host('url')} as host, url, row_number() over (partition by {_host('url')} order by url) as line_no
        from (select distinct url from {{f_docs_urls}})""",
    "url_list": "with " + _walk("2") + """,
        nearest as (select seed, node, min(depth) as depth from walk group by 1, 2),
        kept as (select * from (select *, row_number() over (partition by seed order by depth, node) as place from nearest) where place <= 20)
        select k.seed, string_agg(p.url, chr(10) order by p.url) as urls, count(*) as n
        from kept k join {pages} p on p.page_id = k.node group by 1""",
    "key_collisions": f"""
        select {_host('url')} as host, {_SHORT_KEY} as key, count(*) - 1 as n_lost, max(page_id) as kept_page
        from {{pages}} group by 1, 2 having count(*) > 1""",
    "last_wins": f"""
        select page_id, url, host, key from
        (select *, row_number() over (partition by host, key order by page_id desc) as place
         from (select page_id, url, {_host('url')} as host, {_SHORT_KEY} as key from {{pages}})) where place = 1""",
    "fetch_found": "with " + _walk("2") + """,
        nearest as (select seed, node, min(depth) as depth from walk group by 1, 2),
        kept as (select distinct node from
                 (select *, row_number() over (partition by seed order by depth, node) as place from nearest) where place <= 20)
        select k.node as page_id, case when e.page_id is null then p.url end as url,
               case when e.page_id is null then length(p.html) end as n_chars, e.page_id is null as fetched
        from kept k join {pages} p on p.page_id = k.node left join {f_existing} e on e.page_id = k.node""",
    "ingest_documents": "with " + _FILE + " select doc_id, full_name, status, length(content) as n_chars from ingested",
    "save_pages": f"select page_id, {_host('url')} as host, sha256(url) as key, length(html) as n_chars from {{pages}}",
    "save_pages_parity": f"""
        select max(page_id) as page_id, {_host('url')} as host, {_SHORT_KEY} as key from {{pages}} group by 2, 3""",
    "write_manifest": f"""
        with u as (select page_id, url, {_host('url')} as host from {{f_docs_urls}})
        select host, url as line from u
        union all
        select host, first(url order by page_id) from u group by 1""",
    "merge_manifest": f"""
        with u as (select distinct url, {_host('url')} as host, min(page_id) as page_id from {{f_docs_urls}} group by all),
        l as (select host, true as is_page, url as line from u
              union select host, false, first(url order by page_id) from u group by 1)
        select host, row_number() over (partition by host order by is_page, line) as line_no, line from l""",
    "upsert_repeated": """
        select page_id, case when site not like '%.org' then site end as host, url from {f_sites}""",
    "skip_existing_repeated": """
        with n as (select page_id, case when site not like '%.org' then site end as site, url from {f_sites}),
        known as (select distinct site from n where url in (select url from {f_existing}))
        select min(page_id) as page_id, site, min_by(url, page_id) as url from n
        where not exists (select 1 from known k where k.site is not distinct from n.site) group by site""",
    "last_wins_repeated": """
        select max(page_id) as page_id, case when site not like '%.net' then site end as site, len(string_split(url, '/')) as deep
        from {f_sites} group by 2, 3""",
    "write_if_absent": """
        select p.page_id, p.url, case when e.url is null then 'new' else 'earlier' end as origin
        from {pages} p left join {f_existing} e on e.url = p.url""",
    "replace_repo": """
        select full_name, dir || '/' || file as path, case when supported then 2 else 1 end as version from {f_files}
        where supported or full_name not in (select full_name from {f_files} where supported)""",
    "replace_repo_merge": """
        select full_name, dir || '/' || file as path, case when supported then 2 else 1 end as version from {f_files}""",
    "file_store": "with " + _STORED + """
        select full_name, path, sha256(content) as digest, octet_length(encode(content)) as n_bytes from stored""",
    "file_store_contents": "with " + _STORED + """
        select sha256(content) as digest, 1 as n_stored, count(*) as n_files from stored group by 1""",
    "route_stream": "with " + _COMMANDS + " select msg_id, cmd, arg from routed",
    "seen_stream": "with " + _COMMANDS + " select distinct cmd, arg from routed",
    "requests_seen_lately": """
        with said as (select msg_id, sent_at, msg from {f_timed_messages} where msg <> 'thanks'),
        asked as (select msg_id, sent_at, case when starts_with(msg, '@getcodedoc ') then 'getcodedoc' else 'getcode' end as cmd,
                         trim(substr(msg, strpos(msg, ' '))) as arg from said),
        gaps as (select *, lag(sent_at) over (partition by cmd, arg order by sent_at, msg_id) as before from asked)
        select cmd, arg, msg_id as first_id, strftime(sent_at, '%Y-%m-%d %H:%M:%S.%f') as first_seen
        from gaps where before is null or sent_at - before > interval 2 days""",
    "get_code_status": "with " + _CODE + f"""
        select req_id, q, n_results, status, exact, full_name, search_mode, fetch_mode, branch,
               case when fetch_mode = 'zip' and branch is not null
                    then 'https://github.com/' || full_name || '/archive/refs/heads/' || branch || '.zip' end as archive_url,
               case when branch is not null then '/data/repos/' || full_name || '.zip' end as archive_path,
               attempted, "local", raw, failed, {_MESSAGE.replace('case status', 'case shown')},
               case when status = 'download' then 'All files have been ingested using ' || attempted || ' threads, Miao!' end as final_text
        from final""",
    "get_code_lists": "with " + _CODE + "," + _LINES + _LIST,
    "get_code_log": "with " + _CODE + """,
        events as (select req_id, 1 as pos, 'search_started' as event, 0 as n from final
                   union all select req_id, 2, 'not_found', 0 from final where status = 'not_found'
                   union all select req_id, 3, 'listed', n_results from final where status = 'list'
                   union all select req_id, 4, 'download_started', 1 from final where status in ('download', 'download_failed')
                   union all select req_id, 5, 'download_failed', 0 from final where status = 'download_failed'
                   union all select req_id, 6, 'ingest_started', 0 from final where status = 'download'
                   union all select req_id, 7, 'ingest_finished', attempted from final where status = 'download')
        select req_id as run_id, row_number() over (partition by req_id order by pos) as step, event, n from events""",
    "get_code_answered_status": "with " + _ANSWERED + """
        select req_id, q, cast(n_results as bigint) as n_results, status, shown = 'download' and known as exact,
               case when shown = 'download' then target end as full_name, search_mode, fetch_mode, branch,
               attempted, n_local as "local", n_raw as raw, n_failed as failed,
               case shown when 'download' then 'Start downloading repository: ' || target || ' https://github.com/' || target
                          when 'list' then 'I found the following libraries on github:'
                          else 'Sorry I was unable to find any repository with the key: ' || q end as message,
               case when status = 'download' then 'All files have been ingested using ' || attempted || ' threads, Miao!' end as final_text
        from final""",
    "get_code_ingested": "with " + _ANSWERED + """
        select distinct full_name, fetch_mode, branch,
               root || '/' || split_part(full_name, '/', 2) || '-' || case fetch_mode when 'api' then branch else 'main' end
                 || case relpath when '' then '' else '/' || relpath end || '/' || file as path, status, sha256(content) as digest
        from per_file""",
    "get_docs_status": "with " + _DOCS + f"""
        select req_id, url, domain, seed, max_depth, max_pages, {_BROWSER}, n_found, n_saved,
               'All files have been ingested using ' || n_saved || ' threads, Miao!' as final_text from final""",
    "get_docs_outcomes": "with " + _ODD_DOCS + """
        select req_id, url, outcome, case outcome when 'crawled' then n_found else 0 end as n_found,
               case outcome when 'crawled' then n_saved else 0 end as n_saved,
               case outcome when 'crawled' then 'All files have been ingested using ' || n_saved || ' threads, Miao!'
                            when 'no_browser' then 'please activate at least one browser engine' end as final_text
        from (select *, case when split_part(req_id, '-', 1)::int % 4 = 0 and has_row then 'no_browser'
                             when domain = '' then 'crawl_failed' else 'crawled' end as outcome from final)""",
    "get_docs_saved": "with " + _DOCS + """
        select distinct k.domain as host, sha256(p.node) as key, p.page_id, p.url, length(p.html) as n_chars
        from kept k join d_pages p on p.node = k.node""",
    "get_docs_manifest": "with " + _DOCS + """,
        lines as (select domain as host, true as is_page, node as line from kept
                  union select domain, false, min(node) from crawls group by 1)
        select host, row_number() over (partition by host order by is_page, line) as line_no, line from lines""",
    "get_docs_ingested": "with " + _DOCS + """
        select distinct k.domain as full_name, sha256(p.node) || '.html' as file, 'local' as status, sha256(p.html) as digest
        from kept k join d_pages p on p.node = k.node""",
    "get_docs_found": "with " + _DOCS + " select seed, node, depth from kept",
    "get_docs_pages": "with " + _DOCS + """
        select distinct k.domain as folder, sha256(p.node) as key, p.page_id, p.url, length(p.html) as n_chars
        from kept k join d_pages p on p.node = k.node""",
    "get_docs_log": "with " + _DOCS + """
        select req_id as run_id, step, event, case event when 'crawl_ended' then n_found when 'pages_saved' then n_saved
                                                         when 'ingest_finished' then n_saved else 0 end as n
        from final, (values (1, 'settings_read'), (2, 'crawl_started'), (3, 'crawl_ended'), (4, 'pages_saved'),
                            (5, 'ingest_started'), (6, 'ingest_finished')) as e(step, event)""",
    "links_and_pages_per_host": f"""
        with l as (select {_host('url')} as host, count(distinct {_ROOTED}) as n_links from {_HREF} h group by 1)
        select p.host, p.n_pages, coalesce(l.n_links, 0) as n_links
        from (select {_host('url')} as host, count(*) as n_pages from {{pages}} group by 1) p left join l on l.host = p.host""",
}

ORACLE: dict[str, str] = {name: oracle(text) for name, text in _TEXTS.items()}
