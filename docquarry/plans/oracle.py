"""SQL for DuckDB that computes the result of each registered query on its own.

The statements are put together from common table expressions; they use windows, lists
and joins over whole tables and share nothing with the Spark code but the fixed values.
"""

from __future__ import annotations

from docquarry.functions.urls import ASSET_EXTENSIONS, BLOCKED_KEYWORDS

# Tags that separate words, and named characters of the given pages (the ampersand comes last).
BLOCKS = (
    "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|"
    "ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)
NAMED = [("middot", "·"), ("copy", "©"), ("quot", '"'), ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("amp", "&")]

DIMENSION = 64
CHUNK = 500
NO_LIMIT = 1 << 40
# Deeper than any walk over the given tables; a level without pages adds nothing.
TO_THE_END = 12


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


# URL expressions

_S = r"(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"


def scheme(u):
    return rf"lower(regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1))"


def netloc(u):
    return f"regexp_extract({u}, '^{_S}//([^/?#]*)', 1)"


def full_path(u):
    return f"regexp_extract({u}, '^{_S}(?://[^/?#]*)?([^?#]*)', 1)"


def path(u):
    return f"regexp_replace({full_path(u)}, ';[^/]*$', '')"


def query(u):
    return rf"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def fragment(u):
    return f"regexp_extract({u}, '#(.*)$', 1)"


def normal(u):
    q = query(u)
    return (
        f"({scheme(u)} || '://' || {netloc(u)} || {path(u)}"
        f" || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"
    )


def deep(u):
    return f"({path(u)} NOT IN ('', '/'))"


def asset(u):
    endings = ", ".join(_quote("." + e) for e in ASSET_EXTENSIONS)
    return f"list_bool_or([ends_with(lower({path(u)}), e) FOR e IN [{endings}]])"


def blocked(u):
    words = ", ".join(_quote(w) for w in BLOCKED_KEYWORDS)
    return f"list_bool_or([contains(lower({u}), w) FOR w IN [{words}]])"


def allowed(u, base):
    host, own = f"lower({netloc(u)})", f"lower({netloc(base)})"
    return f"({host} = {own} OR {host} = 'www.' || {own})"


def relevant(u, base):
    return f"({allowed(u, base)} AND {deep(u)} AND NOT {asset(u)} AND NOT {blocked(u)})"


def lint(u):
    return (
        f"CASE WHEN {query(u)} <> '' OR len(string_split({path(u)}, '/')) > 3"
        f" THEN {scheme(u)} || '://' || {netloc(u)} || '/docs' END"
    )


def entities(x):
    for name, character in NAMED:
        x = f"replace({x}, '&{name};', {_quote(character)})"
    return x


def resolve(h, page):
    root = f"{scheme(page)} || '://' || {netloc(page)}"
    here = full_path(page)
    return (
        rf"CASE WHEN regexp_matches({h}, '^[a-zA-Z][a-zA-Z0-9+.\-]*:') THEN {h}"
        f" WHEN {h} LIKE '//%' THEN {scheme(page)} || ':' || {h}"
        f" WHEN {h} LIKE '/%' THEN {root} || {h}"
        f" WHEN {h} LIKE '?%' THEN {root} || {here} || {h}"
        f" WHEN {h} LIKE '#%' THEN regexp_replace({page}, '#.*$', '') || {h}"
        f" ELSE {root} || regexp_replace({here}, '[^/]*$', '') || {h} END"
    )


def href_list(html):
    found = rf"""regexp_extract_all({html}, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1)"""
    decoded = f"list_transform({found}, lambda h: {entities('h')})"
    return f"list_filter({decoded}, lambda h: h <> '')"


# Text expressions

_WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def clean(x):
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def visible(html):
    unseen = "|".join(
        [r"<!--.*?(?:-->|\z)"]
        + [rf"<{t}\b.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "noscript", "template")]
    )
    x = f"regexp_replace({html}, '(?is){unseen}', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?is)<head\b.*?</head\s*>', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?i)</?(?:{BLOCKS})\b[^>]*>', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    return clean(entities(x))


def word_list(x):
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def chunk_ctes(source: str, keys: str) -> list[str]:
    """``chunks(keys, chunk_pos, document)`` from ``source(keys, text)``."""
    return [
        f"word_lists AS (SELECT {keys}, {word_list(clean('text'))} AS ws FROM {source})",
        f"""chunks AS (
          SELECT {keys}, c AS chunk_pos,
                 array_to_string(ws[c * {CHUNK} + 1 : c * {CHUNK} + {CHUNK}], ' ') AS document
          FROM (SELECT *, unnest(range(0, ceil(len(ws) / {CHUNK}.0)::BIGINT)) AS c
                FROM word_lists))""",
    ]


def vector_ctes(source: str, key: str, text: str, out: str) -> list[str]:
    """``out(key, embedding)``: hashed word counts of length 1."""
    return [
        f"""{out}_counts AS (
          SELECT {key}, ('0x' || substr(md5(word), 1, 8))::BIGINT % {DIMENSION} AS pos, count(*) AS n
          FROM (SELECT {key}, unnest({word_list(clean(text))}) AS word FROM {source})
          GROUP BY ALL)""",
        f"""{out}_norms AS (
          SELECT {key}, sqrt(sum(n * n)::DOUBLE) AS norm FROM {out}_counts GROUP BY {key})""",
        f"""{out} AS (
          SELECT {key}, list(coalesce(n / norm, 0)::FLOAT ORDER BY p.pos) AS embedding
          FROM {out}_norms CROSS JOIN (SELECT unnest(range({DIMENSION})) AS pos) p
          LEFT JOIN {out}_counts USING ({key}, pos) GROUP BY {key})""",
    ]


def distance(a, b):
    return (
        f"list_sum(list_transform(list_zip({a}, {b}), lambda z:"
        " (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
    )


def numbers(source: str, keys: str, vector: str = "embedding") -> str:
    return (
        f"SELECT {keys}, (i - 1)::INTEGER AS pos, {vector}[i] AS value FROM "
        f"(SELECT *, unnest(range(1, len({vector}) + 1)) AS i FROM {source})"
    )


# Derived tables

_BARE = r"regexp_replace({}, '^(?:www|m|blog)\.', '')"

LINKS = f"""links AS (
  SELECT url, (i - 1)::INTEGER AS pos, hs[i] AS href
  FROM (SELECT url, hs, unnest(range(1, len(hs) + 1)) AS i
        FROM (SELECT url, {href_list('html')} AS hs FROM pages)))"""

URLS = f"""urls AS (
  SELECT url, pos, link, 'https://' || {_BARE.format(netloc('url'))} AS base FROM (
    SELECT url, -1 AS pos, url AS link FROM pages
    UNION ALL SELECT url, pos, {resolve('href', 'url')} FROM links))"""

PROJECTS = f"""projects AS (
  SELECT name, 'https://' || name AS url, md5('https://' || name) AS collection_name,
         'store/collection_name=' || md5('https://' || name) AS store_path,
         CASE WHEN name LIKE 'blog.%' THEN 'hashed' END AS embedding_provider
  FROM (SELECT DISTINCT {netloc('url')} AS name FROM pages))"""

RECORDS = """records AS (
  SELECT md5(base) AS collection_name, vec_id::VARCHAR AS id, 'vector ' || vec_id AS document,
         embedding, base AS source, base || '/' || vec_id AS page_url, 0 AS chunk_pos
  FROM (SELECT *, 'https://label' || label || '.example.com' AS base FROM embeddings))"""

SITE = rf"""made AS (
  SELECT page_id % 4 AS project, page_id // 4 AS i, html,
         'https://docs' || (page_id % 4) || '.example.com'
         || regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) || '/p' || page_id
         || CASE WHEN regexp_extract(url, '\?([^#]*)', 1) <> ''
                 THEN '?' || regexp_extract(url, '\?([^#]*)', 1) ELSE '' END AS url
  FROM pages)""", """edges AS (
  SELECT project, i, unnest(range(19)) AS pos,
         unnest(list_concat(range(16 * i + 1, 16 * i + 17), [3 * i + 1, greatest(i - 1, 0), 0])) AS j
  FROM made)""", """site AS (
  SELECT m.project, m.i, m.url,
         CASE WHEN contains(m.html, '</body>') OR m.i = 0 THEN m.html || '<nav>' || l.anchors
              || '<a href="https://off.example.org/' || m.i || '">x</a></nav>' END AS html
  FROM made m JOIN (
    SELECT e.project, e.i, string_agg(
             '<a href="' || replace(t.url, '&', '&amp;') || '">' || e.j || '</a> ', '' ORDER BY e.pos
           ) AS anchors
    FROM edges e JOIN made t ON t.project = e.project AND t.i = e.j GROUP BY ALL
  ) l ON l.project = m.project AND l.i = m.i)""", f"""site_links AS (
  SELECT project, i, src_url, pos, {normal('link')} AS dst_url FROM (
    SELECT project, i, url AS src_url, (k - 1)::INTEGER AS pos, {resolve('hs[k]', 'url')} AS link
    FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS k
          FROM (SELECT *, {href_list('html')} AS hs FROM site WHERE html IS NOT NULL))))"""

BASES = f"""bases AS (
  SELECT project, url AS base_url, {netloc('url')} AS base_netloc FROM site WHERE i = 0)"""


def crawl_ctes(max_pages: int, max_depth: int) -> list[str]:
    """``queue``: the walk level by level; ``site_links`` gains what the filter needs."""
    ctes = [*SITE, BASES, f"""targets AS (
      SELECT l.project, src_url, pos, dst_url, {netloc('dst_url')} AS dst_netloc, base_netloc,
             {relevant('dst_url', 'base_url')} AS relevant
      FROM site_links l JOIN bases b ON b.project = l.project)""",
        """level_0 AS (
      SELECT project, base_url AS url, true AS wanted, 0 AS depth, 0::BIGINT AS queue_rank FROM bases)"""]
    for depth in range(max_depth + 1):
        earlier = " UNION ALL ".join(f"SELECT * FROM visit_{d}" for d in range(depth))
        before = f"SELECT count(*) FROM ({earlier}) p WHERE p.project = t.project AND p.status = 'stored'"
        ctes.append(f"""visit_{depth} AS (
          SELECT project, url, wanted, depth, queue_rank,
                 CASE WHEN before >= {max_pages} THEN 'not_visited' WHEN NOT wanted THEN 'irrelevant'
                      WHEN NOT fetched THEN 'failed' ELSE 'stored' END AS status,
                 CASE WHEN before < {max_pages} AND wanted AND fetched THEN before END AS page_rank
          FROM (
            SELECT *, ({before if depth else 'SELECT 0'}) + coalesce(sum((wanted AND fetched)::INTEGER)
                     OVER (PARTITION BY project ORDER BY queue_rank
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM (SELECT l.*, EXISTS (SELECT 1 FROM site s WHERE s.url = l.url AND s.html IS NOT NULL)
                              AS fetched FROM level_{depth} l) t) t)""")
        queued = " UNION ALL ".join(f"SELECT * FROM visit_{d}" for d in range(depth + 1))
        ctes.append(f"""level_{depth + 1} AS (
          SELECT project, url, wanted, {depth + 1} AS depth,
                 (SELECT count(*) FROM ({queued}) q WHERE q.project = n.project)
                 + row_number() OVER (PARTITION BY project ORDER BY place) - 1 AS queue_rank
          FROM (
            SELECT v.project, dst_url AS url, relevant AS wanted, min([queue_rank, pos]) AS place
            FROM visit_{depth} v JOIN targets ON src_url = v.url
            WHERE status = 'stored' AND dst_netloc IN ('', base_netloc) {'AND relevant' if depth else ''}
              AND NOT EXISTS (SELECT 1 FROM ({queued}) q
                              WHERE q.project = v.project AND q.url = dst_url)
            GROUP BY v.project, dst_url, relevant) n)""")
    everything = " UNION ALL ".join(f"SELECT * FROM visit_{d}" for d in range(max_depth + 1))
    ctes.append(f"queue AS ({everything})")
    return ctes


SUMMARY = f"""SELECT b.project,
  (SELECT count(*) FROM queue q WHERE q.project = b.project AND status = 'stored') AS pages_scraped,
  (SELECT count(*) FROM seen s WHERE s.project = b.project) AS links_found,
  (SELECT count(*) FROM queue q WHERE q.project = b.project) - 1
    + (SELECT count(*) FROM level_{TO_THE_END + 1} l WHERE l.project = b.project) AS links_added,
  (SELECT count(*) FROM seen s WHERE s.project = b.project AND (
     s.dst_netloc NOT IN ('', s.base_netloc)
     OR (s.depth > 0 AND NOT s.relevant AND NOT EXISTS (
       SELECT 1 FROM queue q WHERE q.project = s.project AND q.url = s.dst_url
         AND q.status <> 'not_visited' AND q.queue_rank <= s.queue_rank)))) AS links_filtered,
  (SELECT count(*) FROM queue q WHERE q.project = b.project AND status <> 'not_visited') AS urls_visited
FROM bases b"""

SEEN = """seen AS (
  SELECT q.project, q.depth, q.queue_rank, t.dst_url, t.dst_netloc, t.base_netloc, t.relevant
  FROM queue q JOIN targets t ON t.src_url = q.url WHERE q.status = 'stored')"""

ARTICLES = f"""articles AS (
  SELECT page_id, {netloc('url')} AS host,
         {visible('html')} AS text
  FROM pages)"""

DOCUMENTS = """source_pages AS (
  SELECT source AS project, 'https://' || source || '.example.com/docs' AS base_url,
         'https://' || source || '.example.com/docs/' || doc_id AS url, doc_id AS page_rank, text
  FROM documents)"""
DOCUMENT_CHUNKS = [DOCUMENTS, *chunk_ctes("source_pages", "project, base_url, url, page_rank"),
    """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY page_rank, chunk_pos) - 1 AS n
  FROM chunks)"""]

CORPUS = ["corpus_pages AS (SELECT doc_id, text FROM documents)",
    *chunk_ctes("corpus_pages", "doc_id"),
    """corpus AS (
  SELECT (row_number() OVER (ORDER BY doc_id, chunk_pos) - 1)::VARCHAR AS id, document,
         'https://corpus.example.com/docs' AS source FROM chunks)""",
    *vector_ctes("corpus", "id", "document", "corpus_vectors")]


def answer_ctes(queries: str, top_k: int, vectors: str = "") -> list[str]:
    """``answers`` of ``queries(query_id, text)``, and of ``vectors``, from the collection of all documents."""
    more = f" UNION ALL {vectors}" if vectors else ""
    return [*CORPUS, *vector_ctes(queries, "query_id", "text", "query_vectors"), f"""answers AS (
      SELECT query_id, rank, id, distance, document, source FROM (
        SELECT query_id, id, distance,
               row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank
        FROM (SELECT query_id, id, {distance('c.embedding', 'q.embedding')} AS distance
              FROM (SELECT query_id, embedding FROM query_vectors{more}) q CROSS JOIN corpus_vectors c)) JOIN corpus USING (id)
      WHERE rank <= {top_k})"""]


TEXTS = "texts AS (SELECT item_id AS query_id, text FROM benchmark)"
PLAIN = """plain AS (
  SELECT md5('https://' || source || '.example.com/docs') AS collection_name, doc_id,
         doc_id::VARCHAR AS id, text FROM documents)"""
HOSTS = f"hosts AS (SELECT {netloc('url')} AS host, url, html FROM pages)"
MIXED = """mixed AS (
  SELECT 'text' AS kind, item_id * 4 AS query_id, text, 64 AS dimension FROM benchmark
  UNION ALL SELECT 'vector', vec_id * 4 + 1, NULL, 64 FROM embeddings
  UNION ALL SELECT 'short', vec_id * 4 + 2, NULL, 3 FROM embeddings
  UNION ALL SELECT 'document', doc_id * 4 + 3, CASE WHEN lang = 'en' THEN text END,
                   CASE WHEN lang = 'en' THEN 64 END FROM documents)"""
MIXED_ERROR = """CASE WHEN dimension IS NULL THEN 'invalid_query'
  WHEN dimension <> 64 THEN 'dimension_mismatch' END"""

SITE_CHUNKS = [*crawl_ctes(NO_LIMIT, TO_THE_END), f"""stored_pages AS (
  SELECT q.project, q.page_rank, q.url, {visible('html')} AS text
  FROM queue q JOIN site USING (url) WHERE status = 'stored')""",
    *chunk_ctes("stored_pages", "project, page_rank, url"), """site_chunks AS (
  SELECT md5(base_url) AS collection_name, chunks.project,
         (row_number() OVER (PARTITION BY chunks.project ORDER BY page_rank, chunk_pos) - 1)::VARCHAR AS id,
         document, url AS page_url, chunk_pos::INTEGER AS chunk_pos, base_url AS source
  FROM chunks JOIN bases ON bases.project = chunks.project)"""]


def _urls(select: str) -> str:
    return _with(LINKS, URLS, select=f"SELECT url, pos, {select} FROM urls")


def _audit() -> str:
    same = f"list_filter(ls, lambda l: {netloc('l')} = '' OR {netloc('l')} = host)"
    return _with(
        f"""found AS (
          SELECT url, {netloc('url')} AS host,
                 list_transform({href_list('html')}, lambda h: {resolve('h', 'url')}) AS ls
          FROM pages)""",
        f"""sorted AS (
          SELECT url, ls, len({same}) AS same,
                 list_transform(({same})[1:50], lambda l: {normal('l')}) AS firsts FROM found)""",
        f"""judged AS (
          SELECT *, list_filter(firsts, lambda l: {relevant('l', 'url')}) AS good,
                 list_filter(firsts, lambda l: NOT {relevant('l', 'url')}) AS bad FROM sorted)""",
        select="""SELECT url, len(ls)::INTEGER AS links_total, same::INTEGER AS same_domain,
          (len(ls) - same)::INTEGER AS different_domain, len(good)::INTEGER AS passed,
          len(bad)::INTEGER AS filtered_out,
          array_to_string(good[1:10], ' ') AS passed_examples,
          array_to_string(bad[1:10], ' ') AS filtered_examples FROM judged""",
    )


def _batches(size: int) -> str:
    return _with(*DOCUMENT_CHUNKS, select=f"""
      SELECT project, n // {size} AS batch_no, count(*) AS texts, min(n) AS first_text,
             max(n) AS last_text FROM numbered GROUP BY ALL""")


SIZES = _with(*DOCUMENT_CHUNKS, "sized AS (SELECT page_rank AS doc_id, chunk_pos::INTEGER AS chunk_pos,"
    " [length(document), len(string_split(document, ' '))]::FLOAT[] AS v FROM chunks)",
    select=numbers("sized", "doc_id, chunk_pos", "v"))

ORACLE = {
    "scan_pages": "SELECT page_id, url, html FROM pages",
    "scan_projects": _with(PROJECTS, f"""wanted AS (
        SELECT DISTINCT {_BARE.format(netloc('url'))} AS name FROM pages)""", select="""
      SELECT w.name, url, collection_name, store_path, embedding_provider,
             CASE WHEN p.name IS NULL THEN 'project_not_found' END AS error
      FROM wanted w LEFT JOIN projects p ON p.name = w.name"""),
    "write_projects": _with(PROJECTS, select="SELECT * FROM projects"),
    "write_collection": _with(RECORDS, select="""
      SELECT collection_name, id, document, source, page_url, chunk_pos,
             len(embedding)::INTEGER AS dimension FROM records"""),
    "scan_collection": _with(RECORDS, select=numbers("records", "collection_name, id")),
    "open_collection": _with(RECORDS, select="""SELECT collection_name, id FROM records
      WHERE collection_name = (SELECT min(collection_name) FROM records)"""),
    "pick_collection": _with(RECORDS, select="SELECT min(collection_name) AS collection_name FROM records"),
    "url_parts": _urls(f"""{scheme('link')} AS scheme, {netloc('link')} AS netloc,
      {path('link')} AS path, {query('link')} AS query, {fragment('link')} AS fragment"""),
    "url_normalize": _urls(f"{normal('link')} AS normalized"),
    "same_domain": _urls(f"{netloc(normal('link'))} IN ('', {netloc('base')}) AS same"),
    "allowed_host": _urls(f"{allowed('link', 'base')} AS allowed"),
    "non_root_path": _urls(f"{deep('link')} AS deep"),
    "asset_block": _urls(f"{asset('link')} AS asset"),
    "keyword_block": _urls(f"{blocked('link')} AS blocked"),
    "relevant_docs_url": _urls(f"{relevant('link', 'base')} AS relevant"),
    "project_url_lint": f"""SELECT {netloc('url')} AS name, url,
      ({lint('url')}) IS NOT NULL AS looks_specific, {lint('url')} AS suggested_url FROM pages""",
    "collection_name": "SELECT page_id, md5(url) AS collection_name FROM pages",
    "extract_links": _with(LINKS, select="SELECT url AS src_url, pos, href FROM links"),
    "resolve_links": _with(LINKS, select=f"""
      SELECT url AS src_url, pos, href, {resolve('href', 'url')} AS link_url FROM links"""),
    "link_audit": _audit(),
    "link_graph": _with(LINKS, PROJECTS, f"""edges AS (
      SELECT url AS src_url, pos, {normal(f"({resolve('href', 'url')})")} AS dst_url FROM links)""",
      select=f"""SELECT name AS project, src_url, pos, dst_url FROM edges JOIN projects
        ON name = {netloc('src_url')} WHERE {netloc('dst_url')} IN ('', name)"""),
    "crawl_bfs": _with(*crawl_ctes(NO_LIMIT, TO_THE_END), select="""
      SELECT project, url, depth, page_rank FROM queue WHERE status = 'stored'"""),
    "visited_dedup": _with(*SITE, select="""
      SELECT project, dst_url, (min([i, pos]))[1] AS i, (min([i, pos]))[2]::INTEGER AS pos
      FROM site_links GROUP BY project, dst_url"""),
    "depth_limit": _with(*crawl_ctes(NO_LIMIT, 1), select="""
      SELECT project, url, depth, queue_rank, status FROM queue"""),
    "page_limit": _with(*crawl_ctes(12, 5), select="""
      SELECT project, url, depth, queue_rank, page_rank, status FROM queue"""),
    "fetch_status": _with(*SITE, select="""
      SELECT dst_url AS url, CASE WHEN EXISTS (SELECT 1 FROM site s WHERE s.url = d.dst_url
        AND html IS NOT NULL) THEN 'fetched' ELSE 'failed' END AS status
      FROM (SELECT DISTINCT dst_url FROM site_links) d"""),
    "crawl_summary": _with(*crawl_ctes(NO_LIMIT, TO_THE_END), SEEN, select=SUMMARY),
    "scrape_report": _with(*crawl_ctes(NO_LIMIT, TO_THE_END), f"""texts AS (
      SELECT q.project, page_rank, url, {visible('html')} AS text
      FROM queue q JOIN site USING (url) WHERE status = 'stored')""", select=r"""
      SELECT project, page_rank + 1 AS page_number, url, length(text)::INTEGER AS text_chars,
             trim(replace(substr(text, 1, 300), chr(10), ' ')) AS preview FROM texts"""),
    "visible_text": f"SELECT page_id, {visible('html')} AS text FROM pages",
    "clean_text": f"SELECT doc_id, {clean('text')} AS text FROM documents",
    "chunk_words": _with(*chunk_ctes("documents", "doc_id"), select="""
      SELECT doc_id, chunk_pos::INTEGER AS chunk_pos, document FROM chunks"""),
    "drop_empty": _with(ARTICLES, *chunk_ctes("articles", "page_id"), select="""
      SELECT page_id, chunk_pos::INTEGER AS chunk_pos, document FROM chunks"""),
    "flatten_chunks": _with(*DOCUMENT_CHUNKS, select="""
      SELECT project, url, page_rank, chunk_pos::INTEGER AS chunk_pos, document FROM chunks"""),
    "chunk_ids": _with(*DOCUMENT_CHUNKS, select="""
      SELECT project, page_rank, chunk_pos::INTEGER AS chunk_pos, n::VARCHAR AS id FROM numbered"""),
    "chunk_metadata": _with(*DOCUMENT_CHUNKS, select="""
      SELECT md5(base_url) AS collection_name, n::VARCHAR AS id, base_url AS source,
             url AS page_url, chunk_pos::INTEGER AS chunk_pos FROM numbered"""),
    "empty_corpus": _with(ARTICLES, *chunk_ctes("articles", "page_id, host"), select="""
      SELECT h.host AS project, count(c.host) AS chunk_count,
             CASE WHEN count(c.host) > 0 THEN 'indexed' ELSE 'no_content' END AS status
      FROM (SELECT DISTINCT host FROM articles) h LEFT JOIN chunks c ON c.host = h.host
      GROUP BY h.host"""),
    "corpus_stats": _with(HOSTS, select=f"""
      SELECT host, count(*) AS pages, sum(length(html))::BIGINT AS html_chars,
             sum(length({visible('html')}))::BIGINT AS text_chars,
             max(length({visible('html')}))::INTEGER AS longest_text FROM hosts GROUP BY host"""),
    "embed_texts": _with(*DOCUMENT_CHUNKS, "keyed AS (SELECT page_rank * 1000000 + chunk_pos AS k,"
      " document FROM chunks)", *vector_ctes("keyed", "k", "document", "vectors"),
      "split AS (SELECT k // 1000000 AS doc_id, (k % 1000000)::INTEGER AS chunk_pos, embedding"
      " FROM vectors)", select=numbers("split", "doc_id, chunk_pos")),
    "embed_batches": _batches(128),
    "embed_batch_calls": _with(*DOCUMENT_CHUNKS, select="""
      SELECT project, n AS number, n // 32 AS batch_no, (n % 32)::INTEGER AS batch_pos,
             least(32, count(*) OVER (PARTITION BY project) - n // 32 * 32)::INTEGER AS batch_texts
      FROM numbered"""),
    "embed_cached": _with(*DOCUMENT_CHUNKS, select="""
      SELECT page_rank AS doc_id, chunk_pos::INTEGER AS chunk_pos, length(document)::INTEGER AS characters,
             CASE WHEN max(CASE WHEN page_rank IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END) OVER (PARTITION BY document) = 1
                  THEN 1 ELSE 2 END AS made_in
      FROM chunks"""),
    "embed_batch_size": SIZES,
    "embed_retry": SIZES,
    "embed_validate": """
      SELECT source, count(*) AS records, count(*) FILTER (embedding IS NULL) AS missing,
             count(*) FILTER (embedding IS NOT NULL AND lang = 'fr') AS wrong_size,
             count(*) FILTER (embedding IS NOT NULL AND lang <> 'fr'
               AND len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS not_finite,
             count(*) FILTER (embedding IS NOT NULL AND lang <> 'fr'
               AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0) AS valid
      FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY source""",
    "provider_info": _with(RECORDS, select="""
      SELECT collection_name, count(*) AS record_count, 'hashed' AS provider_name,
             'hashed-words' AS provider_model, 128 AS provider_batch_size
      FROM records GROUP BY collection_name"""),
    "provider_mismatch": """
      WITH asked AS (
        SELECT item_id, item_id % 10 AS label, (SELECT count(*) FROM embeddings e WHERE e.label = item_id % 10) AS n FROM benchmark
      ), judged AS (
        SELECT *, CASE WHEN n = 0 THEN 'unknown_collection' WHEN label % 2 = 1 THEN 'provider_mismatch' END AS error FROM asked
      )
      SELECT item_id AS query_id, error, CASE WHEN error IS NULL THEN least(n, 2) ELSE 0 END AS results FROM judged""",
    "embed_queries": _with(TEXTS, *vector_ctes("texts", "query_id", "text", "vectors"),
      select=numbers("vectors", "query_id")),
    "embed_input_check": """SELECT doc_id,
      CASE WHEN lang <> 'en' THEN 'text_is_null' END AS error FROM documents""",
    "attach_embeddings": """
      SELECT doc_id, source, CASE WHEN embedding IS NULL THEN 'missing_vector' END AS error,
             embedding[1] AS first_number, embedding[-1] AS last_number
      FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "collection_add": _with(PLAIN, select="""
      SELECT collection_name, id, CASE WHEN doc_id IN (SELECT doc_id FROM labels)
             THEN 'labelled' ELSE text END AS document FROM plain"""),
    "knn": _with(RECORDS, select=f"""
      SELECT id, {distance('embedding', 'list_resize(NULL::DOUBLE[], 64, 0.125)')} AS distance
      FROM records ORDER BY distance, id LIMIT 20""".replace(
        "list_resize(NULL::DOUBLE[], 64, 0.125)", "[0.125 FOR x IN range(64)]")),
    "knn_cells": "SELECT count(*) AS queries, TRUE AS recall_reached FROM embeddings",
    "knn_batch": _with("ranked AS (SELECT q.vec_id AS query_id, c.vec_id::VARCHAR AS id, "
      f"{distance('c.embedding', 'q.embedding')} AS distance FROM embeddings q, embeddings c)",
      select="""SELECT query_id, rank, id, distance FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank
        FROM ranked) WHERE rank <= 5"""),
    "knn_projection": _with(TEXTS, *answer_ctes("texts", 5), select="""
      SELECT query_id, rank, document, source, distance FROM answers"""),
    "collection_delete": _with(PLAIN, select="""
      SELECT collection_name, id, text AS document FROM plain
      WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""),
    "collection_clear": _with(RECORDS, select="""
      SELECT collection_name, count(*) AS record_count FROM records
      WHERE collection_name > (SELECT min(collection_name) FROM records) GROUP BY ALL"""),
    "collection_count": _with(RECORDS, select="""
      SELECT collection_name, count(*) AS record_count FROM records GROUP BY ALL"""),
    "collection_info": _with(RECORDS, """names AS (
      SELECT DISTINCT 'label' || label AS name FROM embeddings
      UNION SELECT DISTINCT source FROM documents)""", """named AS (
      SELECT name, 'https://' || name || '.example.com' AS url FROM names)""", select="""
      SELECT name, md5(url) AS collection_name, url, count(id) AS record_count,
             max(len(embedding))::INTEGER AS dimension
      FROM named LEFT JOIN records ON collection_name = md5(url) GROUP BY ALL"""),
    "results_raw": _with(TEXTS, *answer_ctes("texts", 20), select="""
      SELECT query_id, string_agg(id, ' ' ORDER BY rank) AS ids, min(distance) AS nearest,
             max(distance) AS farthest, string_agg(document, '|' ORDER BY rank) AS documents,
             min(source) AS source FROM answers GROUP BY query_id"""),
    "results_shaped": _with(TEXTS, *answer_ctes("texts", 5), select="""
      SELECT query_id, rank, id, distance AS score, document, source FROM answers"""),
    "results_report": _with(TEXTS, *answer_ctes("texts", 5), select="""
      SELECT query_id, rank, id, distance, substr(document, 1, 1000) AS excerpt, source FROM answers"""),
    "query_dispatch": _with(MIXED, select=f"""
      SELECT kind, query_id, dimension, {MIXED_ERROR} AS error FROM mixed"""),
    "add_projects": _with(PROJECTS, f"""offered AS (
      SELECT name, url FROM projects UNION SELECT {netloc('url')}, url FROM pages)""", select="""
      SELECT name, url, md5(url) AS collection_name,
             'store/collection_name=' || md5(url) AS store_path,
             NULL::VARCHAR AS embedding_provider,
             CASE WHEN name LIKE 'blog.%' OR url > min(url) OVER (PARTITION BY name)
                  THEN 'project_exists' END AS reason FROM offered"""),
    "list_projects": _with(PROJECTS, HOSTS, """stored AS (
      SELECT host, count(*) AS n FROM hosts WHERE host NOT LIKE 'm.%' GROUP BY host)""", select="""
      SELECT name, url, collection_name, CASE WHEN host IS NULL THEN 'Not indexed'
        WHEN host LIKE 'blog.%' THEN 'Index may be incomplete'
        ELSE 'Indexed (' || n || ' documents)' END AS status
      FROM projects LEFT JOIN stored ON host = name ORDER BY name"""),
    "resolve_provider": _with(PROJECTS, select="""
      SELECT name, coalesce(embedding_provider, 'openai') AS provider,
             coalesce(embedding_provider, 'lookup') AS shared FROM projects"""),
    "index_documentation": _with(*SITE_CHUNKS, select="""
      SELECT collection_name, id, document, page_url, chunk_pos, source FROM site_chunks"""),
    "search_docs": _with(MIXED, "texts AS (SELECT query_id, text FROM mixed WHERE text IS NOT NULL)",
      *answer_ctes("texts", 5, "SELECT vec_id * 4 + 1, embedding FROM embeddings"), select=f"""
      SELECT query_id, rank, id, distance AS score, document, NULL::VARCHAR AS error FROM answers
      UNION ALL SELECT query_id, NULL, NULL, NULL, NULL, {MIXED_ERROR} FROM mixed
      WHERE ({MIXED_ERROR}) IS NOT NULL"""),
    "index_and_search": _with(*SITE_CHUNKS,
      "keyed AS (SELECT project || '/' || id AS k, document FROM site_chunks)",
      *vector_ctes("keyed", "k", "document", "chunk_vectors"), TEXTS,
      *vector_ctes("texts", "query_id", "text", "query_vectors"), f"""ranked AS (
      SELECT query_id, s.id, document, source, distance,
             row_number() OVER (PARTITION BY query_id ORDER BY distance, s.id)::INTEGER AS rank
      FROM (SELECT q.query_id, s.id, s.document, s.source,
                   {distance('v.embedding', 'q.embedding')} AS distance
            FROM query_vectors q JOIN site_chunks s ON s.project = q.query_id % 4
            JOIN chunk_vectors v ON v.k = s.project || '/' || s.id) s)""", select="""
      SELECT query_id, rank, id, distance, substr(document, 1, 1000) AS excerpt, source
      FROM ranked WHERE rank <= 5"""),
}
