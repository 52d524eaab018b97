"""The same queries as SQL for DuckDB, formulated on their own over the benchmark tables."""

from __future__ import annotations

from collections.abc import Sequence

from feedlake.functions import lexicons as lex
from feedlake.plans.catalog import KEYWORDS, NEGATIVE, PERSIAN_STANDIN, POSITIVE, STOP, WEIGHTS

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NL = r"(\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}])"
NON_WORD = r"[^\p{L}\p{N}_]+"
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
PERSIAN = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values: Sequence[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def one_line(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def no_tags(c: str) -> str:
    return f"regexp_replace({c}, '<[^>]+>', '', 'g')"


def lines(c: str) -> str:
    each = f"list_transform(string_split_regex({no_tags(c)}, '{NL}'), lambda x: {one_line('x')})"
    return f"array_to_string(list_filter({each}, lambda x: x <> ''), chr(10))"


def strip(c: str) -> str:
    return f"trim({c}, {text(SPACES)})"


def tokens(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '{NON_WORD}'), lambda x: x <> '')"


def hits(tokens_sql: str, lexicon: Sequence[str]) -> str:
    return f"len(list_filter({tokens_sql}, lambda x: list_contains({words(lexicon)}, x)))"


def rounded(x: str, digits: int = 2) -> str:
    """Decimal text of the exact value, read back."""
    return f"CAST(format('{{:.{digits}f}}', {x}) AS DOUBLE)"


def ratio(p: str, n: str) -> str:
    return f"CASE WHEN {p} + {n} > 0 THEN CAST({p} - {n} AS DOUBLE) / CAST({p} + {n} AS DOUBLE) ELSE 0e0 END"


def label(r: str) -> str:
    return f"CASE WHEN {r} > 15e-2 THEN 'positive' WHEN {r} < -15e-2 THEN 'negative' ELSE 'neutral' END"


def iso(ts: str) -> str:
    return (
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN strftime({ts}, '%f') = '000000' THEN '' ELSE '.' || strftime({ts}, '%f') END"
    )


TITLE = "split_part(text, chr(10), 1)"
FETCHED = "TIMESTAMP '2024-01-01' + to_minutes(doc_id)"
LINK = "'https://example.org/d/' || CAST(CASE WHEN doc_id % 10 = 9 THEN doc_id // 2 ELSE doc_id END AS VARCHAR)"

SOURCES = """
sources AS (
  SELECT source AS id, 'Source ' || source AS name, 'https://example.org/feeds/' || source AS url,
         CAST(n % 3 + 1 AS INTEGER) AS priority, CAST(1 + (n % 2) * 0.5 AS DOUBLE) AS weight,
         CAST(n % 5 AS DOUBLE) / 4 AS reliability
  FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS n FROM documents)
)"""

ITEMS = f"""{SOURCES},
items AS (
  SELECT arrival, substr(sha256(e.url), 1, 16) AS id, source_id, name AS source_name, title,
         trim(regexp_replace(lower(title), '{WS}+', ' ', 'g')) AS norm_title, content, e.url AS url, fetched AS published_at,
         priority, weight, reliability
  FROM (SELECT doc_id AS arrival, source AS source_id, {TITLE} AS title, text AS content, {LINK} AS url,
               {FETCHED} AS fetched FROM documents) e
  JOIN sources s ON s.id = e.source_id
)"""

# Greedy groups: an item takes over the smallest group among those of the previous item
# with its id and the previous item with its title.
GREEDY = f"""{ITEMS},
nodes AS MATERIALIZED (
  SELECT arrival, lag(arrival) OVER (PARTITION BY id ORDER BY arrival) AS by_id,
         CASE WHEN norm_title <> '' THEN lag(arrival) OVER (PARTITION BY norm_title ORDER BY arrival) END AS by_title
  FROM items
),
edges AS MATERIALIZED (
  SELECT arrival AS child, by_id AS parent FROM nodes WHERE by_id IS NOT NULL
  UNION SELECT arrival, by_title FROM nodes WHERE by_title IS NOT NULL
),
reach AS (
  SELECT arrival AS x, arrival AS g FROM nodes WHERE by_id IS NULL AND by_title IS NULL
  UNION
  SELECT e.child, r.g FROM reach r JOIN edges e ON e.parent = r.x
),
groups AS (SELECT x AS arrival, min(g) AS group_id FROM reach GROUP BY x)"""

TRANSITIVE = f"""{ITEMS},
nodes AS MATERIALIZED (
  SELECT arrival, lag(arrival) OVER (PARTITION BY id ORDER BY arrival) AS by_id,
         CASE WHEN norm_title <> '' THEN lag(arrival) OVER (PARTITION BY norm_title ORDER BY arrival) END AS by_title
  FROM items
),
links AS MATERIALIZED (
  SELECT arrival AS a, by_id AS b FROM nodes WHERE by_id IS NOT NULL
  UNION SELECT arrival, by_title FROM nodes WHERE by_title IS NOT NULL
  UNION SELECT by_id, arrival FROM nodes WHERE by_id IS NOT NULL
  UNION SELECT by_title, arrival FROM nodes WHERE by_title IS NOT NULL
),
reach AS (
  SELECT arrival AS x, arrival AS g FROM nodes
  UNION
  SELECT l.b, r.g FROM reach r JOIN links l ON l.a = r.x
),
groups AS (SELECT x AS arrival, min(g) AS group_id FROM reach GROUP BY x)"""

BY_TITLE = f"{ITEMS}, groups AS (SELECT arrival, min(arrival) OVER (PARTITION BY CASE WHEN norm_title = '' THEN CAST(arrival AS VARCHAR) ELSE 't' || norm_title END) AS group_id FROM items)"

RANKED = """
ranked AS (
  SELECT i.*, group_id,
         row_number() OVER (PARTITION BY group_id ORDER BY priority DESC, weight DESC, reliability DESC, arrival) AS place
  FROM items i JOIN groups USING (arrival)
)"""

COMBINED = f"""{RANKED},
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY group_id, {strip('content')} ORDER BY place) AS copy FROM ranked
),
combined AS (
  SELECT group_id, string_agg(CASE WHEN place = 1 THEN content
           ELSE chr(10) || chr(10) || '--- [Alternative Content from ' || source_name || '] ---' || chr(10) || content END, '' ORDER BY place) AS content
  FROM firsts WHERE place = 1 OR (copy = 1 AND {strip('content')} <> '') GROUP BY group_id
)"""

STATUS = "CASE WHEN quality = 1 THEN 'completed' WHEN toxic = 1 THEN 'failed' ELSE 'pending' END"
ARTICLES = f"""
articles AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, source AS source_id, {TITLE} AS title, text AS content,
         'https://example.org/d/' || CAST(doc_id AS VARCHAR) AS original_url, {FETCHED} AS published_at,
         {STATUS} AS rewrite_status,
         CASE WHEN quality = 1 THEN '[edited] ' || {TITLE} END AS rewritten_content,
         CASE WHEN quality = 1 THEN 'pwa,rss' ELSE '' END AS published_outputs
  FROM documents LEFT JOIN labels USING (doc_id)
)"""
PAGE_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
UPDATES = f"""{ARTICLES},
updates AS (
  SELECT id, 'desk' AS source_id, title || ' (2)' AS title, content, original_url || '?v=2' AS original_url,
         published_at + INTERVAL 1 DAY AS published_at, 'completed' AS rewrite_status, '[again] ' || title AS rewritten_content
  FROM articles WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)
  UNION ALL
  SELECT 'p' || CAST(page_id AS VARCHAR), 'web', {PAGE_TITLE}, html, url, TIMESTAMP '2024-06-01', 'pending', NULL FROM pages
)"""

USERS = """
users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS username,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' WHEN c_mktsegment <> 'FURNITURE' THEN 'viewer' END AS role
  FROM customer
)"""
CENTS = "CAST(value AS DECIMAL(12,2))"
CHANNELS = (
    "CASE WHEN rewrite_status = 'completed' THEN concat_ws(',', CASE WHEN length(title) > 100 THEN 'eitaa' END, 'pwa', "
    "CASE WHEN source_id <> 'src3' THEN 'rss' END) ELSE '' END"
)
PREFIX = "'Edited: ' || "


def tags(title: str, content: str) -> str:
    low = f"lower({title} || ' ' || {content})"
    parts = []
    for tag, keys in KEYWORDS.items():
        found = " OR ".join(f"contains({low}, {text(k)})" for k in keys)
        parts.append(f"CASE WHEN {found} THEN {text(tag)} END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def signals(source: str, weights: dict[str, float]) -> str:
    """``source`` gives id, text and score."""
    total = " + ".join(f"CASE WHEN contains(lower(text), {text(w)}) THEN {v}::DOUBLE ELSE 0e0 END" for w, v in weights.items())
    found = ", ".join(f"CASE WHEN contains(lower(text), {text(w)}) THEN {text(w)} END" for w in weights)
    return f"""
      SELECT id, priority, {rounded('least(3e-1 + u + s, 1e0)')} AS relevance_score,
             CASE WHEN priority >= 7e-1 THEN 'publish_immediately' WHEN priority >= 4e-1 THEN 'review_required'
                  ELSE 'standard_processing' END AS dispatch_route,
             {rounded('5e-1 + u * 5e-1 + s * 5e-1')} AS confidence, matched_triggers
      FROM (SELECT *, {rounded('least(2e-1 + u + s, 1e0)')} AS priority
            FROM (SELECT id, least({total}, 5e-1) AS u, abs(score) * 2e-1 AS s, concat_ws(',', {found}) AS matched_triggers FROM ({source})))"""


def hits_of(c: str, positive: Sequence[str], negative: Sequence[str]) -> str:
    return f"{hits(tokens(c), positive)} AS p, {hits(tokens(c), negative)} AS n"


def top_topics(rows: str) -> str:
    """``rows`` gives id and text; five topics of each, joined."""
    return f"""
      counted AS (
        SELECT id, term, count(*) AS n, min(pos) AS pos
        FROM (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT id, {tokens('text')} AS w FROM ({rows})))
        WHERE length(term) > 2 AND NOT list_contains({words(STOP)}, term) AND NOT regexp_full_match(term, '\\p{{Nd}}+')
        GROUP BY id, term
      ),
      topics AS (
        SELECT id, term, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, pos) AS place FROM counted)
        WHERE place <= 5
      )"""


def sentences(c: str) -> str:
    return f"len(list_filter(string_split_regex({c}, '[.!?\\x{{6D4}}]'), lambda x: {strip('x')} <> ''))"


def word_list(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{WS}+'), lambda x: x <> '')"


def _queries() -> dict[str, str]:
    q: dict[str, str] = {}
    clean = "id, source_id, title, content, url, published_at"

    q["aggregate_sources_priority"] = f"WITH RECURSIVE {GREEDY}, {RANKED} SELECT {clean} FROM ranked WHERE place = 1"
    q["aggregate_sources_transitive"] = f"WITH RECURSIVE {TRANSITIVE}, {RANKED} SELECT {clean} FROM ranked WHERE place = 1"
    q["aggregate_sources_combine"] = (
        f"WITH RECURSIVE {GREEDY}, {COMBINED} SELECT r.id, r.source_id, r.title, c.content, r.url, r.published_at "
        "FROM ranked r JOIN combined c USING (group_id) WHERE r.place = 1"
    )
    q["combined_pieces"] = f"""WITH RECURSIVE {GREEDY}, {COMBINED} SELECT group_id,
      row_number() OVER (PARTITION BY group_id ORDER BY place) - 1 AS position,
      CASE WHEN place = 1 THEN content ELSE chr(10) || chr(10) || '--- [Alternative Content from ' || source_name || '] ---' || chr(10) || content END AS piece
      FROM firsts WHERE place = 1 OR (copy = 1 AND {strip('content')} <> '')"""
    q["aggregate_sources_pieces"] = f"""WITH RECURSIVE {GREEDY}, {COMBINED} SELECT group_id,
      row_number() OVER (PARTITION BY group_id ORDER BY f.place) - 1 AS position, r.id, r.source_id, r.title, r.url, r.published_at,
      CASE WHEN f.place = 1 THEN f.content ELSE chr(10) || chr(10) || '--- [Alternative Content from ' || f.source_name || '] ---' || chr(10) || f.content END AS piece
      FROM firsts f JOIN ranked r USING (group_id) WHERE r.place = 1 AND (f.place = 1 OR (f.copy = 1 AND {strip('f.content')} <> ''))"""
    q["merge_by_title_priority"] = (
        f"WITH {BY_TITLE}, {RANKED} SELECT norm_title AS group_key, id, source_id, content FROM ranked WHERE place = 1"
    )
    # The grouping key replaces the id, but merging keeps the items' own ids.
    q["merge_by_title_combine"] = (
        f"WITH {BY_TITLE}, {COMBINED} SELECT r.norm_title AS group_key, r.id, r.source_id, c.content "
        "FROM ranked r JOIN combined c USING (group_id) WHERE r.place = 1"
    )
    q["duplicate_groups"] = f"WITH RECURSIVE {GREEDY} SELECT arrival, group_id FROM groups"
    q["duplicate_report"] = f"""WITH RECURSIVE {GREEDY}, {RANKED}
      SELECT group_id, count(*) AS n_items, count(DISTINCT source_id) AS n_sources,
             max(CASE WHEN place = 1 THEN id END) AS id, max(CASE WHEN place = 1 THEN title END) AS title
      FROM ranked GROUP BY group_id HAVING count(*) > 1"""
    q["dedup_exact"] = "SELECT min(doc_id) AS doc_id, sha256(text) AS content_sha FROM documents GROUP BY text"
    q["article_ids"] = f"""SELECT substr(sha256(url), 1, 16) AS id, url
      FROM (SELECT {LINK} AS url FROM documents UNION ALL SELECT url FROM pages)"""
    q["enabled_sources"] = f"WITH {SOURCES} SELECT id, name, priority, weight, reliability AS reliability_score FROM sources WHERE reliability > 0"
    q["raw_items"] = f"""WITH {ITEMS}
      SELECT arrival, id, source_id, source_name, priority AS source_priority, weight AS source_weight,
             reliability AS source_reliability_score, title, content, url, {iso('published_at')} AS published_at
      FROM items WHERE reliability > 0"""
    q["clean_items"] = f"WITH {ITEMS} SELECT {clean} FROM items"
    q["source_stats"] = f"""WITH {SOURCES},
      log AS (SELECT 'src' || CAST(user_id % 20 AS VARCHAR) AS id, event_id, ts, event_type <> 'error' AS ok FROM events),
      per AS (SELECT id, count(*) AS runs, count(*) FILTER (ok) AS good, max(ts) FILTER (ok) AS last_good FROM log GROUP BY id),
      last AS (SELECT id, ok, event_id FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1)
      SELECT s.id, s.reliability > 0 AS enabled,
             CASE WHEN s.reliability > 0 THEN coalesce(runs, 0) ELSE 0 END AS fetch_count,
             CASE WHEN s.reliability > 0 THEN coalesce(good, 0) ELSE 0 END AS success_count,
             CASE WHEN s.reliability > 0 THEN coalesce(runs - good, 0) ELSE 0 END AS failure_count,
             CASE WHEN s.reliability > 0 AND runs IS NOT NULL THEN CAST(good AS DOUBLE) / CAST(runs AS DOUBLE) ELSE s.reliability END AS reliability_score,
             CASE WHEN s.reliability > 0 AND NOT last.ok THEN 'event ' || CAST(last.event_id AS VARCHAR) END AS last_error,
             CASE WHEN s.reliability > 0 THEN {iso('last_good')} END AS last_fetched_at
      FROM sources s LEFT JOIN per USING (id) LEFT JOIN last USING (id)"""
    q["feed_xml_entries"] = f"""SELECT doc_id, 0 AS pos, {one_line('text')} AS title,
      'https://example.org/d/' || CAST(doc_id AS VARCHAR) AS link, '' AS description FROM documents"""

    q["normalize_text"] = f"SELECT doc_id, {one_line('text')} AS text_norm, {one_line(f'lower({TITLE})')} AS title_norm FROM documents"
    q["sanitize_pages"] = f"SELECT page_id, {one_line(no_tags(PAGE_TITLE))} AS title_clean, {lines('html')} AS content_clean FROM pages"
    q["sanitize_documents"] = f"SELECT doc_id, {lines('text')} AS content_clean FROM documents"
    q["render_template"] = f"SELECT doc_id, 'Title: ' || {TITLE} || chr(10) || 'Content: ' || text AS prompt FROM documents"
    q["prefix_templates"] = f"""SELECT conv_id, turn, {PREFIX} text AS prefixed,
      'Turn ' || CAST(turn AS VARCHAR) || ': ' || text AS processed FROM conversations"""
    q["summary_template"] = f"""SELECT doc_id, 'About ' || {TITLE} || chr(10) || text AS summary FROM documents"""
    q["rewrite_fallback"] = f"""SELECT conv_id, turn,
      CASE WHEN role = 'assistant' THEN {PREFIX} text ELSE '[Rewritten Failed - Fallback]: ' || text END AS text,
      role <> 'assistant' AS used_fallback FROM conversations"""
    q["header_and_tags"] = f"""WITH {ARTICLES}
      SELECT id, array_to_string(t, ',') AS tags,
             CASE WHEN headed <> '' AND len(t) > 0 THEN headed || chr(10) || chr(10) || 'Tags: #' || array_to_string(t, ' #') ELSE headed END AS rewritten_content
      FROM (SELECT id, {tags('title', 'content')} AS t,
                   CASE WHEN rewritten_content <> '' THEN 'EN' || chr(10) || rewritten_content ELSE rewritten_content END AS headed
            FROM articles)"""
    q["extract_completions"] = f"""SELECT conv_id, turn,
      CASE role WHEN 'assistant' THEN text WHEN 'user' THEN {strip('text')} END AS text,
      CASE WHEN role NOT IN ('assistant', 'user') THEN text END AS error FROM conversations"""
    q["mask_props"] = """SELECT event_id, '********' AS api_key, event_type AS kind, '********' AS extra_token,
      json_extract_string(props, '$.k') AS extra_plain, '********' AS item_password, user_id AS item_key_id FROM events"""

    q["tokens"] = f"SELECT doc_id, len(w) AS n_tokens, array_to_string(w, ' ') AS tokens FROM (SELECT doc_id, {tokens('text')} AS w FROM documents)"
    share = f"CAST(length(text) - length(regexp_replace(text, '{PERSIAN}', '', 'g')) AS DOUBLE) / CAST(length(text) AS DOUBLE)"
    share = f"CASE WHEN length(text) > 0 THEN {share} ELSE 0e0 END"
    q["language"] = f"""SELECT doc_id, letter_share,
      CASE WHEN letter_share > 15e-2 OR fa > en THEN 'fa' ELSE 'en' END AS language,
      CASE WHEN letter_share > 15e-2 OR alt > en THEN 'fa' ELSE 'en' END AS language_by_list
      FROM (SELECT doc_id, {share} AS letter_share, {hits('w', lex.PERSIAN_STOP_WORDS)} AS fa,
                   {hits('w', lex.ENGLISH_STOP_WORDS)} AS en, {hits('w', PERSIAN_STANDIN)} AS alt
            FROM (SELECT doc_id, text, {tokens('text')} AS w FROM documents))"""
    q["sentiment"] = f"""SELECT doc_id, p AS positive_hits, n AS negative_hits, r AS ratio, {rounded('r')} AS score, {label('r')} AS label
      FROM (SELECT *, {ratio('p', 'n')} AS r FROM (SELECT doc_id, {hits_of('text', POSITIVE, NEGATIVE)} FROM documents))"""
    q["readability"] = f"""SELECT doc_id, words AS words_count, CASE WHEN words > 0 THEN greatest(s, 1) ELSE 0 END AS sentences_count,
      CASE WHEN words > 0 THEN {rounded('CAST(letters AS DOUBLE) / CAST(words AS DOUBLE)', 1)} ELSE 0e0 END AS avg_word_length,
      CASE WHEN words > 0 THEN greatest(CAST(trunc((CAST(words AS DOUBLE) / 200e0) * 60e0) AS INTEGER), 1) ELSE 0 END AS estimated_reading_time_seconds
      FROM (SELECT doc_id, len(w) AS words, length(array_to_string(w, '')) AS letters, s
            FROM (SELECT doc_id, {word_list('text')} AS w, {sentences('text')} AS s FROM documents))"""
    docs = "SELECT doc_id AS id, text FROM documents"
    q["topics"] = f"""WITH {top_topics(docs)}
      SELECT doc_id, coalesce(t, '') AS topics FROM documents
      LEFT JOIN (SELECT id, string_agg(term, ',' ORDER BY place) AS t FROM topics GROUP BY id) ON id = doc_id"""
    q["topics_corpus"] = f"WITH {top_topics(docs)} SELECT lang, term, count(*) AS n FROM topics JOIN documents ON doc_id = id GROUP BY lang, term"
    order_text = "o_orderpriority || ' ' || o_orderstatus"
    scored = f"SELECT id, text, {rounded('r')} AS score FROM (SELECT *, {ratio('p', 'n')} AS r FROM (%s))"
    from_orders = scored % (
        f"SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id, {order_text} AS text, {hits_of(order_text, lex.POSITIVE_WORDS, lex.NEGATIVE_WORDS)} FROM orders"
    )
    from_docs = scored % f"SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text, {hits_of('text', POSITIVE, NEGATIVE)} FROM documents"
    q["agent_signals"] = f"{signals(from_orders, lex.URGENCY_WEIGHTS)} UNION ALL {signals(from_docs, WEIGHTS)}"
    full = f"SELECT doc_id AS id, {TITLE} || ' ' || text AS text FROM documents"
    full_scored = scored % f"SELECT id, text, {hits_of('text', POSITIVE, NEGATIVE)} FROM ({full})"
    q["analyze_documents"] = f"""WITH {top_topics(full)},
      sig AS ({signals(full_scored, WEIGHTS)}),
      base AS (SELECT id, text, {tokens('text')} AS w FROM ({full})),
      facts AS (SELECT id, {ratio('p', 'n')} AS r, words_count, sentences_count, language FROM (
        SELECT id, {hits('w', POSITIVE)} AS p, {hits('w', NEGATIVE)} AS n, len({word_list('text')}) AS words_count,
               greatest({sentences('text')}, 1) AS sentences_count,
               CASE WHEN {share} > 15e-2 OR {hits('w', lex.PERSIAN_STOP_WORDS)} > {hits('w', lex.ENGLISH_STOP_WORDS)} THEN 'fa' ELSE 'en' END AS language
        FROM base))
      SELECT f.id AS doc_id, language, {rounded('r')} AS score, {label('r')} AS label, words_count, sentences_count,
             coalesce(t, '') AS topics, priority, dispatch_route
      FROM facts f JOIN sig USING (id)
      LEFT JOIN (SELECT id, string_agg(term, ',' ORDER BY place) AS t FROM topics GROUP BY id) tt ON tt.id = f.id"""
    # The analysis filters topics with the English list, not the shorter list of the topic queries.
    q["analyze_documents"] = q["analyze_documents"].replace(words(STOP), words(lex.ENGLISH_STOP_WORDS))
    q["analyze_quality_join"] = f"""SELECT quality, label, count(*) AS n
      FROM (SELECT doc_id, {label('r')} AS label FROM (SELECT doc_id, {ratio('p', 'n')} AS r FROM (SELECT doc_id, {hits_of('text', POSITIVE, NEGATIVE)} FROM documents)))
      JOIN labels USING (doc_id) GROUP BY quality, label"""

    columns = "id, source_id, title, content, original_url, published_at, rewrite_status, rewritten_content"
    q["upsert_full"] = f"""WITH {UPDATES}
      SELECT {columns} FROM articles WHERE id NOT IN (SELECT id FROM updates) UNION ALL SELECT {columns} FROM updates"""
    q["upsert_partial"] = f"""WITH {UPDATES}
      SELECT a.id, a.source_id, coalesce(u.title, a.title) AS title, coalesce(u.content, a.content) AS content, a.original_url, a.published_at,
             coalesce(u.rewrite_status, a.rewrite_status) AS rewrite_status,
             CASE WHEN u.id IS NULL THEN a.rewritten_content ELSE u.rewritten_content END AS rewritten_content
      FROM articles a LEFT JOIN updates u USING (id)
      UNION ALL SELECT {columns} FROM updates WHERE id NOT IN (SELECT id FROM articles)"""
    q["delete_by_key"] = f"WITH {ARTICLES} SELECT id, title, rewrite_status FROM articles WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"
    q["skip_completed"] = f"WITH {ARTICLES} SELECT id, source_id, title FROM articles WHERE rewrite_status <> 'completed'"
    q["get_article"] = f"WITH {ARTICLES} SELECT {columns} FROM articles WHERE id = '7'"
    q["list_articles"] = f"""WITH {ARTICLES} SELECT id, source_id, title, content, original_url, rewritten_content, rewrite_status,
      published_outputs, {iso('published_at')} AS published_at FROM articles"""
    q["list_feed"] = f"""WITH {ARTICLES} SELECT id, title, content, original_url, rewritten_content, rewrite_status,
      {iso('published_at')} AS published_at FROM articles"""
    q["list_sources"] = f"""WITH {SOURCES} SELECT id, url, name, reliability > 0 AS enabled, priority, weight,
      reliability AS reliability_score, CAST(0 AS BIGINT) AS fetch_count FROM sources"""
    q["paginate_articles"] = f"""WITH {ARTICLES} SELECT id, title, content, {iso('published_at')} AS published_at, rewrite_status,
      (SELECT count(*) FROM articles) AS total FROM articles ORDER BY id LIMIT 10 OFFSET 20"""
    q["indexed_pages"] = f"""WITH {ARTICLES}, placed AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS total FROM articles)
      SELECT CAST(place // 10 + 1 AS INTEGER) AS page, id, title, content, {iso('published_at')} AS published_at, rewrite_status, total
      FROM placed WHERE place // 10 + 1 IN (3, (total + 9) // 10)"""
    q["paginate_after"] = f"WITH {ARTICLES} SELECT id, title FROM articles WHERE id > '2' ORDER BY id LIMIT 10"
    q["article_stats"] = """SELECT count(*) AS articles_total, count(*) FILTER (quality = 1) AS rewrites_completed,
      (SELECT count(DISTINCT source) FROM documents) AS sources_total FROM documents LEFT JOIN labels USING (doc_id)"""
    q["status_breakdown"] = f"WITH {ARTICLES} SELECT rewrite_status, count(*) AS n FROM articles GROUP BY rewrite_status"
    q["find_user"] = f"WITH {USERS} SELECT * FROM users WHERE username = 'Customer#000000042'"
    q["scan_users"] = f"WITH {USERS} SELECT * FROM users"
    q["evolve_schema"] = f"""WITH {SOURCES} SELECT id, name, CASE WHEN priority = 2 THEN 1 ELSE priority END AS priority,
      1e0 AS weight, CAST(0 AS BIGINT) AS fetch_count, true AS enabled FROM sources"""
    q["valid_sessions"] = f"""WITH {USERS},
      sessions AS (SELECT CAST(event_id AS VARCHAR) AS token, CAST(user_id AS VARCHAR) AS user_id,
        CASE WHEN json_extract_string(props, '$.k') <> '0' THEN ts + INTERVAL 24 HOUR END AS expires_at FROM events WHERE event_type = 'signup')
      SELECT token, user_id, username, role, {iso('expires_at')} AS expires_at FROM sessions JOIN users u ON u.id = user_id
      WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '2024-01-15 12:00:00'"""
    q["authorize_requests"] = f"""WITH {USERS},
      asked AS (SELECT event_id, CASE event_type WHEN 'view' THEN '/api/articles/' || CAST(event_id AS VARCHAR) WHEN 'click' THEN '/api/sources'
                  WHEN 'purchase' THEN '/api/stats' WHEN 'signup' THEN '/health' ELSE '/api/feed' END AS path,
                CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS user_id,
                CASE event_type WHEN 'view' THEN 'read:articles' WHEN 'click' THEN 'read:sources' WHEN 'purchase' THEN 'read:stats'
                  WHEN 'error' THEN 'read:articles' END AS permission FROM events)
      SELECT event_id, path, permission,
             CASE WHEN permission IS NULL THEN 200 WHEN u.id IS NULL THEN 401
                  WHEN coalesce(role, 'viewer') = 'admin' OR permission IN ('read:articles', 'read:stats') THEN 200 ELSE 403 END AS status
      FROM asked LEFT JOIN users u ON u.id = asked.user_id"""
    q["check_unique"] = f"SELECT {TITLE} AS title, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1"
    second = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
    q["parse_timestamps"] = f"""SELECT event_id, CASE WHEN event_type <> 'error' THEN {second} END AS parsed,
      CASE WHEN event_type <> 'error' THEN {second} ELSE '2000-01-01T00:00:00' END AS parsed_or_default FROM events"""

    q["metric_counters"] = f"SELECT event_type AS name, CAST(sum({CENTS}) AS DOUBLE) AS value FROM events GROUP BY event_type"
    newest = "row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1"
    q["metric_gauges"] = f"SELECT event_type AS name, CAST({CENTS} AS DOUBLE) AS value FROM events QUALIFY {newest}"
    timing = f"""timing AS (
      SELECT name, {rounded('last', 4)} AS last_duration_seconds, n AS executions_total, {rounded('total', 4)} AS duration_seconds_total,
             {rounded('total / CAST(n AS DOUBLE)', 4)} AS average_duration_seconds, {rounded('longest', 4)} AS max_duration_seconds
      FROM (SELECT event_type AS name, count(*) AS n, CAST(sum({CENTS}) AS DOUBLE) AS total, CAST(max({CENTS}) AS DOUBLE) AS longest,
                   CAST(arg_max({CENTS}, struct_pack(ts := ts, e := event_id)) AS DOUBLE) AS last FROM events GROUP BY event_type))"""
    q["timing_summary"] = f"WITH {timing} SELECT * FROM timing"
    faults = """faults AS (SELECT 'part' || CAST(user_id % 7 AS VARCHAR) AS component, 'user ' || CAST(user_id AS VARCHAR) AS message, ts, event_id
      FROM events WHERE event_type = 'error')"""
    last_fault = "struct_pack(ts := ts, e := event_id)"
    per_fault = f"""count(*) AS errors_total, 'EventError' AS last_type, arg_max(message, {last_fault}) AS last_message, max(ts) AS last_ts"""
    q["error_summary"] = f"""WITH {faults}
      SELECT component, errors_total, last_type, last_message, {iso('last_ts')} AS last_at FROM (
        SELECT component, {per_fault} FROM faults GROUP BY component UNION ALL SELECT '(all)', {per_fault} FROM faults)"""
    q["event_log"] = """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, event_type,
      CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity, 'shop' AS module,
      event_type || ' by ' || CAST(user_id AS VARCHAR) AS message, json_extract_string(props, '$.k') AS detail_k FROM events"""
    q["event_rollup_hourly"] = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"
    seconds = "CAST(round(value * 1000000) AS BIGINT)"
    q["job_runs"] = f"""WITH runs AS (SELECT 'job' || CAST(user_id AS VARCHAR) AS name, ts + to_microseconds({seconds}) AS ended, {seconds} AS micros,
        event_type <> 'error' AS ok, event_id FROM events),
      last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY name ORDER BY ended DESC, event_id DESC) = 1),
      per AS (SELECT name, count(*) AS run_count, count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS failure_count FROM runs GROUP BY name)
      SELECT name, run_count, success_count, failure_count, CASE WHEN ok THEN 'success' ELSE 'failed' END AS last_status,
             CASE WHEN NOT ok THEN 'EventError: failed' END AS last_error, CAST(micros AS DOUBLE) / 1e6 AS last_duration,
             {iso('ended')} AS last_run_end, {iso('(ended + INTERVAL 300 SECOND)')} AS next_run
      FROM per JOIN last USING (name)"""
    q["dashboard"] = f"""WITH {timing}, {faults},
      named AS (
        SELECT event_type AS name, CAST(sum({CENTS}) AS DOUBLE) AS value FROM events GROUP BY event_type
        UNION ALL SELECT name || '_last_duration_seconds', last_duration_seconds FROM timing
        UNION ALL SELECT name || '_executions_total', CAST(executions_total AS DOUBLE) FROM timing
        UNION ALL SELECT name || '_duration_seconds_total', duration_seconds_total FROM timing
        UNION ALL SELECT name || '_average_duration_seconds', average_duration_seconds FROM timing
        UNION ALL SELECT 'errors_' || component || '_total', CAST(count(*) AS DOUBLE) FROM faults GROUP BY component
        UNION ALL SELECT 'total_errors', CAST(count(*) AS DOUBLE) FROM faults)
      SELECT 'ok' AS status, (SELECT count(DISTINCT component) FROM faults) AS n_error_details, name, value FROM named"""
    # The newest error of each component, by time and then number.
    q["dashboard_rows"] = f"""WITH {faults}, rows AS ({q['dashboard']}),
      newest AS (SELECT 'errors_' || component || '_total' AS name, message FROM faults
                 QUALIFY row_number() OVER (PARTITION BY component ORDER BY ts DESC, event_id DESC) = 1)
      SELECT r.name, r.value, n.message AS last_error FROM rows r LEFT JOIN newest n USING (name)"""
    q["throttle_one_per_hour"] = """WITH RECURSIVE
      e AS MATERIALIZED (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      hop AS MATERIALIZED (SELECT a.user_id, a.i, min(b.i) AS j FROM e a JOIN e b ON b.user_id = a.user_id AND b.ts >= a.ts + INTERVAL 1 HOUR GROUP BY a.user_id, a.i),
      taken AS (SELECT user_id, CAST(1 AS BIGINT) AS i FROM e WHERE i = 1 UNION ALL SELECT t.user_id, h.j FROM taken t JOIN hop h ON h.user_id = t.user_id AND h.i = t.i)
      SELECT event_id, e.user_id AS key, t.i IS NOT NULL AS admitted FROM e LEFT JOIN taken t ON t.user_id = e.user_id AND t.i = e.i"""
    # An admitted request is a step: the state is the last three admits of the user.
    q["throttle_three_per_day"] = """WITH RECURSIVE
      e AS MATERIALIZED (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      walk AS (
        SELECT user_id, i, ts AS a1, CAST(NULL AS TIMESTAMP) AS a2, CAST(NULL AS TIMESTAMP) AS a3, true AS admitted FROM e WHERE i = 1
        UNION ALL
        SELECT w.user_id, e.i,
               CASE WHEN w.a3 IS NULL OR e.ts - w.a3 >= INTERVAL 24 HOUR THEN e.ts ELSE w.a1 END,
               CASE WHEN w.a3 IS NULL OR e.ts - w.a3 >= INTERVAL 24 HOUR THEN w.a1 ELSE w.a2 END,
               CASE WHEN w.a3 IS NULL OR e.ts - w.a3 >= INTERVAL 24 HOUR THEN w.a2 ELSE w.a3 END,
               w.a3 IS NULL OR e.ts - w.a3 >= INTERVAL 24 HOUR
        FROM walk w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
      SELECT event_id, e.user_id AS key, admitted FROM e JOIN walk w ON w.user_id = e.user_id AND w.i = e.i"""
    q["rolling_request_count"] = """SELECT event_id, user_id AS key,
      count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) - 1 AS n_prev FROM events"""

    clean_title, clean_content = one_line(no_tags("title")), lines("content")
    headed = f"'EN' || chr(10) || {PREFIX} c"
    q["content_stages"] = f"""WITH {ARTICLES},
      cleaned AS (SELECT id, {clean_title} AS t, {clean_content} AS c FROM articles),
      headed AS (SELECT id, t, c, {headed} AS r, {tags('t', 'c')} AS g FROM cleaned),
      base AS (SELECT *, {tokens("t || ' ' || r")} AS w, t || ' ' || r AS text FROM headed),
      facts AS (SELECT *, {hits('w', POSITIVE)} AS p, {hits('w', NEGATIVE)} AS n, len({word_list('text')}) AS words_count,
                CASE WHEN {share} > 15e-2 OR {hits('w', lex.PERSIAN_STOP_WORDS)} > {hits('w', lex.ENGLISH_STOP_WORDS)} THEN 'fa' ELSE 'en' END AS language FROM base)
      SELECT id, t AS title, c AS content,
             CASE WHEN len(g) > 0 THEN r || chr(10) || chr(10) || 'Tags: #' || array_to_string(g, ' #') ELSE r END AS rewritten_content,
             'completed' AS rewrite_status,
             'SanitizationStage,RewriteStage,TranslationStage,ContentAnalysisStage,MetadataTaggingStage' AS stages_executed, 0 AS n_failures,
             language, words_count, {label('(' + ratio('p', 'n') + ')')} AS label
      FROM facts"""
    q["publish_outputs"] = f"WITH {ARTICLES} SELECT id, {CHANNELS} AS published_outputs FROM articles"
    shown = "coalesce(rewritten_content, content, '')"
    q["json_feed_items"] = f"""WITH {ARTICLES} SELECT id, source_id, title, {shown} AS content, original_url, original_url AS url,
      {iso('published_at')} AS published_at, rewrite_status, CASE WHEN published_outputs = '' THEN 0 ELSE 2 END AS n_outputs FROM articles"""
    q["json_feed_files"] = f"""WITH {ARTICLES} SELECT id, title, {shown} AS content, {iso('published_at')} AS published_at,
      (SELECT count(*) FROM articles) AS n_articles FROM articles"""
    q["rss_feed_files"] = f"""WITH {ARTICLES} SELECT title, original_url AS link, id AS guid, {shown} AS description,
      strftime(published_at, '%a, %d %b %Y %H:%M:%S GMT') AS "pubDate", (SELECT count(*) FROM articles) AS n_articles FROM articles"""
    paged = f"""{ARTICLES}, paged AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, id) - 1 AS place, count(*) OVER () AS n FROM articles)"""
    q["rss_feed_pages"] = f"""WITH {paged} SELECT CAST(place // 50 AS INTEGER) AS page, CAST(place % 50 AS INTEGER) AS pos, title,
      original_url AS link, {shown} AS description, NULL AS error, NULL AS broken FROM paged"""
    q["json_feed_pages"] = f"""WITH {paged} SELECT CAST(place // 50 AS INTEGER) AS page, n AS count,
      CASE WHEN (place // 50 + 1) * 50 < n THEN 'https://example.org/feed/page=' || (place // 50 + 1) END AS next,
      CASE WHEN place >= 50 THEN 'https://example.org/feed/page=' || (place // 50 - 1) END AS previous,
      CAST(place % 50 AS INTEGER) AS pos, id, title FROM paged"""
    q["fan_out_targets"] = f"""WITH {ARTICLES} SELECT 'full' AS target, true AS ok, NULL AS error, id FROM articles
      UNION ALL SELECT 'done', true, NULL, id FROM articles WHERE rewrite_status = 'completed'
      UNION ALL SELECT 'broken', false, 'OSError: no space', NULL"""
    q["rewrite_with_fallback"] = """SELECT conv_id, turn,
      CASE WHEN length(text) <= 300 THEN 'terse: ' || text WHEN contains(text, '.') THEN 'patient: ' || text
           ELSE '[Rewritten Failed - Fallback]: ' || text END AS rewritten_content,
      length(text) > 300 AND NOT contains(text, '.') AS used_fallback FROM conversations"""
    q["rss_items"] = f"""WITH {ARTICLES} SELECT title, original_url AS link, id AS guid, {shown} AS description,
      strftime(published_at, '%a, %d %b %Y %H:%M:%S GMT') AS "pubDate" FROM articles"""
    encoded = "replace(url_encode(content), '%20', '+')"
    q["channel_messages"] = f"WITH {ARTICLES} SELECT id, 'chat_id=news~room%2A1&text=' || {encoded} AS body FROM articles"
    q["fetch_and_process"] = f"""WITH RECURSIVE {GREEDY}, {RANKED}, {ARTICLES},
      stored AS (SELECT substr(sha256(original_url), 1, 16) AS id, * EXCLUDE (id) FROM articles),
      merged AS (SELECT * FROM ranked WHERE place = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY group_id) = 1),
      todo AS (SELECT *, 'completed' AS rewrite_status,
                 'Title: ' || title || chr(10) || 'Content: ' || content AS rewritten_content
               FROM merged WHERE id NOT IN (SELECT id FROM stored WHERE rewrite_status = 'completed')),
      done AS (SELECT id, source_id, title, rewrite_status, rewritten_content, url AS original_url, {CHANNELS} AS published_outputs FROM todo)
      SELECT s.id, s.source_id, coalesce(d.title, s.title) AS title, coalesce(d.rewrite_status, s.rewrite_status) AS rewrite_status,
             coalesce(d.rewritten_content, s.rewritten_content) AS rewritten_content, s.original_url,
             coalesce(d.published_outputs, s.published_outputs) AS published_outputs
      FROM stored s LEFT JOIN done d USING (id)
      UNION ALL
      SELECT id, source_id, title, rewrite_status, rewritten_content, original_url, published_outputs FROM done WHERE id NOT IN (SELECT id FROM stored)"""

    q["enrich_failover"] = """SELECT conv_id, turn,
      CASE WHEN length(text) <= 300 THEN 'terse: ' || text WHEN contains(text, '.') THEN 'patient: ' || text ELSE text END AS text,
      CASE WHEN length(text) <= 300 THEN 'terse' WHEN contains(text, '.') THEN 'patient' END AS provider_used,
      CASE WHEN length(text) <= 300 THEN 1 WHEN contains(text, '.') THEN 3 ELSE 4 END AS attempts,
      CASE WHEN length(text) <= 300 THEN '' WHEN contains(text, '.') THEN 'terse: too long' ELSE 'terse: too long; patient: no sentence' END AS errors
      FROM conversations"""
    refused = "rewrite_status = 'pending' AND source_id = 'src3'"
    checked = "CASE WHEN rewrite_status = 'failed' THEN title ELSE upper(source_id) END"
    q["stage_isolation"] = f"""WITH {ARTICLES} SELECT id, {checked} AS title,
      CASE WHEN {refused} THEN rewritten_content ELSE {checked} END AS rewritten_content,
      CASE WHEN {refused} THEN 'failed' ELSE 'completed' END AS rewrite_status,
      CASE WHEN {refused} THEN 'Check,Rewrite' ELSE 'Check,Rewrite,Close' END AS stages_executed,
      CASE WHEN {refused} THEN 'Rewrite:refused:true' WHEN rewrite_status = 'failed' THEN 'Check:toxic:false' ELSE '' END AS failures
      FROM articles"""
    q["feed_files"] = f"""SELECT source AS source_id, CAST(doc_id AS VARCHAR) AS doc, {one_line('text')} AS title FROM documents"""
    q["feed_errors"] = "SELECT DISTINCT source AS source_id, true AS ok, 'malformed feed document' AS error FROM documents WHERE source = 'src7'"
    q["atom_entries"] = "SELECT CAST(page_id AS VARCHAR) AS page, url AS link FROM pages"
    q["json_store_users"] = """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS username,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'viewer' END AS role, '2024-01-01T00:00:00' AS created_at FROM customer"""
    q["event_log_round_trip"] = """SELECT CAST(event_id AS VARCHAR) AS message, event_type, 'WARNING' AS severity,
      json_extract_string(props, '$.k') AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events"""
    q["dedup_stream"] = "SELECT DISTINCT sha256(text) AS content_sha FROM documents"
    q["event_rollup_stream"] = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') AS window_start, event_type, count(*) AS n FROM events
      GROUP BY ALL"""
    norm, shape = one_line("text"), "doc_id % 5"
    shaped = f"""shaped AS (SELECT doc_id, {norm} AS t, {shape} AS shape FROM documents),
      whole AS (SELECT doc_id, shape, 0 AS pos, t AS title, 1 AS n, '<item>' || substr(t, 1, 20) || '</item>' AS description FROM shaped WHERE shape <> 2
                UNION ALL SELECT doc_id, shape, 1, t, 2, '<item>' || substr(t, 1, 20) || '</item>' FROM shaped WHERE shape = 0)"""
    q["feed_item_shapes"] = f"""WITH {shaped}
      SELECT doc_id, pos, trim(title) AS title, 'https://example.org/' || n || '/' || doc_id AS link, description, NULL AS error FROM whole
      UNION ALL SELECT doc_id, 1, NULL, NULL, NULL, 'cut item' FROM shaped WHERE shape = 1
      UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'no item' FROM shaped WHERE shape = 2
      UNION ALL SELECT doc_id, 1, '', '', '', NULL FROM shaped WHERE shape = 3
      UNION ALL SELECT doc_id, 1, NULL, NULL, NULL, 'malformed item' FROM shaped WHERE shape = 4"""
    stored = "group_id, arrival, id, source_id, title, content, url"
    q["remerged_articles"] = f"WITH RECURSIVE {GREEDY}, {RANKED} SELECT {stored} FROM ranked WHERE place = 1"
    q["remerged_articles_transitive"] = f"WITH RECURSIVE {TRANSITIVE}, {RANKED} SELECT {stored} FROM ranked WHERE place = 1"
    # The batches come in time order, so none of their rows is late.
    q["source_stats_stream"] = f"SELECT *, CAST(0 AS BIGINT) AS late_rows FROM ({q['source_stats']})"
    q["job_runs_stream"] = f"SELECT *, CAST(0 AS BIGINT) AS late_rows FROM ({q['job_runs']})"
    q["throttle_stream"] = f"SELECT *, false AS late FROM ({q['throttle_three_per_day']})"
    q["stored_article"] = f"WITH {ARTICLES} SELECT id, title, content, rewrite_status FROM articles WHERE id = '7'"
    return q


ORACLES = _queries()
