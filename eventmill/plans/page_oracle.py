"""SQL that converts the driver's pages: for the tags that occur there, with links and lists that do not nest."""

from __future__ import annotations


def page_text_sql(html: str = "html", base: str = "") -> str:
    """With a `base`, links are numbered, and their addresses, all of them paths from the root, follow at the end."""
    link_end = "'](' || href || ')'" if not base else "'][' || (SELECT number FROM refs r WHERE r.page_id = state.page_id AND r.href = state.href) || ']'"
    addresses = (
        ""
        if not base
        else f"""|| coalesce((SELECT chr(10) || string_agg('   [' || number || ']: {base}' || href || chr(10), '' ORDER BY number) || chr(10)
    FROM refs r WHERE r.page_id = pieces.page_id), '')"""
    )
    return rf"""
WITH tok AS (
  SELECT page_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos
  FROM (SELECT page_id, list_append(regexp_extract_all({html}, '(?is)<!--.*?-->|<![^>]*>|<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|</?[a-z][^>]*>|&[a-z][a-z0-9]*;|[^<&]+|[<&]'), '') AS toks FROM pages)
), tag AS (
  SELECT *, lower(regexp_extract(t, '^</?([a-zA-Z][^\s/>]*)', 1)) AS name, t LIKE '</%' AS closes FROM tok WHERE t NOT LIKE '<!%'
), state AS (
  SELECT *, max(CASE WHEN name = 'body' THEN 1 ELSE 0 END) OVER w = 1 AS shown,
    sum(CASE WHEN name <> 'ul' THEN 0 WHEN closes THEN -1 ELSE 1 END) OVER w AS depth,
    last_value(CASE WHEN name = 'a' AND NOT closes THEN regexp_extract(t, 'href="([^"]*)"', 1) END IGNORE NULLS) OVER w AS href,
    last_value(CASE WHEN name <> '' AND NOT (name = 'h1' AND closes) THEN name END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tag_before
  FROM tag WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), refs AS (
  SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) AS number FROM state WHERE name = 'a' AND closes GROUP BY page_id, href
), written AS (
  SELECT page_id, pos, name, closes, shown, t = '' AS final, name = '' AS pure,
    CASE WHEN name = 'h1' OR name IN ('p', 'div') THEN 2 WHEN name = 'ul' AND NOT closes AND depth = 1 AND coalesce(tag_before, '') <> 'ul' THEN 2
      WHEN name = 'li' THEN 1 ELSE 0 END AS breaks,
    CASE WHEN name = '' THEN CASE t WHEN '&amp;' THEN '&' WHEN '&quot;' THEN '"' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>'
        WHEN '&middot;' THEN '*' WHEN '&copy;' THEN '(C)' WHEN '&nbsp;' THEN ' ' ELSE regexp_replace(t, '\s+', ' ', 'g') END
      WHEN name = 'b' THEN '**' WHEN name = 'br' AND NOT closes THEN '  ' || chr(10) WHEN name = 'h1' AND NOT closes THEN '# '
      WHEN name = 'a' AND NOT closes THEN '[' WHEN name = 'a' THEN {link_end}
      WHEN name = 'li' AND NOT closes THEN repeat('  ', depth::INT) || '* ' END AS data
  FROM state
), emitted AS (
  SELECT *, pure AND data LIKE ' %' AND shown AS spaced, CASE WHEN pure AND data LIKE ' %' THEN substr(data, 2) ELSE data END AS body
  FROM written
), marked AS (
  SELECT *, shown AND (coalesce(length(body), 0) > 0 OR final) AS writes FROM emitted
), parted AS (
  SELECT *, coalesce(sum(writes::INT) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part,
    coalesce(lag(name = 'li' AND NOT closes) OVER (PARTITION BY page_id ORDER BY pos), true) AS restart FROM marked
), parts AS (
  SELECT page_id, part, max(breaks) AS breaks, bool_or(restart) AS restart, bool_or(spaced) AS spaced,
    max(CASE WHEN writes THEN body END) AS body, bool_or(writes AND final) AS final, bool_or(writes) AS writes
  FROM parted GROUP BY page_id, part
), pieces AS (
  SELECT page_id, part, CASE WHEN final THEN chr(10) ELSE CASE WHEN restart THEN '' WHEN breaks > 0 THEN repeat(chr(10), breaks)
    WHEN spaced AND NOT coalesce(lag(body) OVER (PARTITION BY page_id ORDER BY part) LIKE '%' || chr(10), false) THEN ' ' ELSE '' END || body END AS piece
  FROM parts WHERE writes
), texts AS (SELECT page_id, string_agg(piece, '' ORDER BY part) {addresses} AS raw FROM pieces GROUP BY page_id)
SELECT page_id, regexp_replace(array_to_string(list_transform(string_split(raw, chr(10)), lambda x: CASE WHEN x = '' THEN chr(10)
  WHEN regexp_full_match(x, ' +') THEN '' WHEN x[1] IN (' ', '*', '-') THEN x || chr(10)
  ELSE regexp_replace(x, '(.{{0,77}}\S)(?:\s+|$)', '\1' || chr(10), 'g') || chr(10) END), ''), chr(10) || '{{3,}}', chr(10) || chr(10), 'g') AS text
FROM texts"""
