"""DuckDB SQL of the queries that SQL can state."""

from __future__ import annotations

from .queries import URL_POLICY
from .sharding import BUCKETS, HEX

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def warc() -> str:
    return """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest
           FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON f.digest = d.digest"""


def sharding(shards: int = 8, seed: int = 17) -> str:
    # crc32 by its table: the table from the reversed polynomial, then a fold over the bytes
    return f"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
         CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) AS v
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
h AS (SELECT doc_id, source, string_split(hex(encode(coalesce(text, ''))), '') AS x,
             octet_length(encode(coalesce(text, ''))) AS n FROM documents),
b AS (SELECT doc_id, source, CAST(n + 1 AS BIGINT) AS size,
             list_transform(range(n), lambda i: CAST(16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1)
                            + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT)) AS bytes FROM h),
c AS (SELECT doc_id, source, size, xor(CAST(4294967295 AS BIGINT), list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), bytes),
        lambda c, k: xor(t[(xor(c, k) & 255) + 1], c >> 8))) AS text_crc32 FROM b CROSS JOIN tab),
r AS (SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum,
             md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || text_crc32) AS h
      FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id NULLS FIRST, text_crc32, size) AS i,
             count(*) OVER (PARTITION BY stratum) AS total FROM r),
f AS (SELECT *, CAST(2 * i - 1 AS DOUBLE) / CAST(2 * total AS DOUBLE) AS fraction FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, h, stratum, doc_id NULLS FIRST, text_crc32, size) - 1
             AS position, count(*) OVER () AS n FROM f),
s AS (SELECT *, position * {shards} // n AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(position - (shard * n + {shards} - 1) // {shards} AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, source, CAST(position AS BIGINT) AS position FROM s"""


def url_rules(confidence: float = 0.8, least: int = 20) -> str:
    fits, verdicts = [], []
    for site, v in sorted(URL_POLICY, key=lambda r: -len(r[0])):
        host, slash, path = site.partition("/")
        cond = (f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) "
                f"AND starts_with(path, '{slash}{path}') THEN ")
        fits.append(cond + f"'{site}'")
        verdicts.append(cond + f"'{v}'")
    return f"""
WITH RECURSIVE u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0
                  THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT *, {_lower("coalesce(regexp_extract(rest, '^[^/?#]*', 0), '')")} AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
l AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS names,
             list_filter(string_split(path, '/'), lambda x: x <> '') AS parts,
             list_filter(string_split(coalesce(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), ''), '&'),
                         lambda x: x <> '') AS args FROM h),
k AS (SELECT *, list_distinct(
        CASE WHEN rest IS NULL THEN [] ELSE ['scheme=' || {_lower("split_part(url, '://', 1)")}] END
        || list_transform(range(1, len(names) + 1), lambda i: 'host=' || array_to_string(names[i:], '.'))
        || list_transform(parts, lambda x: 'path=' || regexp_replace(x, '[0-9]+', '#', 'g'))
        || list_transform(args, lambda x: 'query=' || regexp_replace(
             regexp_extract(x, '^[^=]*', 0), '[0-9]+', '#', 'g'))) AS tokens FROM l),
y AS (SELECT doc_id, coalesce(max(CAST(quality = 0 OR toxic = 1 AS INTEGER)) = 1, false) AS bad
      FROM labels WHERE quality IN (0, 1) OR toxic IN (0, 1) GROUP BY doc_id),
tr AS (SELECT tokens, count(*) AS n, count(*) FILTER (bad) AS b
       FROM (SELECT list_sort(tokens) AS tokens, bad FROM k JOIN y ON y.doc_id = k.page_id) GROUP BY tokens),
one AS (SELECT t, sum(n) AS n, sum(b) AS b FROM (SELECT n, b, unnest(tokens) AS t FROM tr)
        GROUP BY t HAVING sum(b) >= {least}),
often AS (SELECT coalesce(list(t), []) AS known FROM one),
held AS (SELECT tokens, sum(n) AS n, sum(b) AS b FROM (
  SELECT list_filter(tokens, lambda x: list_contains(known, x)) AS tokens, n, b FROM tr, often) GROUP BY tokens),
sets AS (SELECT [t] AS r, CAST(n AS DOUBLE) AS n, CAST(b AS DOUBLE) AS b FROM one
         UNION ALL
         SELECT r, CAST(sum(n) AS DOUBLE), CAST(sum(b) AS DOUBLE)
         FROM (SELECT unnest(list_transform(list_filter(w.tokens, lambda x: x > s.r[-1]),
                             lambda x: list_append(s.r, x))) AS r, w.n, w.b
               FROM sets s JOIN held w ON list_has_all(w.tokens, s.r) WHERE s.b / s.n < {confidence})
         GROUP BY r HAVING sum(b) >= {least}),
rules AS (SELECT r FROM sets WHERE b / n >= {confidence}),
hit AS (SELECT DISTINCT url FROM k JOIN rules ON list_has_all(tokens, r))
SELECT page_id, host, path, CASE {' '.join(fits)} END AS rule,
       CASE {' '.join(verdicts)} WHEN hit.url IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM k LEFT JOIN hit ON hit.url = k.url"""


def lexical(k: int = 10) -> str:
    terms = "regexp_extract_all(" + _lower("text") + \
        r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(t) * docs) // terms AS m FROM d, s WHERE len(t) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct({terms}) AS t
      FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT q, item_id, unnest(t) AS term FROM i),
f AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS n FROM f WHERE score > 0)
WHERE n <= {k}"""


def oracle_sql() -> dict[str, str]:
    assert BUCKETS == 16 ** HEX
    return {"op5_url_rules": url_rules(), "op7_warc_members": warc(),
            "op8_stratified_interleave": sharding(), "op11_lexical_search": lexical()}
