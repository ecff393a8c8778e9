"""DuckDB SQL with the same results, where SQL can express the operator."""

OP1 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 49)) AS pos, words FROM w
), k AS (
  SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY sha256(array_to_string(words[pos:pos + 49], ' '))) AS owner FROM p
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 49)) AS pos FROM k WHERE owner < doc_id
), t AS (
  SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS pos FROM w
), s AS (
  SELECT doc_id, count(gone.pos) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone.pos IS NULL), '') AS kept
  FROM t LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s USING (doc_id)
"""

_STRENGTH = """
  SELECT {key}, n, bad, (bad + 1) / (n + 2) AS mean,
    least(CASE WHEN k > 1 AND between_ > 0 THEN greatest(noise / between_ - 1, 1.0) ELSE 1000.0 END, 1000.0, n + 2) AS prior
  FROM (
    SELECT *, (spread - n * m * m - (k - 1) * noise) / CASE WHEN n - nn / n = 0 THEN NULL ELSE n - nn / n END AS between_
    FROM (
      SELECT {key}, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad, count(*) AS k, sum(n * n) AS nn,
        sum(bad * bad / n) AS spread, (sum(bad) + 1) / (sum(n) + 2) AS m,
        (sum(bad) + 1) / (sum(n) + 2) * (1 - (sum(bad) + 1) / (sum(n) + 2)) AS noise
      FROM {table} GROUP BY {key}
    )
  )
"""
_LONG = "('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in')"
_TWO = "array_to_string(list_slice(string_split({x}, '.'), -2, -1), '.')"
_DOMAIN = (
    f"CASE WHEN {_TWO} IN {_LONG} THEN array_to_string(list_slice(string_split({{x}}, '.'), -3, -1), '.') ELSE {_TWO} END"
)
_SUFFIX = f"CASE WHEN {_TWO} IN {_LONG} THEN {_TWO} ELSE string_split({{x}}, '.')[-1] END"
_FITS = "((host = '{0}' OR suffix(host, '.{0}')) AND prefix(path, '{1}'))"

OP10 = rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS pos FROM pages
), r AS (
  SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r
), l AS (
  SELECT doc_id, min(quality) AS y FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), h AS (
  SELECT host, CAST(count(y) AS DOUBLE) AS n, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS bad,
    {_DOMAIN.format(x="host")} AS domain
  FROM p LEFT JOIN l ON page_id = doc_id GROUP BY host
), seen AS (SELECT * FROM h WHERE n > 0
), d AS ({_STRENGTH.format(key="domain", table="seen")}
), d2 AS (SELECT *, {_SUFFIX.format(x="domain")} AS suffix FROM d
), s AS ({_STRENGTH.format(key="suffix", table="d2")}
), s2 AS (SELECT *, 0 AS one FROM s
), a AS ({_STRENGTH.format(key="one", table="s2")}
), s3 AS (
  SELECT suffix, (s2.bad + a.mean * a.prior) / (s2.n + a.prior) AS suffix_mean, s2.prior AS domain_prior FROM s2, a
), d3 AS (
  SELECT domain, (bad + suffix_mean * domain_prior) / (n + domain_prior) AS domain_mean, prior AS host_prior
  FROM d2 JOIN s3 USING (suffix)
), post AS (
  SELECT host, bad + m * k AS alpha, n - bad + (1 - m) * k AS beta FROM (
    SELECT h.host, h.n, h.bad, coalesce(domain_mean, suffix_mean, 0.5) AS m, coalesce(host_prior, domain_prior, 1.0) AS k
    FROM h LEFT JOIN d3 USING (domain) LEFT JOIN s3 ON s3.suffix = {_SUFFIX.format(x="h.domain")}
  )
), v AS (
  SELECT host, alpha / (alpha + beta)
    - 1.645 * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) > 0.2 AS bad
  FROM post
), f AS (
  SELECT page_id, host, path, CASE
    WHEN {_FITS.format("example.org", "/en/1")} THEN 'example.org/en/1'
    WHEN {_FITS.format("example.org", "/es/")} THEN 'example.org/es/'
    WHEN {_FITS.format("com", "/fr/")} THEN 'com/fr/'
    WHEN {_FITS.format("com", "/de/")} THEN 'com/de/'
    WHEN {_FITS.format("org", "/")} THEN 'org/' END AS rule
  FROM p
)
SELECT page_id, f.host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN v.bad THEN 'block' ELSE 'allow' END AS verdict
FROM f JOIN v USING (host)
"""
