"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _shingles(words: str, n: int) -> str:
    """Distinct n-word shingles of a word list; the whole list if it is shorter."""
    return (f"CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < {n} THEN [array_to_string({words}, ' ')] "
            f"ELSE list_distinct(list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))) END")


OP1 = f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM g) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM late) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), ' ') END) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id"""

OP4 = f"""
WITH l AS (SELECT doc_id, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS p
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
w AS (SELECT doc_id, p, x, {_words("x")} AS w FROM l),
c AS (SELECT doc_id, p, array_to_string(w, ' ') AS t, len(w) AS n, lead(array_to_string(w, ' ')) OVER o AS t2, lead(p) OVER o AS p2
      FROM w WHERE len(w) > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, p AS i, p2 AS e, t || chr(10) || t2 AS g FROM c WHERE t2 IS NOT NULL
         UNION ALL SELECT doc_id, p, p, t FROM c WHERE n >= 50),
gone AS (SELECT DISTINCT doc_id, unnest([i, e]) AS p, 1 AS g
         FROM (SELECT doc_id, i, e, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM runs) WHERE r > 1)
SELECT w.doc_id, count(*) FILTER (WHERE len(w) > 0)::BIGINT AS n_lines, count(gone.g)::BIGINT AS n_deleted,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY w.p) FILTER (WHERE gone.g IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.p = gone.p GROUP BY w.doc_id"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(AZ)} AS w FROM documents),
sh AS (SELECT doc_id, {_shingles("w", 4)} AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sh),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
          FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM inter WHERE 100 * c >= 85 * (na + nb - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM sh UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT sh.doc_id, len(s)::BIGINT AS n_shingles, m.c AS class_id, r.component_id
FROM sh JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON sh.doc_id = r.a
JOIN (SELECT doc_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS c FROM sh) m ON m.doc_id = sh.doc_id"""

_HOST = r"translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _level(name: str, source: str, key: str, parent: str, parent_key: str) -> str:
    """Posterior of one level: children of ``source`` around their parents' rates."""
    return f"""
{name}_c AS (SELECT c.*, p.rate AS centre FROM {source} c JOIN {parent} p ON c.{parent_key} = p.{parent_key}),
{name}_m AS (SELECT sum(n * power(k / n - centre, 2)) AS spread, avg(centre * (1 - centre)) AS noise, count(*) AS m, sum(n) AS n, sum(n * n) AS nn
             FROM {name}_c WHERE n > 0),
{name}_r AS (SELECT CASE WHEN m IS NULL OR m < 2 OR noise = 0 OR n - nn / n - (m - 1) <= 0 THEN 0
             ELSE (spread / noise - (m - 1)) / (n - nn / n - (m - 1)) END AS rho FROM {name}_m),
{name}_s AS (SELECT CASE WHEN rho > 0 THEN least(1000.0, greatest(1.0, 1 / rho - 1)) ELSE 1000.0 END AS s FROM {name}_r),
{name} AS (SELECT *, s * centre + k AS a, s * (1 - centre) + n - k AS b, (s * centre + k) / (s + n) AS rate FROM {name}_c, {name}_s)"""


OP7 = rf"""
WITH u AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN quality IS NOT NULL OR toxic IS NOT NULL
        THEN (coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT END) AS bad FROM labels GROUP BY doc_id),
h0 AS (SELECT host, coalesce(sum(bad), 0)::DOUBLE AS k, count(bad)::DOUBLE AS n FROM u LEFT JOIN l ON page_id = doc_id GROUP BY host),
h AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix, 1 AS one FROM h0),
d AS (SELECT domain, suffix, sum(k) AS k, sum(n) AS n FROM h GROUP BY ALL),
x AS (SELECT suffix, 1 AS one, sum(k) AS k, sum(n) AS n FROM d GROUP BY suffix),
top AS (SELECT 1 AS one, (sum(k) + 1) / (sum(n) + 2) AS rate FROM x),
{_level("lx", "x", "suffix", "top", "one")},
{_level("ld", "d", "domain", "lx", "suffix")},
{_level("lh", "h", "host", "ld", "domain")},
rules(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
hit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
        FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, hit.rule,
  coalesce(hit.verdict, CASE WHEN lh.rate - 2.0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN hit ON u.page_id = hit.page_id JOIN lh ON u.host = lh.host"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
t AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, i * 5 + 1, 5))::INTEGER) AS v FROM s)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0],
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> k) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM t"""

OP9 = f"""
WITH i AS (SELECT item_id, {_shingles("w", 5)} AS s FROM (SELECT item_id, {_words(AZ)} AS w FROM benchmark)),
d AS (SELECT doc_id, {_shingles("w", 5)} AS s FROM (SELECT doc_id, {_words(AZ)} AS w FROM documents)),
it AS (SELECT item_id, len(s) AS n, unnest(s) AS t FROM i), dt AS (SELECT doc_id, unnest(s) AS t FROM d),
c AS (SELECT doc_id, item_id, count(*) AS held, n FROM it JOIN dt ON it.t = dt.t GROUP BY ALL),
k AS (SELECT doc_id, list(item_id ORDER BY item_id) AS item_ids, count(*)::BIGINT AS n_items, max(held / n) AS containment
      FROM c WHERE 100 * held >= 80 * n GROUP BY doc_id)
SELECT d.doc_id, coalesce(item_ids, []) AS item_ids, coalesce(n_items, 0) AS n_items, coalesce(containment, 0.0) AS containment,
       n_items IS NOT NULL AS contaminated
FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

OP11 = r"""
WITH src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
             UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
             UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT *, regexp_replace(text, '<(\\*)\|(im_start|im_end)\|>', '<\\\1|\2|>', 'g') AS written FROM src)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(written) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
             ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
                  WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                   ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


def _op13(rounds: int = 4) -> str:
    """Rounds written out; squares are exact in doubles at the tables' sizes."""
    near = ("SELECT v.vec_id, v.p, min(v.qq - 2 * list_inner_product(v.q, b.c) + b.cc) AS d, "
            "arg_min(b.e, (v.qq - 2 * list_inner_product(v.q, b.c) + b.cc) * 256 + b.e) AS e "
            "FROM v JOIN {book} b ON v.p = b.p GROUP BY v.vec_id, v.p")
    parts = ["kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings "
             "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
             "v AS (SELECT vec_id, p, q, list_inner_product(q, q) AS qq FROM (SELECT vec_id, p, "
             "w[p * (len(w) // 4) + 1 : (p + 1) * (len(w) // 4)] AS q FROM kept, range(4) AS r(p)))",
             "b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q AS c, qq AS cc FROM v "
             "WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))"]
    for k in range(1, rounds + 1):
        old = f"b{k - 1}"
        parts += [f"a{k} AS MATERIALIZED ({near.format(book=old)})",
                  f"m{k} AS (SELECT p, e, list(x ORDER BY i) AS c FROM (SELECT a.p, a.e, u.i, floor(sum(v.q[u.i]) / count(*)) AS x "
                  f"FROM a{k} a JOIN v ON a.vec_id = v.vec_id AND a.p = v.p, unnest(range(1, len(v.q) + 1)) AS u(i) "
                  f"GROUP BY a.p, a.e, u.i) GROUP BY p, e)",
                  f"b{k} AS MATERIALIZED (SELECT p, e, c, list_inner_product(c, c) AS cc FROM (SELECT o.p, o.e, coalesce(m.c, o.c) AS c "
                  f"FROM {old} o LEFT JOIN m{k} m ON o.p = m.p AND o.e = m.e))"]
    parts += [f"f AS MATERIALIZED ({near.format(book=f'b{rounds}')})",
              "row AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY vec_id)",
              "lab AS (SELECT label, sum(error)::BIGINT AS label_error FROM row JOIN kept USING (vec_id) GROUP BY label)",
              f"book AS (SELECT sha256(string_agg(c[u.i]::BIGINT::VARCHAR, ',' ORDER BY p, e, u.i)) AS codebooks_sha256 "
              f"FROM b{rounds}, unnest(range(1, len(c) + 1)) AS u(i))"]
    return ("WITH " + ",\n".join(parts) + "\nSELECT vec_id, code, error, label_error, codebooks_sha256 FROM row JOIN kept USING (vec_id) "
            "JOIN lab ON kept.label IS NOT DISTINCT FROM lab.label, book")


OP13 = _op13()

ORACLE = {"op1_substring_dedup": OP1, "op4_line_dedup": OP4, "op6_ngram_jaccard": OP6, "op7_url_reputation": OP7, "op8_warc_captures": OP8,
          "op9_benchmark_leaks": OP9,
          "op11_chat_format": OP11, "op12_fill_in_middle": OP12, "op13_vector_codes": OP13}
