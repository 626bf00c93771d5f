"""DuckDB SQL for the queries that SQL can express; it shares nothing with the operators but the contract."""

from __future__ import annotations

import zlib

from .common import LOWER, UPPER

_RADIX = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents) WINDOW same AS (PARTITION BY t)"""


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """All distances in every round; whole numbers below 2^53 are exact as doubles."""
    ctes = [f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""cut AS (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p))""",
            f"""book0 AS (SELECT p, e, x AS c FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}) USING (vec_id))"""]
    for r in range(rounds + 1):
        ctes.append(f"""near{r} AS (SELECT vec_id, p, arg_min(e, d * 256 + e) AS e, min(d) AS d
            FROM (SELECT vec_id, cut.p, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM cut JOIN book{r} b ON b.p = cut.p) GROUP BY vec_id, p)""")
        if r < rounds:
            ctes.append(f"""mean{r} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS m
                FROM (SELECT n.p, n.e, x, unnest(range(1, len(x) + 1)) AS i FROM near{r} n JOIN cut USING (vec_id, p)) GROUP BY p, e, i) GROUP BY p, e)""")
            ctes.append(f"book{r + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, e))")
    ctes.append(f"told AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)")
    ctes.append(f"digest AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(c) AS v, unnest(range(len(c))) AS i FROM book{rounds}))")
    return "WITH " + ",\n".join(ctes) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM told JOIN kept USING (vec_id), digest"""


#: CTE with the table of crc32, and crc32 of a text of code points below 256 in its terms.
_CRC_TABLE = f"tab AS MATERIALIZED (SELECT {[zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)]}::BIGINT[] AS crc)"


def _crc32(text: str) -> str:
    byte = f"list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, (ord(c) - 64)::BIGINT] END)"
    return f"xor(list_reduce(flatten({byte}), lambda s, b: xor(s >> 8, crc[CAST(xor(s, b) & 255 AS INTEGER) + 1]), 4294967295::BIGINT), 4294967295)"


def _spellings() -> str:
    """Words that share a shortened form are compared; the hash is the table form of crc32 over the bytes of the run."""
    return f"""
WITH RECURSIVE {_CRC_TABLE},
run AS (SELECT doc_id || ':' AS doc, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents),
counted AS (SELECT w, concat(doc, w) AS k, count(*) AS n FROM run WHERE length(w) >= 5 GROUP BY ALL),
hashed AS (SELECT w, n, {_crc32('k')} AS h FROM counted, tab),
edited AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM hashed),
vocab AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocab)),
pairs AS MATERIALIZED (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT g.word, g.n, v.word, v.n FROM gaps g JOIN vocab v ON g.rest = v.word
    UNION SELECT v.word, v.n, g.word, g.n FROM gaps g JOIN vocab v ON g.rest = v.word),
best AS (SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, other, m FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
forms AS MATERIALIZED (SELECT word, other AS form, m FROM best WHERE m >= 2 * n),
chain AS (SELECT word, form, 1 AS step FROM forms UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON c.form = f.word)
SELECT v.word, f.form, coalesce(r.root, v.word) AS root, v.n, coalesce(b.n_near, 0) AS n_near, f.m AS form_n
FROM vocab v LEFT JOIN forms f USING (word) LEFT JOIN best b USING (word) LEFT JOIN (SELECT word, arg_max(form, step) AS root FROM chain GROUP BY word) r USING (word)"""


_FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

_LICENSE_BASE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
hits AS (SELECT doc_id, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1] = 'cc' AND ws[i + 2] = 'by')) AS i, 'cc-by' AS label FROM w
  UNION ALL SELECT doc_id, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1] = 'general' AND ws[i + 2] = 'public' AND ws[i + 3] = 'license')), 'gpl' FROM w
  UNION ALL SELECT doc_id, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1] = 'all' AND ws[i + 2] = 'rights' AND ws[i + 3] = 'reserved')), 'reserved' FROM w)
SELECT w.doc_id, any_value(len(ws)) AS n_words, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM w LEFT JOIN hits USING (doc_id) GROUP BY w.doc_id"""

_TOKEN_COUNTS = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 1 AS held_out, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents, tab),
seen AS (SELECT DISTINCT unnest(ws) AS word FROM d WHERE NOT held_out),
known AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word FROM d) JOIN seen USING (word) GROUP BY doc_id),
total AS (SELECT coalesce(sum(len(ws) + 1), 0)::BIGINT AS n FROM d WHERE NOT held_out)
SELECT d.doc_id, held_out, len(ws) + 1 AS n_tokens, coalesce(known.n, 0) + (total.n > 0)::INT AS n_known, total.n AS train_tokens FROM d LEFT JOIN known USING (doc_id), total"""

_EDITED_TEXTS = """
SELECT doc_id, length(t) AS n_chars, sha256(substring(t, 1, length(t) - length(t) // 2) || substring(following, 1, length(t) // 2)) AS edited_sha256
FROM (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS following FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (ORDER BY doc_id DESC))"""

ORACLES = {"license_base": _LICENSE_BASE, "token_counts": _TOKEN_COUNTS, "edited_texts": _EDITED_TEXTS, "op11_radix_dedup": _RADIX, "op12_dual_tree_codes": _codes(), "op13_spelling_variants": _spellings()}
