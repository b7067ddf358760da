"""DuckDB SQL for the queries that SQL can express, written from the contracts and not from the operators."""

from __future__ import annotations

OP4 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS s FROM w WHERE len(ws) >= 50),
keyed AS (SELECT doc_id, s, md5(array_to_string(ws[s + 1:s + 50], ' ')) AS k FROM win),
least AS (SELECT k, min(doc_id) AS d FROM keyed GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM keyed JOIN least USING (k) WHERE doc_id > d),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
pos AS (SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(0, greatest(len(ws) - 12, 1))) AS s FROM i WHERE len(ws) > 0),
phrase AS (SELECT DISTINCT item_id, n, array_to_string(ws[s + 1:s + n], ' ') AS k FROM pos),
sizes AS (SELECT DISTINCT n FROM phrase),
spot AS (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS s FROM d, sizes WHERE len(ws) >= n),
found AS (SELECT doc_id, s, spot.n AS n, item_id FROM spot JOIN phrase ON phrase.n = spot.n AND k = array_to_string(ws[s + 1:s + spot.n], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(own.n, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v AS q, v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(q.c) = len(v.c))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


OP7 = """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS p, unnest(ls) AS line FROM t),
pair AS (SELECT a.doc_id AS d, a.p AS p, b.doc_id AS e, b.p AS q, length(a.line) AS n FROM line a JOIN line b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.p < a.p))),
run AS (SELECT *, p - row_number() OVER (PARTITION BY d, e, p - q ORDER BY p) AS k FROM pair),
common AS (SELECT d, min(p) AS first, max(p) AS last FROM run GROUP BY d, e, p - q, k HAVING sum(n) >= 40),
gone AS (SELECT DISTINCT d AS doc_id, unnest(range(first, last + 1)) AS p FROM common),
starts AS (SELECT doc_id, count(*) AS n FROM gone g WHERE NOT EXISTS (SELECT 1 FROM gone h WHERE h.doc_id = g.doc_id AND h.p = g.p - 1) GROUP BY doc_id),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS t FROM line ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - coalesce(kept.n, 0), 0)::BIGINT AS n_removed,
  coalesce(starts.n, 0)::BIGINT AS n_runs, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.t, '')) END AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN starts USING (doc_id)
"""


def op5() -> str:
    """Notices of one line, each a sentence; the licences that they name by a table of its own, and reserved rights.

    Wrapped licence texts, comments and lists, of which the tables hold none, are left to the tests.
    """
    named = {
        "Apache-2.0": "apache license version 2.0", "MIT": "mit license", "GPL-3.0": "gnu general public license version 3", "GPL-2.0": "gnu general public license version 2", "LGPL-2.1": "gnu lesser general public license version 2.1",
        "AGPL-3.0": "gnu affero general public license version 3", "MPL-2.0": "mozilla public license 2.0", "BSD-3-Clause": "bsd 3-clause license", "BSD-2-Clause": "bsd 2-clause license", "ISC": "isc license",
        "CC-BY-4.0": "cc by 4.0", "CC-BY-SA-4.0": "cc by-sa 4.0", "CC-BY-NC-4.0": "cc by-nc 4.0", "CC-BY-NC-SA-4.0": "cc by-nc-sa 4.0", "CC-BY-NC-ND-4.0": "cc by-nc-nd 4.0", "CC-BY-ND-4.0": "cc by-nd 4.0", "CC0-1.0": "cc0 1.0",
    }
    rows = ", ".join(f"('{name}', '{words}')" for name, words in named.items())
    return f"""
WITH known(licence, words) AS (VALUES {rows}),
cut AS (SELECT doc_id, string_split(regexp_replace(lower(text), '([.;!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS ss FROM documents WHERE text IS NOT NULL),
one AS (SELECT doc_id, trim(regexp_replace(regexp_replace(unnest(ss), '[^a-z0-9.-]+', ' ', 'g'), '[.]( |$)', ' ', 'g')) AS s FROM cut),
notice AS (SELECT doc_id, CASE WHEN s = 'all rights reserved' THEN 'Proprietary' ELSE licence END AS licence FROM one LEFT JOIN known
  ON regexp_full_match(s, '((this|the) [a-z]+ is |it is )?(licensed|released|distributed|published|available) under (the )?' || replace(words, '.', '[.]'))
  WHERE s = 'all rights reserved' OR licence IS NOT NULL),
counted AS (SELECT doc_id, licence, count(*) AS n FROM notice GROUP BY ALL),
listed AS (SELECT doc_id, sum(n)::BIGINT AS n, string_agg(licence || ':' || n, ',' ORDER BY licence) AS licences FROM counted GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(licences, '') AS licences FROM documents d LEFT JOIN listed USING (doc_id)
"""


SHARD_COUNTS = """
WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT unnest(range(40))::INTEGER AS shard),
c AS (SELECT shard, n // 40 + CASE WHEN shard < n % 40 THEN 1 ELSE 0 END AS n FROM s, n)
SELECT shard, n, n AS n_slots, 0::BIGINT AS first, n - 1 AS last FROM c WHERE n > 0
"""

SQL = {"shard_counts": SHARD_COUNTS, "op5_licences": op5(), "op4_difference_cover": OP4, "op6_fm_index": OP6, "op7_suffix_array": OP7, "op10_top_k": OP10}
