"""SQL for the operators that SQL can express: the definitions, written out, over all rows."""

from __future__ import annotations

#: CRC-32 by bytes: its table comes from eight shifts of each byte, then each byte of the text is folded in.
_CRC = """tab AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda a, s: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(b)))"""

_OP1 = f"""
WITH {_CRC},
s AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, (strlen(coalesce(text, '')) + 1)::BIGINT AS size FROM documents),
k AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM s, tab),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id, text_crc32, size) AS nth FROM k),
c AS (SELECT *, least(15, ((2 * upto - size) * 16) // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY nth) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM c
"""

_OP5 = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY points DESC, doc_id) AS nth FROM n)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY digest ORDER BY nth) AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size, nth = 1 AS kept, digest AS text_sha256 FROM r
"""

_OP2 = r"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
every AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM raw),
trimmed AS (SELECT *, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS unit FROM every),
units AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY unit ORDER BY doc_id, pos) > 1 AS again FROM trimmed WHERE unit <> ''),
marked AS (SELECT t.doc_id, t.line, t.pos, coalesce(u.again, false) AS goes, u.pos IS NOT NULL AS counts FROM trimmed t LEFT JOIN units u ON t.doc_id = u.doc_id AND t.pos = u.pos)
SELECT doc_id, count(*) FILTER (counts) AS n_lines, count(*) FILTER (goes) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS text_sha256 FROM marked GROUP BY doc_id
"""

_OP7 = r"""
WITH listed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS parts FROM documents),
units AS (SELECT doc_id, unnest(parts) AS word, unnest(range(len(parts))) AS i, len(parts) AS n FROM listed),
runs AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS run FROM units),
again AS (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS again FROM runs WHERE i + 20 <= n),
cover AS (SELECT u.doc_id, u.word, u.i, coalesce(max(again::INTEGER) OVER (PARTITION BY u.doc_id ORDER BY u.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS goes FROM units u LEFT JOIN again a ON a.doc_id = u.doc_id AND a.i = u.i),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (goes) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT goes) AS text FROM cover GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

ORACLE_SQL = {"op1_sharding": _OP1, "op2_line_dedup": _OP2, "op5_exact_dedup": _OP5, "op7_substring_dedup": _OP7}
