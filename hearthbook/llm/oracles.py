"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

OP6 = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w
  FROM documents
), item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w
  FROM benchmark
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM item_words WHERE len(w) >= 5)
), sizes AS (
  SELECT item_id, count(*) AS q FROM item_shingles GROUP BY item_id
)
SELECT doc_id, item_id, count(*) AS shared, q AS item_shingles, count(*) / q AS containment
FROM shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, q HAVING count(*) * 10 >= q * 8
"""

# crc32 by bits: -1 stands for one shift, other numbers are bytes to take in.
OP11 = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), sums AS (
  SELECT conv_id, conv_id - conv_id % 5 AS lender, n, list_reduce(
      list_concat([4294967295], flatten(list_transform(
        range(1, length(conv_id::VARCHAR) + 1),
        lambda i: [ord(substr(conv_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
        ELSE xor(crc >> 1, CASE WHEN crc % 2 = 1 THEN 3988292384 ELSE 0 END) END) AS crc
  FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id)
), plan AS (
  SELECT s.conv_id, s.lender, CASE WHEN s.conv_id = s.lender THEN 0 ELSE xor(s.crc, 4294967295) % 9 END AS h,
    coalesce(l.n, 0) AS lent
  FROM sums s LEFT JOIN sums l ON l.conv_id = s.lender
), rebuilt AS (
  SELECT p.conv_id, t.place AS depth, t.role, t.text
  FROM plan p JOIN turns t ON t.conv_id = p.lender AND t.place <= p.h
  UNION ALL
  SELECT p.conv_id, t.place - p.h + least(p.h, p.lent), t.role, t.text
  FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.place > p.h
), whole AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY depth) AS said FROM rebuilt GROUP BY conv_id
), prefixes AS (
  SELECT conv_id, coalesce(len(said), 0) AS length, unnest(range(coalesce(len(said), 0) + 1)) AS depth,
    coalesce(said, []) AS said
  FROM plan LEFT JOIN whole USING (conv_id)
), keyed AS (
  SELECT conv_id, depth, depth = length AS ended, said[1:depth] AS prefix, said[1:depth - 1] AS above,
    CASE WHEN depth > 0 THEN octet_length(encode(said[depth].t)) ELSE 0 END AS bytes
  FROM prefixes
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256
  FROM keyed GROUP BY prefix, depth
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN nodes p ON p.prefix = n.above AND p.depth = n.depth - 1
), children AS (
  SELECT above, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), open AS (
  SELECT l.*, coalesce(c.n, 0) AS n_children
  FROM linked l LEFT JOIN children c ON c.above = l.prefix AND c.depth = l.depth
), above AS (
  SELECT k.prefix, k.depth, o.n_children, (o.n_convs - 1) * o.bytes AS saved
  FROM open o JOIN keyed low ON low.conv_id = o.conv_id AND low.depth = o.depth
    JOIN keyed k ON k.conv_id = o.conv_id AND k.depth <= o.depth
), below AS (
  SELECT prefix, depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM above GROUP BY prefix, depth
)
SELECT conv_id, o.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM open o JOIN below b ON b.prefix = o.prefix AND b.depth = o.depth
"""

OP13 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS one, b.doc_id AS two, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY ALL
), links AS (
  SELECT one, two FROM shared JOIN sizes x ON x.doc_id = one JOIN sizes y ON y.doc_id = two
  WHERE 100 * common >= 80 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id, doc_id AS other FROM words
  UNION
  SELECT r.doc_id, l.two FROM reach r JOIN links l ON l.one = r.other
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

ORACLES: dict[str, str] = {"op6_decontamination": OP6, "op11_prefix_trie": OP11, "op13_jaccard_groups": OP13}
