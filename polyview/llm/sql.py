"""DuckDB SQL of the registered queries that SQL can express."""

# The CRC-32 is computed bit by bit; 3988292384 is its reversed polynomial.
MANIFEST = """
WITH RECURSIVE crc AS (
  SELECT DISTINCT doc_id, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) AS crc
  FROM documents),
fields AS (
  SELECT doc_id, source, text, crc % 2 = 0 AS hit,
    list_aggregate(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR],
      lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')), 'string_agg', '') AS head
  FROM documents LEFT JOIN crc USING (doc_id)),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(cut)::VARCHAR || ':' || cut, '-')) AS changed
  FROM (SELECT *, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS cut FROM fields)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
lower_levels AS (
  SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM numbered GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range((len(nodes) + 2) // 3),
    lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')))
  FROM lower_levels WHERE len(nodes) > 1),
subroots AS (
  SELECT source, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place
  FROM lower_levels WHERE len(nodes) = 1),
upper_levels AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 2) // 3),
    lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')))
  FROM upper_levels WHERE len(nodes) > 1),
steps AS (
  SELECT n.source, n.pos, l.level, n.pos // (3 ** l.level)::BIGINT AS node, l.nodes
  FROM numbered n JOIN lower_levels l ON n.source IS NOT DISTINCT FROM l.source WHERE len(l.nodes) > 1
  UNION ALL
  SELECT n.source, n.pos, s.height + u.level, s.place // (3 ** u.level)::BIGINT, u.nodes
  FROM numbered n JOIN subroots s ON n.source IS NOT DISTINCT FROM s.source JOIN upper_levels u ON len(u.nodes) > 1),
sides AS (
  SELECT source, pos, level,
    array_to_string(nodes[node - node % 3 + 1 : node], '') AS before,
    array_to_string(nodes[node + 2 : node - node % 3 + 3], '') AS after
  FROM steps),
proofs AS (
  SELECT source, pos, sha256(string_agg(before || after, '' ORDER BY level)) AS proof,
    list({'before': before, 'after': after} ORDER BY level) AS path
  FROM sides GROUP BY source, pos),
folding AS (
  SELECT n.source, n.pos, n.changed AS folded, coalesce(p.path, []) AS path, 1 AS step
  FROM numbered n LEFT JOIN proofs p ON n.source IS NOT DISTINCT FROM p.source AND n.pos = p.pos
  UNION ALL
  SELECT source, pos, sha256(path[step].before || folded || path[step].after), path, step + 1
  FROM folding WHERE step <= len(path)),
folds AS (SELECT source, pos, folded FROM folding WHERE step = len(path) + 1)
SELECT n.doc_id, n.leaf, s.subroot, r.nodes[1] AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
  f.folded AS folded_root, f.folded = r.nodes[1] AS verified
FROM numbered n
JOIN subroots s ON n.source IS NOT DISTINCT FROM s.source
JOIN folds f ON n.source IS NOT DISTINCT FROM f.source AND n.pos = f.pos
LEFT JOIN proofs p ON n.source IS NOT DISTINCT FROM p.source AND n.pos = p.pos
JOIN upper_levels r ON len(r.nodes) = 1
"""
