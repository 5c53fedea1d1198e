"""DuckDB statements of the registered queries that SQL can express, written from their definitions."""

from __future__ import annotations


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


#: crc32 bit by bit over the digits of doc_id.
_CRC = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: ascii(c)::BIGINT), lambda crc, byte: list_reduce([xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

#: Trees of lists of nodes: level by level in full, proofs by their index.
MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS id, doc_id, lang, {_leaf('n_chars')} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS shown
  FROM documents),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (
  SELECT lang, 0 AS level, i, leaf AS node, n FROM ordered
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 1) // 2
  FROM tree WHERE n > 1 GROUP BY lang, level, i // 2),
subs AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i,
    count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, i, subroot AS node, n FROM subs
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 1) // 2
  FROM top WHERE n > 1 GROUP BY level, i // 2),
steps AS (
  SELECT id, l.level, (o.i >> l.level) % 2 AS slot, coalesce(s.node, '') AS other
  FROM ordered o JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) l
    ON l.lang IS NOT DISTINCT FROM o.lang
  LEFT JOIN tree s ON s.level = l.level AND s.lang IS NOT DISTINCT FROM o.lang
    AND s.i = xor(o.i >> l.level, 1)
  UNION ALL
  SELECT id, 1000 + l.level, (b.i >> l.level) % 2, coalesce(s.node, '')
  FROM ordered o JOIN subs b ON b.lang IS NOT DISTINCT FROM o.lang
  CROSS JOIN (SELECT DISTINCT level FROM top WHERE n > 1) l
  LEFT JOIN top s ON s.level = l.level AND s.i = xor(b.i >> l.level, 1)),
walks AS (
  SELECT id, array_agg(slot ORDER BY level) AS slots, array_agg(other ORDER BY level) AS others
  FROM steps GROUP BY id),
folds AS (
  SELECT id, 0 AS done, shown AS node FROM ordered
  UNION ALL
  SELECT id, done + 1, sha256(CASE WHEN slots[done + 1] = 1 THEN others[done + 1] || node
    ELSE node || others[done + 1] END)
  FROM folds JOIN walks USING (id) WHERE done < len(slots))
SELECT doc_id, leaf, subroot, root.node AS root, sha256(coalesce(array_to_string(others, ''), '')) AS proof_sha256,
  f.node AS folded_root, f.node = root.node AS verified
FROM ordered o JOIN subs s ON s.lang IS NOT DISTINCT FROM o.lang
CROSS JOIN (SELECT node FROM top WHERE n = 1) root
LEFT JOIN walks w USING (id)
JOIN folds f ON f.id = o.id AND f.done = coalesce(len(slots), 0)
"""

#: Phrases of the definition, counted one by one; each cut looked up in the counts of all phrases.
PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents WHERE text IS NOT NULL),
worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2),
    lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size),
counts AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2 AND a >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, h.a AS l, t.a AS r,
    (1000000 * c.a::HUGEINT * c.a) // (h.a::HUGEINT * t.a) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[k + 1 :], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase, a
  FROM candidates WHERE size = 3),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i
    WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 50 * b.a)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
