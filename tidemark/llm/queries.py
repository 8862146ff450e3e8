"""Queries of the training-data operators.

But for the trie, none has oracle SQL: sampling, models, merges and graph components are not
expressible in it, so tests/llm compares each with a brute-force version, a round trip or held-out labels.
"""

from .op1_additive import op1_additive
from .op2_toxicity import op2_toxicity
from .op3_token_counts import op3_token_counts
from .op4_simhash import op4_simhash
from .op5_language_id import op5_language_id
from .op6_sampling import op6_sampling
from .op7_chunks import op7_chunks
from .op8_suffix_tree import op8_suffix_tree
from .op9_decontaminate import op9_decontaminate
from .op10_quality import op10_quality
from .op11_prefix_trie import op11_prefix_trie
from .op12_byte_bpe import op12_byte_bpe
from .op13_whitening import op13_whitening

_ALL = (op1_additive, op2_toxicity, op3_token_counts, op4_simhash, op5_language_id, op6_sampling, op7_chunks, op8_suffix_tree, op9_decontaminate, op10_quality, op11_prefix_trie, op12_byte_bpe, op13_whitening)
QUERIES = {f.__name__: f for f in _ALL}

TRIE = """WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sized AS (
  SELECT c, count(*) AS n, c - c % 100 AS base,
         xor(list_reduce([4294967295] || [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')], lambda acc, b:
           list_reduce([xor(acc, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h
  FROM own GROUP BY c),
convs AS (SELECT s.c, s.h, s.base, least(s.h, coalesce(b.n, 0)) AS head FROM sized s LEFT JOIN sized b ON b.c = s.base),
turns AS (
  SELECT convs.c, pos AS d, role, text FROM convs JOIN own ON own.c = base AND pos <= head
  UNION ALL SELECT convs.c, pos - h + head, role, text FROM convs JOIN own ON own.c = convs.c AND pos > h),
paths AS (
  SELECT c, d, length(text) AS chars, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d) AS prefix FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM paths GROUP BY d, prefix),
above AS (SELECT n.conv_id, n.d, p.conv_id AS parent FROM nodes n JOIN paths x ON x.c = n.conv_id AND x.d = n.d - 1 JOIN nodes p ON p.d = x.d AND p.prefix = x.prefix),
children AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM above GROUP BY ALL),
known AS (SELECT nodes.*, above.parent, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN above USING (conv_id, d) LEFT JOIN children ON children.parent = nodes.conv_id AND children.d = nodes.d),
subtree AS (
  SELECT x.d, x.prefix, sum((v.n_convs - 1) * v.chars) AS saved_tokens, count(*) FILTER (v.n_children = 0) AS n_leaves
  FROM known v JOIN paths x ON x.c = v.conv_id AND x.d <= v.d GROUP BY ALL),
finals AS (SELECT d, prefix, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM paths WHERE (c, d) IN (SELECT (c, max(d)) FROM paths GROUP BY c) GROUP BY ALL)
SELECT conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM known JOIN subtree USING (d, prefix) LEFT JOIN finals USING (d, prefix)"""
ORACLES: dict[str, str] = {"op11_prefix_trie": TRIE}
