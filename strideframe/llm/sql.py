"""DuckDB SQL for the queries that SQL can express."""

from .licence_scan import oracle
from .spelling import RUN

#: CRC-32 of the UTF-8 bytes of ``{}`` by a table that follows from its polynomial.
_CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM (SELECT unnest(range(256)) AS i)))"


def _crc(text: str) -> str:
    pairs = f"hex(encode({text}))"
    values = f"list_transform(range(length({pairs}) // 2), lambda i: ('0x' || substr({pairs}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {values}), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])))"


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_MANIFEST = f"""WITH RECURSIVE {_CRC_TABLE},
marked AS (SELECT *, coalesce({_crc("doc_id::VARCHAR")} % 7 = 0, false) AS hit FROM documents, crc_table),
leaves AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("CASE WHEN hit THEN n_chars + 1 ELSE n_chars END")} AS tampered FROM marked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (SELECT lang, 0 AS level, pos, leaf AS h, n FROM ranked
  UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2),
subroots AS (SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS m FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, place AS pos, subroot AS h, m AS n FROM subroots
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, pos // 2),
summit AS (SELECT h AS root, level AS top_height FROM tops WHERE n = 1),
steps AS (
  SELECT r.lang, r.pos, k.level AS step, CASE WHEN (r.pos >> k.level) % 2 = 1 THEN s.h ELSE '' END AS before, CASE WHEN (r.pos >> k.level) % 2 = 0 THEN coalesce(s.h, '') ELSE '' END AS after
  FROM ranked r JOIN subroots b ON r.lang IS NOT DISTINCT FROM b.lang, LATERAL (SELECT unnest(range(b.height)) AS level) k
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM r.lang AND s.level = k.level AND s.pos = xor(r.pos >> k.level, 1)
  UNION ALL
  SELECT r.lang, r.pos, b.height + k.level, CASE WHEN (b.place >> k.level) % 2 = 1 THEN s.h ELSE '' END, CASE WHEN (b.place >> k.level) % 2 = 0 THEN coalesce(s.h, '') ELSE '' END
  FROM ranked r JOIN subroots b ON r.lang IS NOT DISTINCT FROM b.lang, LATERAL (SELECT unnest(range(top_height)) AS level FROM summit) k
  LEFT JOIN tops s ON s.level = k.level AND s.pos = xor(b.place >> k.level, 1)),
proofs AS (SELECT lang, pos, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM steps GROUP BY lang, pos),
folds AS (SELECT lang, pos, 0 AS step, tampered AS h FROM ranked
  UNION ALL SELECT f.lang, f.pos, f.step + 1, sha256(s.before || f.h || s.after) FROM folds f JOIN steps s ON f.lang IS NOT DISTINCT FROM s.lang AND f.pos = s.pos AND f.step = s.step)
SELECT r.doc_id, r.leaf, b.subroot, root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM ranked r JOIN subroots b ON r.lang IS NOT DISTINCT FROM b.lang, summit
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM r.lang AND p.pos = r.pos
JOIN folds f ON f.lang IS NOT DISTINCT FROM r.lang AND f.pos = r.pos AND f.step = b.height + top_height"""

_SPELLING = f"""WITH RECURSIVE {_CRC_TABLE},
texts AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{RUN}')) AS run FROM texts) GROUP BY doc_id, run),
hashed AS (SELECT *, {_crc("doc_id::VARCHAR || ':' || run")} AS h FROM runs, crc_table),
spelt AS (SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
vocab AS (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
holes AS (SELECT word, n, length(word) AS size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM holes a JOIN vocab v ON a.rest = v.word
  UNION SELECT v.word, v.n, a.word, a.n FROM holes a JOIN vocab v ON a.rest = v.word),
best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near),
words AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM vocab v LEFT JOIN best b ON v.word = b.word AND place = 1),
roots AS (SELECT word, word AS root FROM words WHERE form IS NULL UNION ALL SELECT w.word, r.root FROM words w JOIN roots r ON w.form = r.word)
SELECT word, form, root, n, n_near, form_n FROM words JOIN roots USING (word)"""

ORACLES: dict[str, str] = {"op2_licence_scan": oracle(), "op12_manifest": _MANIFEST, "op13_spelling_variants": _SPELLING}
