"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from matlink.llm.decontaminate import op4_benchmark_decontamination
from matlink.llm.hmm import op6_hmm_score
from matlink.llm.html_text import op7_html_main_text
from matlink.llm.kneser_ney import op5_quality_perplexity
from matlink.llm.language_id import op10_language_id
from matlink.llm.merkle import op12_merkle_manifest
from matlink.llm.ngram_join import op2_ngram_jaccard_join
from matlink.llm.packing import op1_packing
from matlink.llm.simhash import op3_simhash_fingerprints
from matlink.llm.substring_dedup import op8_substring_dedup
from matlink.llm.suffix_dedup import op13_suffix_dedup
from matlink.llm.warc import op9_warc
from matlink.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_packing": op1_packing,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_simhash_fingerprints": op3_simhash_fingerprints,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_quality_perplexity": op5_quality_perplexity,
    "op6_hmm_score": op6_hmm_score,
    "op7_html_main_text": op7_html_main_text,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_suffix_dedup": op13_suffix_dedup,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_TAMPERED = _FIELD.format(_LOWER.format("text"))
_CRC = "xor(list_reduce(list_prepend(4294967295, [ascii(x) for x in string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"

#: The others tokenise, fit a model or vote on bits; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1) + 1))) AS i FROM w) AS t),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g AS x JOIN g AS y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) AS p
      JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) AS m ON m.a = w.doc_id""",
    "op4_benchmark_decontamination": f"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS ws FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS s FROM (SELECT item, ws, least(len(ws), 13) AS n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM iw WHERE len(ws) > 0) AS t),
dwin AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win) AS k WHERE len(ws) >= n) AS t),
f AS (SELECT doc_id, i, n, item FROM dwin JOIN win USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM f) AS t GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM f GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM w LEFT JOIN h ON h.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id""",
    "op8_substring_dedup": f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20) AS t),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM s) AS t WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM r),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM u ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id""",
    "op12_merkle_manifest": f"""WITH RECURSIVE leaves AS (SELECT doc_id, lang, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
  CASE WHEN {_CRC} % 3 = 0 THEN sha256({_HEAD} || {_TAMPERED}) ELSE sha256({_HEAD} || {_FIELD.format("text")}) END AS claimed FROM documents),
placed AS (SELECT *, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM leaves),
up AS (SELECT tree, 0 AS level, place, leaf AS node, count(*) OVER (PARTITION BY tree) AS total FROM placed
  UNION ALL SELECT tree, level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (total + 7) // 8 FROM up WHERE total > 1 GROUP BY tree, level, place // 8, total),
subs AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM up WHERE total = 1),
top AS (SELECT 1000 AS level, place, subroot AS node, count(*) OVER () AS total FROM subs
  UNION ALL SELECT level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (total + 7) // 8 FROM top WHERE total > 1 GROUP BY level, place // 8, total),
sides AS (SELECT a.tree, a.level, a.place, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS r
    FROM up AS a JOIN up AS b ON b.tree = a.tree AND b.level = a.level AND b.place // 8 = a.place // 8 WHERE a.total > 1 GROUP BY a.tree, a.level, a.place
  UNION ALL SELECT '', a.level, a.place, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), ''), coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '')
    FROM top AS a JOIN top AS b ON b.level = a.level AND b.place // 8 = a.place // 8 WHERE a.total > 1 GROUP BY a.level, a.place),
climb AS (SELECT doc_id, tree, 0 AS level, place, claimed AS node, '' AS proof FROM placed
  UNION ALL SELECT c.doc_id, CASE WHEN s.l IS NULL THEN '' ELSE c.tree END, CASE WHEN s.l IS NULL THEN 1000 ELSE c.level + 1 END, CASE WHEN s.l IS NULL THEN u.place ELSE c.place // 8 END,
    CASE WHEN s.l IS NULL THEN c.node ELSE sha256(s.l || c.node || s.r) END, CASE WHEN s.l IS NULL THEN c.proof ELSE c.proof || s.l || s.r END
    FROM climb AS c LEFT JOIN sides AS s ON s.tree = c.tree AND s.level = c.level AND s.place = c.place LEFT JOIN subs AS u ON u.tree = c.tree WHERE s.l IS NOT NULL OR c.tree <> ''),
folded AS (SELECT doc_id, node, proof FROM climb AS c WHERE tree = '' AND NOT EXISTS (SELECT 1 FROM sides AS s WHERE s.tree = '' AND s.level = c.level AND s.place = c.place))
SELECT p.doc_id, p.leaf, u.subroot, t.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = t.node AS verified
FROM placed AS p JOIN folded AS f ON f.doc_id = p.doc_id JOIN subs AS u ON u.tree = p.tree JOIN (SELECT node FROM top WHERE total = 1) AS t ON true""",
    "op13_suffix_dedup": """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(1, strlen(x) // 2 - 398)) AS i FROM b WHERE strlen(x) >= 800) AS t),
r AS (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS head FROM r),
g AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o) AS t GROUP BY doc_id, k),
e AS (SELECT doc_id, b AS lo, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS hi FROM g UNION ALL SELECT doc_id, 1, min(a) FROM g GROUP BY doc_id),
k AS (SELECT e.doc_id, string_agg(substr(x, CAST(2 * lo - 1 AS BIGINT), CAST(2 * (coalesce(hi, strlen(x) // 2 + 1) - lo) AS BIGINT)), '' ORDER BY lo) AS kept FROM e JOIN b ON b.doc_id = e.doc_id GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM g GROUP BY doc_id)
SELECT b.doc_id, strlen(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM b LEFT JOIN k ON k.doc_id = b.doc_id LEFT JOIN n ON n.doc_id = b.doc_id""",
    "op9_warc": """WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM d LEFT JOIN f USING (payload_digest)""",
}
