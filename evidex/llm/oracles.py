"""Oracle SQL of the operators that SQL can express, over the whole tables."""

from __future__ import annotations

from evidex.llm.rules import BANDS, LEVELS, N_LEVELS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: CRC-32 by half bytes: the table of 16 is built from the polynomial.
_CRC = """v_t AS (SELECT list_transform(range(16), lambda i: list_reduce(range(4), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
  v_h AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, t, hex(encode(coalesce(text, ''))) AS h FROM documents, v_t),
  v_b AS (SELECT doc_id, size, t, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1 : 2 * i])::BIGINT) AS bytes FROM v_h),
  v_s AS (SELECT doc_id, size::BIGINT AS size, xor(4294967295, list_reduce(bytes, lambda c, b: xor(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) >> 4, t[(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) & 15) + 1]), 4294967295)) AS text_crc32 FROM v_b)"""

SHARDS = f"""WITH {_CRC}, v_p AS (SELECT *, sum(size) OVER (ORDER BY text_crc32, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM v_s),
  v_g AS (SELECT *, min(start) OVER g AS from_, count(*) OVER g * size AS bytes FROM v_p WINDOW g AS (PARTITION BY text_crc32, size)),
  v_c AS (SELECT *, least(39, CASE WHEN bytes * 400 <= total THEN ((2 * from_ + bytes) * 40) // (2 * total) ELSE ((2 * start + size) * 40) // (2 * total) END)::INT AS shard FROM v_g)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY text_crc32, size, doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM v_c"""

MIX = f"""WITH v_d AS (SELECT doc_id, source, len({WORDS}) AS size, md5(coalesce(text, '')) AS text_md5 FROM documents),
  v_z AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source IS NULL, source) AS nth FROM v_d GROUP BY source),
  v_w AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][(nth - 1) % 3 + 1] AS w, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total FROM v_z),
  v_l AS (SELECT *, row_number() OVER f AS fill, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v_w WINDOW f AS (ORDER BY cap / w, nth)),
  v_g AS (SELECT *, least(cap, coalesce(w * (SELECT level FROM v_l WHERE cap > w * level ORDER BY fill LIMIT 1), cap)) AS target FROM v_l),
  v_h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM v_g),
  v_i AS (SELECT *, target - whole * source_size AS wanted, greatest(source_size, 1) / n AS mean FROM v_h),
  v_u AS (SELECT d.doc_id, d.size, d.text_md5, i.*, (('0x' || md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.text_md5)[1:11])::BIGINT + 0.5::DOUBLE) / 17592186044416.0::DOUBLE AS u FROM v_d d JOIN v_i i ON d.source IS NOT DISTINCT FROM i.source),
  v_o AS (SELECT *, least(wanted / greatest(source_size, 1), 1 - 1e-12) AS p FROM v_u),
  v_q AS (SELECT *, p / (1 - p) * sqrt(size / mean) AS odds FROM v_o),
  v_r AS (SELECT *, sum(size) OVER (PARTITION BY nth ORDER BY CASE WHEN odds > 0 THEN u / (1 - u) / odds ELSE 1e300 END, doc_id, text_md5 ROWS UNBOUNDED PRECEDING) AS upto FROM v_q)
SELECT doc_id, size, source_size, target, (whole + CASE WHEN size > 0 AND upto - size / 2.0::DOUBLE <= wanted THEN 1 ELSE 0 END)::BIGINT * size AS taken FROM v_r"""

_PASSED = ", ".join(f"len(list_filter({cuts}, lambda c: c >= {s}))" for s, cuts in LEVELS.items())

RULES = f"""WITH v_d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
  v_g AS (SELECT doc_id, i, ws[i : i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM v_d)),
  v_rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM v_g), (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY doc_id),
  v_l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM v_d),
  v_b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(text) AS n_chars_all, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
    FROM v_d JOIN v_l USING (doc_id) LEFT JOIN v_rep USING (doc_id)),
  v_m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {' + '.join(f'(n_words >= {b})::INT' for b in BANDS)} AS band,
    coalesce(1000 * n_symbols // nullif(n_chars_all, 0), 0) AS symbol_permille, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_line_permille,
    coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeat_word_permille, coalesce(1000 * word_chars // nullif(n_words, 0), 0) AS long_word_permille, coalesce(1000 * n_upper // nullif(word_chars, 0), 0) AS upper_permille FROM v_b),
  v_p AS (SELECT *, least({_PASSED}) AS passed FROM v_m),
  v_k AS (SELECT band, j, count(*) AS n, count(*) FILTER (WHERE passed <= j) AS k FROM v_p, (SELECT unnest(range({N_LEVELS})) AS j) WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY band, j),
  v_t AS (SELECT band, j, k <= 0.02 * n AND list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02::DOUBLE) + (n - i) * ln(0.98::DOUBLE)))) <= 0.05 / {len(BANDS) + 1} AS ok FROM v_k),
  v_level AS (SELECT band, coalesce(min(j) FILTER (WHERE NOT ok), {N_LEVELS}) - 1 AS level FROM v_t GROUP BY band)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passed > coalesce(level, -1) AS kept, band FROM v_p LEFT JOIN v_level USING (band)"""

#: Words one edit apart agree without one code point each: at one place if replaced, or one of them is the other's rest.
SPELLING = r"""WITH v_t AS (SELECT list_transform(range(16), lambda i: list_reduce(range(4), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
  v_r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]{7,}')) AS run FROM documents),
  v_k AS (SELECT run, hex(encode(id || ':' || run)) AS h, count(*) AS n FROM v_r GROUP BY id, run),
  v_b AS (SELECT run, n, t, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1 : 2 * i])::BIGINT) AS bytes FROM v_k, v_t),
  v_h AS (SELECT run, n, xor(4294967295, list_reduce(bytes, lambda c, b: xor(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) >> 4, t[(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) & 15) + 1]), 4294967295)) AS h FROM v_b),
  v_w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM v_h),
  v_v AS (SELECT word, sum(n)::BIGINT AS n FROM v_w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
  v_x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v_v)),
  v_near AS (SELECT a.word, b.word AS other FROM v_x a JOIN v_x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT x.word, v.word FROM v_x x JOIN v_v v ON x.rest = v.word UNION SELECT v.word, x.word FROM v_x x JOIN v_v v ON x.rest = v.word),
  v_rank AS (SELECT a.word, a.other, b.n, row_number() OVER (PARTITION BY a.word ORDER BY b.n DESC, a.other) AS nth FROM v_near a JOIN v_v b ON b.word = a.other),
  v_best AS (SELECT word, count(*) AS n_near, max(other) FILTER (WHERE nth = 1) AS other, max(n) AS best_n FROM v_rank GROUP BY word),
  v_f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * n THEN other END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM v_v v LEFT JOIN v_best USING (word)),
  v_up AS (WITH RECURSIVE up(word, root) AS (SELECT word, word FROM v_f UNION ALL SELECT up.word, f.form FROM up JOIN v_f f ON f.word = up.root WHERE f.form IS NOT NULL)
    SELECT up.word, up.root FROM up JOIN v_f f ON f.word = up.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM v_f JOIN v_up USING (word)"""

MIDDLES = """WITH v_h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
  v_u AS (SELECT *, ('0x' || s[1:8])::BIGINT % (n + 1) AS one, ('0x' || s[9:16])::BIGINT % (n + 1) AS two, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM v_h),
  v_f AS (SELECT *, least(one, two) AS a, greatest(one, two) AS b, CASE WHEN n = 0 OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM v_u),
  v_p AS (SELECT *, '<P>' || substr(t, 1, a) AS p, '<S>' || substr(t, b + 1) AS x, '<M>' || substr(t, a + 1, b - a) AS m FROM v_f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || x || m ELSE x || p || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM v_p"""

ORACLE_SQL = {"op4_quality_rules": RULES, "op5_sharding": SHARDS, "op10_mixing": MIX, "op12_spelling": SPELLING, "op13_fill_in_middle": MIDDLES}
