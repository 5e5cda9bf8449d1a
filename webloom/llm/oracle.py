"""DuckDB SQL for the queries of this package that SQL can express.

The others (a trained classifier or model, XXH64, a tokenizer) are compared
with brute force in ``tests/llm``.
"""

# Words of a document, by place from 1.
_WORDS = r"""
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"""

# SHA-1 in base 32: five hexadecimal digits are four letters.
_BASE32 = """
array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((('0x' || substr(sha, CAST(5 * i + 1 AS INTEGER), 5))::INTEGER >> (15 - 5 * j)::INTEGER) & 31 AS INTEGER) + 1, 1)), '')), '')"""

OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""

OP7 = rf"""
WITH {_WORDS},
g AS (SELECT doc_id, k, ws[k:k + 7] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS k FROM w)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT k + o) AS n FROM r, range(8) t(o) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
             coalesce(text, '') AS text FROM documents),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             len(ls) AS n_lines, length(text) - length(translate(text, '!', '')) AS marks,
             len(list_filter(ws, lambda x: list_contains(STOPS, lower(x)))) AS stops
      FROM w JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 1.5 AND 25 AND n_symbols / greatest(n_words, 1) <= 0.3
         AND stops / greatest(n_words, 1) >= 0.01 AND n_dup_lines / greatest(n_lines, 1) <= 0.5
         AND marks / greatest(n_words, 1) <= 0.3 AS kept
FROM f
"""

OP8 = rf"""
WITH {_WORDS},
g AS (SELECT doc_id, k, array_to_string(ws[k:k + 12], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM w)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY gram) AS lo FROM g) WHERE lo < doc_id),
x AS (SELECT DISTINCT doc_id, k + o AS k FROM r, range(13) t(o)),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.k) AS text, count(*) AS n
         FROM e ANTI JOIN x ON e.doc_id = x.doc_id AND e.k = x.k GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

# The function words of the quality rules.
_STOPS = ("the of and to a in is that it for was on with as be der die das und zu den mit von ein eine nicht im des auf "
          "le la les de et un une du que pour pas en sur qui el los las y no por con para del se su al lo").split()

OP5 = """
WITH last AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
t AS (SELECT conv_id, turn, role, text, last FROM conversations JOIN last USING (conv_id) WHERE turn <= last),
s AS (SELECT conv_id, turn, 'prompt' AS part, role, text FROM t WHERE turn < last
      UNION ALL SELECT conv_id, turn, 'chosen', role, text FROM t WHERE turn = last
      UNION ALL SELECT conv_id, turn, 'rejected', role, substr(text, 1, CAST(length(text) // 2 AS INTEGER)) FROM t WHERE turn = last),
r AS (SELECT conv_id, turn, part, role, length(role) + 13 AS head,
             '<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS line
      FROM s)
SELECT conv_id AS pair_id, part, CAST(turn // 64 AS BIGINT) AS block, CAST(count(*) AS INTEGER) AS n_turns,
       string_agg(line, '' ORDER BY turn) AS text,
       CASE WHEN part = 'prompt' THEN '' ELSE min(head) || '-' || min(length(line) - 1) END AS loss,
       CASE WHEN part = 'prompt' THEN 0 ELSE CAST(min(length(line) - 1 - head) AS INTEGER) END AS n_loss
FROM r GROUP BY conv_id, part, turn // 64
"""

_SIGNS = r"[^0-9a-z\x{80}-\x{10FFFF}]|[\x{A0}«»“”„‘’‚…–—¿¡·]"


def _plain(table: str, key: str) -> str:
    return (f"(SELECT {key}, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '{_SIGNS}', ' ', 'g'), ' '), "
            f"lambda x: x <> '') AS w FROM {table})")


# The rule itself, without seeds: every place of a text where an item may reach 80 % shares three neighbouring
# words with it (at most two of 10 to 13 words differ, one of 6 to 9), so all such places are compared word by word.
# Items below six words count where they are the whole text.
OP3 = f"""
WITH d AS {_plain("documents", "doc_id")},
b AS (SELECT min(item_id) AS item_id, w FROM {_plain("benchmark", "item_id")} WHERE len(w) > 0 GROUP BY w),
bt AS (SELECT item_id, s, w[s] AS x, w[s + 1] AS y, w[s + 2] AS z FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS s FROM b WHERE len(w) >= 6)),
dt AS (SELECT doc_id, s, w[s] AS x, w[s + 1] AS y, w[s + 2] AS z FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d)),
hits AS (SELECT DISTINCT doc_id, item_id, dt.s - bt.s AS shift FROM dt JOIN bt USING (x, y, z)),
p AS (SELECT doc_id, item_id, shift, b.w AS bw, d.w AS dw, least(13, len(b.w)) AS width
      FROM hits JOIN b USING (item_id) JOIN d USING (doc_id)),
e AS (SELECT doc_id, item_id, width, list_transform(range(1, len(bw) + 1), lambda i:
        CASE WHEN i + shift >= 1 AND dw[i + shift] = bw[i] THEN 1 ELSE 0 END) AS eq FROM p),
m AS (SELECT doc_id, item_id, list_max(list_transform(range(1, len(eq) - width + 2), lambda i:
        list_sum(eq[i:i + width - 1]))) / width AS share FROM e
      UNION ALL SELECT doc_id, item_id, 1.0 FROM d JOIN b USING (w) WHERE len(b.w) < 6),
c AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, min(item_id) AS item_id, max(share) AS share
      FROM m WHERE share >= 0.8 GROUP BY doc_id)
SELECT documents.doc_id, c.n_items IS NOT NULL AS contaminated, coalesce(c.n_items, 0) AS n_items, c.item_id,
       CAST(coalesce(c.share, 0) AS DOUBLE) AS share
FROM documents LEFT JOIN c USING (doc_id)
"""

OP12 = """
WITH c AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, c.id, a.label = c.label AS own, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
      FROM c a JOIN c ON a.id % 100 = 0 AND a.id <> c.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT own AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""

# Counts of all phrases of one to four words; the parts of a cut are phrases themselves.
OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS g
      FROM w, range(1, 5) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, CAST(k AS INTEGER) AS k, g, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, a, string_split(g, ' ') AS ws FROM f WHERE k > 1 AND a >= 30),
o AS (SELECT DISTINCT x.lang, x.g FROM c x JOIN c y ON x.lang = y.lang AND y.k > x.k AND 100 * y.a >= 80 * x.a
      AND contains(' ' || y.g || ' ', ' ' || x.g || ' ')),
u AS (SELECT c.lang, c.g, a, t.cut, array_to_string(ws[1:cut], ' ') AS x, array_to_string(ws[cut + 1:], ' ') AS y
      FROM (SELECT * FROM c ANTI JOIN o ON c.lang = o.lang AND c.g = o.g) c, range(1, 4) t(cut) WHERE t.cut < c.k),
s AS (SELECT u.lang, u.g, u.a, cut, l.a AS l, r.a AS r, CAST(2000000::HUGEINT * u.a // (l.a + r.a) AS BIGINT) AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.g = x JOIN f r ON r.lang = u.lang AND r.g = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM b)
SELECT t.lang, rank, g AS phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op1_warc": OP1,
    "op3_decontaminate": OP3,
    "op5_preferences": OP5,
    "op7_quality": OP7.replace("STOPS", "[" + ", ".join(f"'{x}'" for x in _STOPS) + "]"),
    "op8_repeats": OP8,
    "op12_hard_negatives": OP12,
    "op13_collocations": OP13,
}
