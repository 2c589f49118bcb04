"""DuckDB twins of the operators from 11 on: plain forms of the same results, without sketches' merging, reduced alphabets or parentheses."""

#: The crc32 of a list of bytes: eight steps to a byte, by the reversed polynomial 0xEDB88320.
STEP = "CASE WHEN {c} % 2 = 1 THEN xor({c} // 2, 3988292384) ELSE {c} // 2 END"


def crc32(of: str) -> str:
    """SQL for the unsigned crc32 of a BIGINT list of bytes."""
    bits = f"list_reduce([0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda c, k: {STEP.format(c='c')}, xor(s, b))"
    return f"xor(list_reduce({of}, lambda s, b: {bits}, 4294967295::BIGINT), 4294967295)"


OP11_SQL = f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents WHERE text IS NOT NULL),
lower_runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM runs GROUP BY 1, 2),
hashed AS (SELECT w, k, {crc32("flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END))")} AS h FROM lower_runs WHERE length(w) >= 5),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
v AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
at_ AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
gap AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS g FROM at_),
near AS (SELECT a.word, b.word AS near, b.n AS m FROM gap a JOIN gap b ON a.g = b.g AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM gap g JOIN v ON v.word = g.g UNION SELECT v.word, g.word, g.n FROM gap g JOIN v ON v.word = g.g),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -m, near := near)) AS b FROM near GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * v.n THEN b.near END AS form, CASE WHEN -b.less >= 2 * v.n THEN -b.less END AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, at_word, depth) AS (SELECT word, word, 0 FROM f UNION ALL SELECT w.word, f.form, w.depth + 1 FROM walk w JOIN f ON f.word = w.at_word WHERE f.form IS NOT NULL),
last_ AS (SELECT word, max_by(at_word, depth) AS root FROM walk GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM f JOIN last_ USING (word)"""


def _fences(level: str, keys: str) -> str:
    """Fences of one level: medians and quartiles of bucket counts."""
    group = f"{keys}, " if keys else ""
    return f"""{level}_b AS (SELECT {group}rule, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
{level}_u AS (SELECT *, sum(n) OVER (PARTITION BY {group}rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {group}rule) AS docs FROM {level}_b),
{level}_q AS (SELECT {group}rule, max(docs)::BIGINT AS docs, min(bucket) FILTER (upto * 4 >= docs) AS q1, min(bucket) FILTER (upto * 4 >= docs * 2) AS q2, min(bucket) FILTER (upto * 4 >= docs * 3) AS q3 FROM {level}_u GROUP BY ALL),
{level} AS (SELECT {group}max(docs) AS docs, {', '.join(f"max(q2 + 5 * greatest(q3 - q1, {least})) FILTER (rule = '{r}') AS {r}_high" for r, least in RULES)},
  max(q2 - 5 * greatest(q3 - q1, 30)) FILTER (rule = 'word_length') AS word_length_low FROM {level}_q {f'GROUP BY {keys}' if keys else ''})"""


RULES = [("symbols", 80), ("word_length", 30), ("dup_lines", 1000), ("repeats", 800)]
OP12_SQL = rf"""WITH t AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT k, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i:i + 2])) AS g FROM w WHERE len(words) >= 3),
twice AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win),
rep AS (SELECT k, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM twice WHERE c > 1) GROUP BY 1),
m AS (SELECT k, doc_id, lang, source, len(words)::BIGINT AS n_words, (length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN rep USING (k)),
p AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (SELECT *, 10000 * n_symbols // nullif(word_chars, 0) AS symbols, 100 * word_chars // nullif(n_words, 0) AS word_length, 10000 * n_dup_lines // nullif(n_lines, 0) AS dup_lines, 10000 * n_repeat_words // nullif(n_words, 0) AS repeats FROM p),
x AS (SELECT lang, source, r.rule, r.v FROM (SELECT lang, source, unnest([{', '.join(f"struct_pack(rule := '{r}', v := {r})" for r, _ in RULES)}]) AS r FROM v WHERE NOT base_failed)),
sketch AS (SELECT lang, source, rule, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket, count(*) AS n FROM x GROUP BY ALL),
{_fences('own', 'lang, source')},
{_fences('of_lang', 'lang')},
{_fences('of_all', '')},
j AS (SELECT v.*, CASE WHEN own.docs >= 200 THEN 0 WHEN of_lang.docs >= 200 THEN 1 ELSE 2 END AS level,
  {', '.join(f"CASE WHEN own.docs >= 200 THEN own.{c} WHEN of_lang.docs >= 200 THEN of_lang.{c} ELSE of_all.{c} END AS {c}" for c in [*(f'{r}_high' for r, _ in RULES), 'word_length_low'])}
  FROM v LEFT JOIN own ON own.lang IS NOT DISTINCT FROM v.lang AND own.source IS NOT DISTINCT FROM v.source LEFT JOIN of_lang ON of_lang.lang IS NOT DISTINCT FROM v.lang, of_all),
o AS (SELECT *, list_filter([CASE WHEN symbols > symbols_high THEN 'symbols' END, CASE WHEN word_length > word_length_high OR word_length < word_length_low THEN 'word_length' END,
  CASE WHEN dup_lines > dup_lines_high THEN 'dup_lines' END, CASE WHEN repeats > repeats_high THEN 'repeats' END], lambda r: r IS NOT NULL AND NOT base_failed) AS failed_rules FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed_rules) = 0 AS kept, failed_rules, level FROM o"""

OP13_SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, t.pos, t.role, t.text, 0 AS part FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h UNION ALL SELECT c.conv_id, t.pos, t.role, t.text, 1 FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text FROM r),
path AS (SELECT conv_id, depth, strlen(text) AS bytes, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM d
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
last_ AS (SELECT conv_id, max_by(key, depth) AS key FROM path GROUP BY 1),
e AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM last_ GROUP BY 1),
n AS (SELECT key, any_value(depth)::BIGINT AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes)::BIGINT AS bytes FROM path GROUP BY 1),
kids AS (SELECT substr(key, 1, length(key) - 64) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
up AS (SELECT key, unnest(range(0, length(key) + 1, 64)) AS cut, n_convs, bytes, key NOT IN (SELECT key FROM kids) AS leaf FROM n),
sub AS (SELECT substr(key, 1, cut) AS key, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM up GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM n LEFT JOIN n p ON n.depth > 0 AND p.key = substr(n.key, 1, length(n.key) - 64) LEFT JOIN kids ON kids.key = n.key JOIN sub ON sub.key = n.key LEFT JOIN e ON e.key = n.key"""
