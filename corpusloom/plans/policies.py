"""Queries: policy units of nested sections, semantic nodes of layouts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import layout as L
from corpusloom.operators import sections as S
from corpusloom.operators import spatial
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval import strip
from corpusloom.plans.views import using
from corpusloom.sources import corpus as C

# Lines of up to four words stand for headings, the fewer words the higher; words of the test texts stand for signals.
WORD = "(^| )({})( |$)"
RISK = ((WORD.format("stupid|idiot|ist"), "critical", "internal_process_disclosure"), (WORD.format("inoran"), "high", "disclosure_control"), (WORD.format("elle"), "high", "qa_compliance"))
SAID = (("call", WORD.format("are|est")), ("chat", WORD.format("die|was|une")), ("email", WORD.format("que|from|der")))
GROUPS = (("wording_rule", WORD.format("the|la|die")), ("handling_rule", WORD.format("of|de|und")), ("compliance_rule", ""))
IF = "(?i)^(in .*?)(\\s*,\\s*)(.*)$"
# Words of these patterns and of the types: a text's patterns are tried on those of them that it has, after a mark if it opens like an operational note.
LOOKED_FOR = sorted({w for p in (*(x[0] for x in RISK), *(x[1] for x in SAID), *(x[1] for x in GROUPS), "with con avec the by pour an are die of en de und") for w in re.findall("[a-z]+", p)})
OPENS = "> "


def _types(text, section, kind):
    has = lambda c, words: c.rlike(WORD.format(words))
    return [("wording_rule", has(text, "with|con|avec") | has(section, "the")), ("example", has(text, "by|pour")), ("operational_note", text.startswith(OPENS)), ("macro_script", has(text, "an") & (has(text, "are|die") | has(section, "of|en"))), ("handling_rule", (kind == "list_item") | has(text, "of|de|und"))]


def _signs(text):
    words = F.array_intersect(F.split(text, " "), F.array(*map(F.lit, LOOKED_FOR)))
    return F.concat(F.when(text.rlike("^(la|it|er|el) "), OPENS).otherwise(""), F.array_join(words, " "))


def _rlike(x: str, words: str) -> str:
    return f"regexp_matches({x}, '{WORD.format(words)}')"


def _said(x: str) -> str:
    return f"list_filter([{', '.join(f'''CASE WHEN regexp_matches({x}, '{p}') THEN '{c}' END''' for c, p in SAID)}], lambda x: x IS NOT NULL)"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({strip(x)}), '[^a-z0-9]+', ' ', 'g'))"


UPTO = "OVER (PARTITION BY version_id ORDER BY chunk_index)"
OPEN = ", ".join(f"max(CASE WHEN level = {k} THEN chunk_index END) {UPTO} AS h{k}, last_value(CASE WHEN level = {k} THEN content END IGNORE NULLS) {UPTO} AS t{k}" for k in range(1, 5))
PATH = ", ".join(f"CASE WHEN h{k} > coalesce(greatest({', '.join(f'h{j}' for j in range(1, k))}{', ' if k > 1 else ''}-1), -1) THEN trim(t{k}) END" for k in range(1, 5))
K6_SQL = f""", b AS (SELECT version_id, chunk_index, content, CASE WHEN len(string_split(content, ' ')) <= 4 THEN len(string_split(content, ' ')) END AS level, CASE WHEN starts_with(content, 'The ') OR starts_with(content, 'A ') THEN 'list_item' ELSE 'paragraph' END AS kind, CASE WHEN starts_with(content, 'A ') THEN 'a' END AS list_group FROM kb_units),
o AS (SELECT *, {OPEN} FROM b), p AS (SELECT *, list_filter([{PATH}], lambda x: x IS NOT NULL) AS path FROM o),
n AS (SELECT version_id, chunk_index, content, level, kind, list_group, array_to_string(path, ' > ') AS section, array_to_string(path[1:len(path) - 1], ' > ') AS above, {_norm('content')} AS plain, {_norm("array_to_string(path, ' > ')")} AS head FROM p),
r AS (SELECT *, CASE WHEN {_rlike('plain', 'stupid|idiot|ist')} THEN 3 WHEN {_rlike('plain', 'inoran|elle')} THEN 2 ELSE 0 END AS risk, CASE WHEN {_rlike('plain', 'stupid|idiot|ist')} THEN 'internal_process_disclosure' WHEN {_rlike('plain', 'inoran')} THEN 'disclosure_control' WHEN {_rlike('plain', 'elle')} THEN 'qa_compliance' ELSE '' END AS category FROM n),
k AS (SELECT *, {_said("head || ' ' || plain")} AS own, {_said('plain')} AS said, CASE WHEN level IS NOT NULL THEN NULL WHEN risk >= 2 THEN CASE category WHEN 'qa_compliance' THEN 'warning' ELSE 'compliance_rule' END WHEN {_rlike('plain', 'with|con|avec')} OR {_rlike('head', 'the')} THEN 'wording_rule'
  WHEN {_rlike('plain', 'by|pour')} THEN 'example' WHEN regexp_matches(plain, '^(la|it|er|el) ') THEN 'operational_note' WHEN {_rlike('plain', 'an')} AND ({_rlike('plain', 'are|die')} OR {_rlike('head', 'of|en')}) THEN 'macro_script' WHEN kind = 'list_item' OR {_rlike('plain', 'of|de|und')} THEN 'handling_rule' END AS unit_type FROM r),
d AS (SELECT version_id, list_sort(list_distinct(flatten(list(said)))) AS doc_channels, max(risk) AS risk, min(chunk_index) AS first_index, count(unit_type) AS n FROM k GROUP BY 1),
u AS (SELECT *, CASE unit_type WHEN 'wording_rule' THEN CASE WHEN {_rlike('plain', 'the|la|die')} THEN unit_type END WHEN 'handling_rule' THEN CASE WHEN {_rlike('plain', 'of|de|und')} THEN unit_type END WHEN 'compliance_rule' THEN unit_type END AS grouped, CASE WHEN unit_type = 'handling_rule' THEN coalesce(list_group, section) ELSE section END AS scope FROM k WHERE unit_type IS NOT NULL),
g AS (SELECT version_id, grouped, scope, count(*) AS n, min(chunk_index) AS first_index, max(risk) AS risk, arg_min(section, chunk_index) AS section, coalesce(arg_min(category, chunk_index) FILTER (category <> ''), '') AS category, flatten(list(own)) AS own FROM u WHERE grouped IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1),
s AS (SELECT version_id, section, above, min(chunk_index) AS first_index, max(risk) AS risk, count(unit_type) AS n, flatten(list(own)) AS own FROM k WHERE section <> '' GROUP BY 1, 2, 3),
e AS (SELECT u.version_id, 'unit_' || u.chunk_index AS unit_id, 'atomic_child' AS chunk_type, unit_type, CASE WHEN g.n IS NOT NULL THEN 'group_' || left(md5(u.grouped || chr(10) || u.scope), 16) WHEN u.section = '' THEN 'full_sop' ELSE 'section_' || left(md5(u.section), 16) END AS parent_unit_id, u.section, u.own, u.risk, u.category, u.chunk_index AS first_index, 0 AS n_children,
    nullif(trim(regexp_extract(content, '(?i)^(in .*?)(\\s*,\\s*)(.*)$', 1)), '') AS condition, nullif(trim(regexp_extract(content, '(?i)^(in .*?)(\\s*,\\s*)(.*)$', 3)), '') AS action FROM u LEFT JOIN g ON g.version_id = u.version_id AND g.grouped = u.grouped AND g.scope = u.scope
  UNION ALL SELECT version_id, 'group_' || left(md5(grouped || chr(10) || scope), 16), 'grouped_parent', grouped, CASE WHEN section = '' THEN 'full_sop' ELSE 'section_' || left(md5(section), 16) END, section, own, risk, category, first_index, n, NULL, NULL FROM g
  UNION ALL SELECT version_id, 'section_' || left(md5(section), 16), 'parent_section', 'text_section', CASE WHEN above = '' THEN 'full_sop' ELSE 'section_' || left(md5(above), 16) END, section, own, risk, '', first_index, n, NULL, NULL FROM s
  UNION ALL SELECT version_id, 'full_sop', 'full_sop', 'full_sop', NULL, '', doc_channels, greatest(risk, 1), '', first_index, n, NULL, NULL FROM d)
SELECT e.version_id, unit_id, chunk_type, unit_type, parent_unit_id, section, array_to_string(CASE WHEN len(own) > 0 THEN list_sort(list_distinct(own)) ELSE doc_channels END, ',') AS channels, ['low', 'medium', 'high', 'critical'][e.risk + 1] AS risk_level, category AS risk_category, e.first_index, e.n_children, condition, action FROM e JOIN d USING (version_id)"""


@query("k6_sectioned_policy_units", using("kb_units", K6_SQL))
def k6(spark, d):
    words = F.size(F.split("content", " ", 5))  # more than four are no heading
    blocks = C.units(spark, d).select("version_id", F.col("chunk_index").alias("index"), F.when(words <= 4, words).alias("level"), F.when(F.col("content").startswith("The ") | F.col("content").startswith("A "), "list_item").otherwise("paragraph").alias("kind"), F.when(F.col("content").startswith("A "), "a").alias("list_group"), F.col("content").alias("text"))
    rules = S.SectionRules(risk=RISK, types=_types, channels=SAID, groups=GROUPS, condition=IF, signs=_signs)
    return S.sectioned_units(blocks, "version_id", T.normalize_match, rules)


# Lines of a supplier stand for the boxes of a page: returned ones are nodes that the page has, the others text blocks.
BOXES = """b AS (SELECT DISTINCT l_suppkey AS page, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS block_id, l_returnflag = 'R' AS is_node, coalesce(p_name, '') || ' ' || l_partkey % 5 AS text, l_partkey % 97 * 10.0 + l_discount::DOUBLE * 100 AS x, l_orderkey % 89 * 10.0 AS y, l_quantity::DOUBLE AS w, 5 + l_tax::DOUBLE * 100 AS h FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"""


def _boxes(spark, d):
    lines = C.table(spark, d, "lineitem").join(C.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")
    x, y = (F.col("l_partkey") % 97 * 10.0 + F.col("l_discount").cast("double") * 100), (F.col("l_orderkey") % 89 * 10.0)
    w, h = F.col("l_quantity").cast("double"), 5 + F.col("l_tax").cast("double") * 100
    box = F.array(x, y, x + w, y + h)
    return lines.select(F.col("l_suppkey").alias("page"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("block_id"), (F.col("l_returnflag") == "R").alias("is_node"), F.concat(F.coalesce("p_name", F.lit("")), F.lit(" "), (F.col("l_partkey") % 5).cast("string")).alias("text"), box.alias("box"), (w * h).alias("area")).distinct()


D60_SQL = f"""WITH {BOXES}, k AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key, CASE WHEN regexp_matches(text, '(^| )gear( |$)') THEN 'decision' WHEN regexp_matches(text, '(^| )(rod|ring)( |$)') THEN 'annotation' WHEN regexp_matches(text, '(^| )bolt( |$)') THEN 'warning' ELSE 'action' END AS semantic_type FROM b),
n AS (SELECT * FROM k WHERE is_node), t AS (SELECT * FROM k WHERE NOT is_node),
c AS (SELECT DISTINCT page, t.block_id FROM t JOIN n USING (page) WHERE t.key = n.key OR greatest(least(t.x + t.w, n.x + n.w) - greatest(t.x, n.x), 0) * greatest(least(t.y + t.h, n.y + n.h) - greatest(t.y, n.y), 0) >= 0.5 * t.w * t.h),
s AS (SELECT page, 'sem_' || block_id AS semantic_id, semantic_type, key, 'node' AS origin FROM n UNION ALL SELECT page, 'sem_' || block_id, semantic_type, key, 'text_block' FROM t ANTI JOIN c USING (page, block_id))
SELECT *, semantic_type IN ('annotation', 'warning') AS is_annotation, CASE WHEN origin = 'node' THEN 0.55 WHEN semantic_type IN ('annotation', 'warning') THEN 0.58 ELSE 0.56 END::DOUBLE AS confidence FROM s"""


@query("d60_layout_semantic_nodes", D60_SQL)
def d60(spark, d):
    boxes = _boxes(spark, d)
    types = (("decision", r"(^| )gear( |$)"), ("annotation", r"(^| )(rod|ring)( |$)"), ("warning", r"(^| )bolt( |$)"))
    return L.semantic_nodes(boxes.where("is_node"), boxes.where("not is_node"), "page", types, F.lit("action"), T.normalize_match)
