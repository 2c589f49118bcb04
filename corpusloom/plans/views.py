"""The corpus views of corpusloom.sources.corpus in DuckDB SQL, for oracle queries."""

from __future__ import annotations

VIEWS = {
    "kb_versions": """SELECT d.doc_id AS version_id, d.source AS document_id, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS version_number,
        CASE l.quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'needs_review' END AS review_status,
        CASE l.toxic WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE '' END AS risk_level, d.lang AS vertical, d.text, d.n_chars
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "kb_status": """SELECT v.*, CASE WHEN review_status = 'approved' AND version_number = (SELECT max(w.version_number) FROM kb_versions w WHERE w.document_id = v.document_id AND w.review_status = 'approved') THEN 'published' WHEN review_status = 'approved' THEN 'archived' ELSE 'draft' END AS status FROM kb_versions v""",
    "kb_lines": "SELECT doc_id AS version_id, unnest(range(0, len(string_split(text, chr(10))))) AS chunk_index, unnest(string_split(text, chr(10))) AS raw FROM documents",
    "kb_units": "SELECT version_id, chunk_index, trim(raw) AS content FROM kb_lines WHERE trim(raw) <> ''",
    "kb_audit": """SELECT event_id, ts, user_id AS actor, CASE event_type WHEN 'view' THEN 'sop_search' WHEN 'click' THEN 'search_result_click' WHEN 'purchase' THEN 'quick_answer_open' ELSE 'feedback_submitted' END AS action,
        CAST(json_extract_string(props, '$.k') AS INT) AS rank, 'q' || json_extract_string(props, '$.k') AS query, value FROM events WHERE event_type <> 'error'""",
    "kb_log": """SELECT event_id, ts, 'q' || json_extract_string(props, '$.k') AS query, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS INT) % 7 END AS result_count, value AS latency_ms
        FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error')""",
    "kb_messages": "SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations",
    "kb_nodes": "SELECT l_orderkey AS graph_id, l_linenumber::BIGINT AS node_id, coalesce(min(p_name), '') AS title, max(l_quantity) AS support FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2",
    "kb_drawn": "SELECT l_orderkey AS graph_id, l_linenumber::BIGINT AS from_node, l_partkey % 7 + 1 AS to_node, CASE l_returnflag WHEN 'R' THEN 'yes' ELSE 'no' END AS condition FROM lineitem WHERE l_returnflag <> 'N'",
    "kb_edges": "SELECT DISTINCT e.* FROM kb_drawn e SEMI JOIN kb_nodes n ON n.graph_id = e.graph_id AND n.node_id = e.to_node",
    "kb_degrees": """SELECT graph_id, node_id, title, support, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM kb_nodes
        LEFT JOIN (SELECT graph_id, from_node AS node_id, count(*) AS o FROM kb_edges GROUP BY 1, 2) USING (graph_id, node_id) LEFT JOIN (SELECT graph_id, to_node AS node_id, count(*) AS i FROM kb_edges GROUP BY 1, 2) USING (graph_id, node_id)""",
    "kb_tokens": """SELECT doc_id, unnest(regexp_extract_all(regexp_replace(strip_accents(lower(text)), '\\p{M}+', '', 'g'), '[\\p{L}\\p{N}]+')) AS term FROM documents""",
    "kb_query_tokens": """SELECT item_id AS query_id, unnest(regexp_extract_all(regexp_replace(strip_accents(lower(text)), '\\p{M}+', '', 'g'), '[\\p{L}\\p{N}]+')) AS term FROM benchmark""",
}
NEEDS = {"kb_status": ["kb_versions"], "kb_units": ["kb_lines"], "kb_edges": ["kb_nodes", "kb_drawn"], "kb_degrees": ["kb_nodes", "kb_drawn", "kb_edges"]}


def using(views: str, sql: str) -> str:
    """``sql`` after the named views and what they need."""
    names: list[str] = []
    for v in views.split():
        names += [x for x in [*NEEDS.get(v, []), v] if x not in names]
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + (", " + sql.strip()[1:] if sql.strip().startswith(",") else sql)
