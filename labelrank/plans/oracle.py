"""DuckDB oracle SQL for every registered query.

The stand-in views are written once here as CTEs; ``sql(body)`` prepends the
ones a query body mentions (and their dependencies).  Oracles are brute force
on purpose (e.g. the search oracle scores every pair): they check results at
small scale, they are not the implementation.
"""

from __future__ import annotations

import re

from labelrank.plans.fixtures import CAND_GROUP, QREL_FANOUT, RUN_DEPTH


# name -> SQL, in dependency order
VIEWS: list[tuple[str, str]] = [
    ("fx_passages", "SELECT doc_id AS docid, source AS title, text FROM documents"),
    ("fx_queries", "SELECT item_id AS query_id, text AS query FROM benchmark"),
    ("fx_candidates", f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS pos,
        doc_id AS docid, source AS title, text FROM (
          SELECT doc_id // {CAND_GROUP} AS query_id, * FROM documents
          UNION ALL SELECT doc_id // {CAND_GROUP} - 1, * FROM documents
          WHERE doc_id % {CAND_GROUP} = 0 AND doc_id // {CAND_GROUP} > 0)"""),
    ("fx_candidate_queries", """SELECT query_id, string_agg(query, ' ' ORDER BY m) AS query FROM (
        SELECT t.m, g.query_id, b.query FROM range(greatest((SELECT count(DISTINCT query_id) FROM fx_candidates),
          (SELECT count(*) FROM benchmark))) t(m)
        JOIN (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS g, count(*) OVER () AS n
          FROM (SELECT DISTINCT query_id FROM fx_candidates)) g ON g.g = t.m % g.n
        JOIN (SELECT text AS query, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n
          FROM benchmark) b ON b.i = t.m % b.n) GROUP BY query_id"""),
    ("fx_labels", """SELECT c.query_id, c.pos, c.docid, CAST(coalesce(l.quality, 0) AS INTEGER) AS relevance_score
        FROM fx_candidates c LEFT JOIN labels l ON l.doc_id = c.docid"""),
    ("fx_reply0", """SELECT query_id, list(docid ORDER BY pos) AS passages_ids,
        'My selection:[' || coalesce(string_agg('[' || (pos + 1) || ']', ',' ORDER BY pos)
            FILTER (WHERE relevance_score = 1), '') || '].' AS r
        FROM fx_labels GROUP BY query_id"""),
    ("fx_reply", """SELECT query_id, passages_ids, CASE query_id % 5 WHEN 0 THEN r WHEN 1 THEN r || '[0]'
        WHEN 2 THEN r || '[99]' WHEN 3 THEN r || r ELSE '<think>maybe [2]</think>' || r END AS relevance_output
        FROM fx_reply0"""),
    ("fx_rank_reply0", """SELECT query_id, list(docid ORDER BY pos) AS passages_ids,
        string_agg('[' || (pos + 1) || ']', ' > ' ORDER BY md5(CAST(docid AS VARCHAR)), pos) AS r
        FROM fx_labels GROUP BY query_id"""),
    ("fx_rank_reply", """SELECT query_id, passages_ids, CASE query_id % 5 WHEN 0 THEN r WHEN 1 THEN r || ' > [0]'
        WHEN 2 THEN r || ' > [99]' WHEN 3 THEN r || ' > ' || r ELSE '<think>[3] first</think>' || r END
        AS utility_ranking FROM fx_rank_reply0"""),
    ("fx_vec", "SELECT vec_id AS id, embedding, label FROM embeddings"),
    ("fx_scores", """SELECT q.id AS qid, p.id AS pid,
        list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score
        FROM fx_vec q CROSS JOIN fx_vec p"""),
    ("fx_run", f"""SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank, score
        FROM fx_scores QUALIFY rank <= {RUN_DEPTH}"""),
    ("fx_qrels", f"""SELECT q.id AS qid, p.id AS pid,
        CAST(CASE WHEN q.label = p.label THEN 1 + p.id % 3 ELSE 0 END AS INTEGER) AS rel
        FROM fx_vec q CROSS JOIN range(1, {QREL_FANOUT} + 1) t(j) JOIN fx_vec p ON p.id = q.id + t.j"""),
    ("fx_qrels_binary", "SELECT qid, pid FROM fx_qrels WHERE rel > 0"),
]
_VIEW_SQL = dict(VIEWS)
_ORDER = [n for n, _ in VIEWS]


def _deps(text: str, seen: set[str]) -> None:
    for name in _ORDER:
        if name not in seen and re.search(rf"\b{name}\b", text):
            seen.add(name)
            _deps(_VIEW_SQL[name], seen)


def sql(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <needed views> <body>``; ``extra`` adds query-local CTEs after the views."""
    extra = extra or []
    text = body + " " + " ".join(s for _, s in extra)
    seen: set[str] = set()
    _deps(text, seen)
    ctes = [(n, _VIEW_SQL[n]) for n in _ORDER if n in seen] + extra
    if not ctes:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes) + "\n" + body


def union_metrics(source: str, pairs: list[tuple[str, str]]) -> str:
    """``SELECT 'name' AS metric, CAST(expr AS DOUBLE) AS value FROM source`` for every pair."""
    return "\nUNION ALL\n".join(
        f"SELECT '{n}' AS metric, CAST({e} AS DOUBLE) AS value FROM {source}" for n, e in pairs)

