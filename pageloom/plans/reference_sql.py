"""SQL of the core queries for DuckDB, from the same tables of rules as the Spark plans."""

from __future__ import annotations

from ..functions.porter import duckdb_ctes
from ..functions.text import TOKEN, fold_sql, shape_sql

K1, B = 1.2, 0.75

TOK = f"""c AS (SELECT doc_id AS file_id, regexp_extract_all({fold_sql("coalesce(text, '')")}, '{TOKEN}') AS l FROM documents),
tok AS (SELECT file_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM c),
total AS (SELECT count(*) AS n, sum(len(l)) / count(*) AS a FROM c)"""
STEMS = TOK + ",\nwords AS (SELECT DISTINCT token AS word FROM tok),\n" + duckdb_ctes("words", "word") + ",\nst AS (SELECT file_id, pos, stem AS term FROM tok JOIN stemmed ON token = word)"


def bm25(f: str, df: str, dl: str) -> str:
    w = f"greatest(1e-6, ln((n - {df} + 0.5) / ({df} + 0.5)))"
    return f"{w} * {f} * {K1 + 1} / ({f} + {K1} * ({1 - B} + {B} * {dl} / a))"


def leaf(name: str, body: str) -> str:
    """A leaf of a query: occurrences by document."""
    return f"{name} AS (SELECT file_id, count(*) AS f FROM ({body}) GROUP BY 1), {name}d AS (SELECT count(*) AS df FROM {name})"


def ranked(ctes: str, leaves: dict[str, str], where: str, gates: dict[str, str] | None = None, limit: int = 20) -> str:
    """The best matches: ``where`` speaks of the leaves' f, null where a leaf doesn't occur."""
    joins = " ".join(f"LEFT JOIN {k} ON {k}.file_id = c.file_id CROSS JOIN {k}d" for k in leaves)
    parts = [f"CASE WHEN {k}.f IS NOT NULL AND ({(gates or {}).get(k, 'true')}) THEN {bm25(f'{k}.f', f'{k}d.df', 'len(c.l)')} ELSE 0 END" for k in leaves]
    parts = [p for k, p in zip(leaves, parts) if (gates or {}).get(k) != "never"]
    body = ",\n".join(leaf(k, v) for k, v in leaves.items())
    return f"""WITH {ctes},
{body}
SELECT '/doc/' || c.file_id AS path, round(-({' + '.join(parts)}), 6) AS score, CAST(0.0 AS DOUBLE) AS mtime, d.lang, c.file_id
FROM c {joins} CROSS JOIN total JOIN documents d ON d.doc_id = c.file_id
WHERE {where} ORDER BY -({' + '.join(parts)}), c.file_id LIMIT {limit}"""


def term(t: str) -> str:
    return f"SELECT file_id FROM st WHERE term = '{t}'"


def prefix(t: str) -> str:
    return f"SELECT file_id FROM st WHERE starts_with(term, '{t}')"


def phrase(*ts: str) -> str:
    joins = " ".join(f"JOIN st s{k} ON s{k}.file_id = s0.file_id AND s{k}.pos = s0.pos + {k} AND s{k}.term = '{t}'" for k, t in enumerate(ts) if k)
    return f"SELECT s0.file_id FROM st s0 {joins} WHERE s0.term = '{ts[0]}'"


def shape(x: str) -> str:
    return shape_sql(x)


def english_ctes() -> str:
    """Stems of the words of CTE eng_words(w_), under names that don't meet those of the corpus."""
    import re

    return re.sub(r"\bst(\d+)\b", r"es\1", duckdb_ctes("eng_words", "w_")).replace("stemmed AS", "eng_all AS")
