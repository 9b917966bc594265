"""SQL of the registered queries, for a second engine to run on the same tables."""

from __future__ import annotations

from folioscope.plans.library import TITLE_CHARS


def tokens(column: str) -> str:
    return f"list_filter(regexp_split_to_array(strip_accents(lower({column})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


ARTICLES = f"SELECT lang AS archive, doc_id, 'C/doc_' || doc_id AS path, left(split_part(text, chr(10), 1), {TITLE_CHARS}) AS title, text FROM documents"
POSTINGS = f"SELECT archive, term, doc_id, count(*) AS wdf FROM (SELECT archive, doc_id, unnest({tokens('text')}) AS term FROM a) GROUP BY ALL"
BASE = f"WITH RECURSIVE a AS ({ARTICLES}), p AS ({POSTINGS}), l AS (SELECT archive, doc_id, CAST(sum(wdf) AS BIGINT) AS doclen FROM p GROUP BY ALL)"
COPIES = "SELECT * FROM (SELECT lang AS archive, doc_id AS src, lag(doc_id) OVER (PARTITION BY lang, md5(text) ORDER BY doc_id) AS dst FROM documents) WHERE dst IS NOT NULL"
ENTRIES = (
    "SELECT archive, path, title, 'text/plain' AS mime_type, strlen(text) AS bytes FROM a UNION ALL "
    "SELECT 'web', 'C/page_' || page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1), 'text/html', strlen(html) FROM pages"
)


def weights(terms: dict[str, int], pooled: bool, each: str | None = None, text: str = "text") -> str:
    """CTEs up to s (archive, doc_id, score) for a query of terms and their counts."""
    by = "" if pooled else "archive, "
    on = "true" if pooled else "m.archive = {0}.archive"
    each = each or "ln(CASE WHEN r < 2 THEN r * 0.5 + 1 ELSE r END) * wqf * 2 * wdf / (greatest(doclen / average, 0.5) * 0.5 + 0.5 + wdf)"
    query = ", ".join(f"('{t}', {n})" for t, n in terms.items())
    return f"""WITH a AS ({ARTICLES}), w AS (SELECT archive, doc_id, {tokens(text)} AS w FROM a),
q AS (SELECT * FROM (VALUES {query}) AS q(term, wqf)),
m AS (SELECT archive, doc_id, doclen, term, count(*) AS wdf FROM (SELECT archive, doc_id, len(w) AS doclen, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
n AS (SELECT {by}count(*) AS n, sum(len(w)) / count(*) AS average FROM w {'' if pooled else 'GROUP BY archive'}),
f AS (SELECT {by}term, count(*) AS df FROM m GROUP BY ALL),
x AS (SELECT m.archive, m.doc_id, m.term, wdf, doclen, wqf, average, (n - df + 0.5) / (df + 0.5) AS r FROM m JOIN q ON q.term = m.term JOIN f ON f.term = m.term AND {on.format('f')} JOIN n ON {on.format('n')}),
s AS (SELECT archive, doc_id, round(sum({each}), 6) AS score FROM x GROUP BY ALL)"""
