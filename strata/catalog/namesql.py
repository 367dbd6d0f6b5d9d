"""DuckDB SQL of the near-duplicate name pass: the ratio of two names by recursion over their
longest matching blocks, written from the definition and independent of the Spark operators.

``cell`` holds the equal character places of a pair; places on one diagonal without a gap are a run.
A window of the two names takes its longest run of characters that are not popular (in names of 200
characters or more, one that fills over 1 % of the second name is popular and starts no match),
earliest first, extended to the whole run around it; the windows left and right of it recur. Without
such a run the window can still match at its corner. The sizes add up to the matching characters.
"""

from __future__ import annotations

from .. import constants as K
from .text import FILE_NAME_SQL, clean_filename_sql

T = K.FUZZY_THRESHOLD

#: CTEs up to ``e`` (a, b, ratio), ``follow`` (rep, leader), ``simf`` (doc_id, leader_id) and ``ex``
#: (doc_id of exact copies); use after WITH RECURSIVE.
FUZZY_SQL = f"""
    fn AS (SELECT doc_id, text, {FILE_NAME_SQL} AS file_name FROM documents),
    cn AS (SELECT doc_id, {clean_filename_sql('file_name')} AS clean FROM fn),
    nodes AS (SELECT min(doc_id) AS rep, clean, length(clean) AS n FROM cn
              WHERE regexp_replace(clean, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY clean),
    hist AS (SELECT rep, c, count(*) AS cnt FROM (SELECT rep, unnest(string_split(clean, '')) AS c FROM nodes) GROUP BY 1, 2),
    few AS (SELECT p.rep AS a, q.rep AS b FROM nodes p
            JOIN nodes q ON p.rep < q.rep AND 2.0 * least(p.n, q.n) / (p.n + q.n) >= {T}
            JOIN hist x ON x.rep = p.rep JOIN hist y ON y.rep = q.rep AND y.c = x.c
            GROUP BY p.rep, q.rep, p.n, q.n HAVING 2.0 * sum(least(x.cnt, y.cnt)) / (p.n + q.n) >= {T}),
    letters AS (SELECT rep, n, unnest(string_split(clean, '')) AS c, unnest(range(0, n)) AS i FROM nodes
                WHERE rep IN (SELECT a FROM few UNION SELECT b FROM few)),
    popular AS (SELECT rep, c FROM letters WHERE n >= 200 GROUP BY rep, c, n HAVING count(*) > n // 100 + 1),
    cell AS MATERIALIZED (
        SELECT few.a, few.b, x.i, y.i AS j, p.c IS NULL AS live FROM few JOIN letters x ON x.rep = few.a
        JOIN letters y ON y.rep = few.b AND y.c = x.c LEFT JOIN popular p ON p.rep = few.b AND p.c = y.c),
    win AS (
        SELECT few.a, few.b, 0 AS alo, x.n AS ahi, 0 AS blo, y.n AS bhi, 0 AS size
        FROM few JOIN nodes x ON x.rep = few.a JOIN nodes y ON y.rep = few.b
        UNION ALL
        SELECT a, b, unnest([alo, i0 + len]) AS alo, unnest([i0, ahi]) AS ahi, unnest([blo, j0 + len]) AS blo,
               unnest([j0, bhi]) AS bhi, unnest([len, 0]) AS size
        FROM (SELECT *, row_number() OVER (PARTITION BY a, b, alo, blo ORDER BY live DESC, cnt DESC, i1, j1) AS place
              FROM (SELECT a, b, alo, ahi, blo, bhi, live, i0, i0 - d AS j0, len, min(i) AS i1, min(i) - d AS j1, count(*) AS cnt
                    FROM (SELECT *, min(i) OVER run AS i0, count(*) OVER run AS len,
                                 i - row_number() OVER (PARTITION BY a, b, alo, blo, d, live ORDER BY i) AS h
                          FROM (SELECT w.a, w.b, alo, ahi, blo, bhi, i, live, i - j AS d,
                                       i - row_number() OVER (PARTITION BY w.a, w.b, alo, blo, i - j ORDER BY i) AS g
                                FROM win w JOIN cell ON cell.a = w.a AND cell.b = w.b
                                 AND i >= alo AND i < ahi AND j >= blo AND j < bhi
                                WHERE ahi > alo AND bhi > blo)
                          WINDOW run AS (PARTITION BY a, b, alo, blo, d, g))
                    GROUP BY a, b, alo, ahi, blo, bhi, d, live, i0, len, h)
              WHERE live OR (i0 = alo AND j0 = blo))
        WHERE place = 1),
    e AS (SELECT win.a, win.b, 2.0 * sum(size) / (any_value(x.n) + any_value(y.n)) AS ratio
          FROM win JOIN nodes x ON x.rep = win.a JOIN nodes y ON y.rep = win.b GROUP BY 1, 2 HAVING ratio >= {T}),
    later AS (SELECT b AS rep, list(a ORDER BY a) AS earlier, row_number() OVER (ORDER BY b) AS k FROM e GROUP BY b),
    walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS followers
             UNION ALL
             SELECT l.k, CASE WHEN len(list_filter(l.earlier, lambda x: NOT list_contains(followers, x))) > 0
                              THEN list_append(followers, l.rep) ELSE followers END
             FROM walk JOIN later l ON l.k = walk.k + 1),
    follow AS (SELECT rep, list_min(list_filter(earlier, lambda x: NOT list_contains(fs, x))) AS leader
               FROM later, (SELECT arg_max(followers, k) AS fs FROM walk) WHERE list_contains(fs, rep)),
    simf AS (SELECT cn.doc_id, coalesce(f.leader, n.rep) AS leader_id FROM cn JOIN nodes n ON n.clean = cn.clean
             LEFT JOIN follow f ON f.rep = n.rep WHERE cn.doc_id <> coalesce(f.leader, n.rep)),
    ex AS (SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS k FROM documents)
           WHERE doc_id <> k)"""
