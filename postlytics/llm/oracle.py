"""DuckDB SQL of the operators that SQL can express, over the same tables."""

from __future__ import annotations

_ITEM_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
m AS (SELECT d.*, min(doc_id) OVER (PARTITION BY text) AS lo FROM d),
f AS (SELECT part,
             CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN m.doc_id > lo THEN 16 ELSE 0 END AS mask,
             coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS bad
      FROM m LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = m.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(CASE WHEN good THEN 1 ELSE 0 END) AS g, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS b FROM f GROUP BY part, mask),
names(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order
           FROM names a, names b, names c, names d, names e
           WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, s AS step, (SELECT bit FROM names WHERE name = filter_order[s]) AS bit,
                 coalesce((SELECT sum(bit) FROM names WHERE instr(filter_order[:s - 1], name) > 0), 0)::INTEGER AS before
          FROM orders, range(1, 6) t(s)),
r AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN g ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN b ELSE 0 END) AS toxic_lost
      FROM c, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

OP12 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_ITEM_TERM}') AS terms FROM documents),
u AS (SELECT row_number() OVER () AS row, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM u),
i AS (SELECT item_id, term, count(*) AS times
      FROM (SELECT item_id, unnest(regexp_extract_all({_FOLD.format("text")}, '{_ITEM_TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM u) WHERE term IN (SELECT term FROM i) GROUP BY row, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term, docs),
m AS (SELECT row, doc_id, 100 - 75 + (75 * n * docs) // length AS m FROM u, s),
p AS (SELECT item_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM t JOIN w USING (term) JOIN m USING (row) JOIN i USING (term) GROUP BY item_id, row),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
      FROM p JOIN m USING (row) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
