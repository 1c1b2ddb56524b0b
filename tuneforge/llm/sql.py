"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from tuneforge.llm import license as lic

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def op7(k: int = 10) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(w, i + 1, i + {k}) AS gram
       FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - {k}, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(gram) AS size FROM iw),
p AS (SELECT rid, w, unnest(range(0, len(w))) AS pos FROM d),
dw AS (SELECT rid, pos, size, list_slice(w, pos + 1, pos + size) AS gram FROM p, sizes WHERE pos + size <= len(w)),
hits AS (SELECT rid, pos, size, item_id FROM dw JOIN iw USING (gram)),
hit_words AS (SELECT rid, count(DISTINCT spot) AS n_hit
              FROM (SELECT DISTINCT rid, unnest(range(pos, pos + size)) AS spot FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""


def op5(max_gap: int = 2, min_cover: float = 0.75) -> str:
    known = ", ".join(f"({n}, '{label}', {str(base).lower()}, {k}, {words})" for n, label, base, k, words in lic.templates())
    return f"""
WITH t(template, label, base, k, tw) AS (VALUES {known}),
tg AS (SELECT template, k, i AS spot, list_slice(tw, i + 1, i + k) AS gram
       FROM (SELECT template, k, tw, unnest(range(0, len(tw) - k + 1)) AS i FROM t)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
p AS (SELECT rid, w, unnest(range(0, len(w))) AS pos FROM d),
dg AS (SELECT rid, pos, k, list_slice(w, pos + 1, pos + k) AS gram
       FROM p, (SELECT DISTINCT k FROM t) AS ks WHERE pos + k <= len(w)),
votes AS (SELECT rid, template, pos - spot AS diagonal, min(pos) AS first, list(DISTINCT spot) AS ats
          FROM dg JOIN tg USING (k, gram) GROUP BY ALL),
far AS (SELECT v.*, base, label, len(tw) - k + 1 AS n,
               CASE WHEN base OR diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > {max_gap} THEN 1 ELSE 0 END AS f
        FROM votes v JOIN t USING (template)),
runs AS (SELECT *, sum(f) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM far),
spans AS (SELECT rid, template, label, base, n, run, min(first) AS first, len(list_distinct(flatten(list(ats)))) AS votes
          FROM runs GROUP BY ALL),
verified AS (SELECT *, votes / n AS cover, CASE WHEN base THEN votes = n ELSE votes / n >= {min_cover} END AS ok FROM spans),
per AS (SELECT rid, count(*) FILTER (base AND ok) AS n_base, min(first) FILTER (base AND ok) AS first_word,
               max(first) FILTER (base AND ok) AS last_word,
               list_aggregate(list_sort(list_distinct(list(label) FILTER (base AND ok))), 'string_agg', ',') AS base_labels,
               list_aggregate(list_sort(list_distinct(list(label) FILTER (ok))), 'string_agg', ',') AS labels, max(cover) AS score
        FROM verified GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN per USING (rid)
"""


def _share(name: str, nodes: str, parent: str, child: str, order: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    o = f"CAST(cap AS DOUBLE) / weight, {child}"
    return f"""
{name}_f AS (SELECT *, cap * sum(weight) OVER ({by} ORDER BY {o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
   <= (budget - coalesce(sum(cap) OVER ({by} ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS filled FROM ({nodes})),
{name}_r AS (SELECT *, greatest(budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({by}), 0) AS rest,
   sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({by}) AS ow FROM {name}_f),
{name}_g AS (SELECT *, CASE WHEN filled THEN cap ELSE rest * weight // ow END AS fl FROM {name}_r),
{name}_h AS (SELECT *, rest - sum(CASE WHEN filled THEN 0 ELSE fl END) OVER ({by}) AS extra,
   row_number() OVER ({by} ORDER BY filled, {o}) AS place FROM {name}_g),
{name} AS (SELECT {order}, CAST(fl + CASE WHEN NOT filled AND place <= extra THEN 1 ELSE 0 END AS BIGINT) AS budget FROM {name}_h)"""


def _weights(column: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def mix_leaves(docs: str, share: tuple[int, int], max_epochs: int, seed: int) -> str:
    """CTEs up to ``picked``: a row for each leaf, document and its start in the seeded order."""
    from tuneforge.llm.mixing import DOMAIN_WEIGHTS, DOMAINS, LANG_WEIGHTS, NONE

    number = "TRY_CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT)"
    return f"""mx AS (SELECT *, coalesce('domain' || CAST({number} % {DOMAINS} AS VARCHAR), '{NONE}') AS m_domain, coalesce(lang, '{NONE}') AS m_lang,
   coalesce(source, '{NONE}') AS m_source,
   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM {docs}),
leaf AS (SELECT m_domain, m_lang, m_source, sum(tokens) AS supply, sum(tokens) * {max_epochs} AS cap FROM mx GROUP BY ALL),
{_share('l1', f"SELECT m_domain, sum(cap) AS cap, {_weights('m_domain', DOMAIN_WEIGHTS)} AS weight, (SELECT coalesce(sum(tokens), 0) * {share[0]} // {share[1]} FROM mx) AS budget FROM leaf GROUP BY m_domain", '', 'm_domain', 'm_domain')},
{_share('l2', f"SELECT m_domain, m_lang, sum(cap) AS cap, {_weights('m_lang', LANG_WEIGHTS)} AS weight, any_value(budget) AS budget FROM leaf JOIN l1 USING (m_domain) GROUP BY m_domain, m_lang", 'm_domain', 'm_lang', 'm_domain, m_lang')},
{_share('l3', "SELECT m_domain, m_lang, m_source, sum(cap) AS cap, 1 AS weight, any_value(budget) AS budget FROM leaf JOIN l2 USING (m_domain, m_lang) GROUP BY m_domain, m_lang, m_source", 'm_domain, m_lang', 'm_source', 'm_domain, m_lang, m_source')},
plan AS (SELECT *, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS epochs FROM leaf JOIN l3 USING (m_domain, m_lang, m_source)),
picked AS (SELECT mx.*, epochs, budget - epochs * supply AS rest,
   coalesce(sum(tokens) OVER (PARTITION BY m_domain, m_lang, m_source
     ORDER BY md5('{seed}:' || CAST(epochs + 1 AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
   FROM mx JOIN plan USING (m_domain, m_lang, m_source) WHERE tokens > 0)"""


def op10(share: tuple[int, int], max_epochs: int, seed: int) -> str:
    return f"""WITH {mix_leaves('documents', share, max_epochs, seed)},
each AS (SELECT *, unnest(range(1, CAST(epochs AS BIGINT) + 2)) AS epoch FROM picked)
SELECT m_domain AS domain, m_lang AS lang, m_source AS source, doc_id, tokens, CAST(epoch AS INTEGER) AS epoch,
   CAST(CASE WHEN epoch <= epochs THEN tokens ELSE least(tokens, rest - start) END AS BIGINT) AS take
FROM each WHERE epoch <= epochs OR start < rest"""


NEAR = """
sw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sg AS (SELECT DISTINCT doc_id, list_slice(w, i + 1, i + 5) AS gram
       FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS i FROM sw WHERE len(w) > 0)),
sn AS (SELECT doc_id, count(*) AS n FROM sg GROUP BY doc_id),
sc AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sg x JOIN sg y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
sl AS (SELECT a, b FROM sc JOIN sn p ON p.doc_id = a JOIN sn q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sw UNION SELECT reach.a, sl.b FROM reach JOIN sl ON reach.b = sl.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)"""


def op9() -> str:
    return f"""WITH RECURSIVE {NEAR}
SELECT sw.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM sw LEFT JOIN sn USING (doc_id) JOIN comp USING (doc_id)"""


def op8() -> str:
    from tuneforge.llm.url_filter import ENTITIES, RULES

    bare = """regexp_replace(regexp_replace(regexp_replace({0}, '(?s)#.*$', ''),
      '([?&])(?:(?:utm_[a-z]+|gclid|fbclid|ref)=[^&]*(?:&|$))+', '\\1', 'g'), '[?&]$', '')"""
    low = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = "regexp_extract({0}, '(?s)^(.*?://[^/?]*)', 1)"

    def alias(url: str) -> str:
        cut = bare.format(url)
        return f"({low.format(head.format(cut))} || substr({cut}, length({head.format(cut)}) + 1))"

    rest = "CASE WHEN strpos({0}, '://') > 0 THEN substr({0}, strpos({0}, '://') + 3) END"
    host = lambda u: f"coalesce({low.format(f'regexp_extract({rest.format(u)}, {chr(39)}^([^/?#]*){chr(39)}, 1)')}, '')"
    path = lambda u: f"coalesce(regexp_extract({rest.format(u)}, '(?s)^[^/?#]*([^?#]*)', 1), '')"
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.name}', '{r.verdict}')" for r in RULES)
    decoded = "t"
    for entity, char in ENTITIES:
        decoded = f"replace({decoded}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    folded = "list_reduce(list_prepend('', string_split(substr(p, 2), '/')), lambda a, x: CASE x WHEN '.' THEN a WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END)"
    link = """'(?i)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'"""
    refresh = """'(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'"""
    return f"""
WITH RECURSIVE r(rh, rp, name, v) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS rid, page_id, url, html, {host('url')} AS host, {path('url')} AS path, {alias('url')} AS alias FROM pages),
t AS (SELECT url, regexp_extract(unnest(regexp_extract_all(html, {link})), '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS t FROM p
      UNION ALL SELECT url, regexp_extract(unnest(regexp_extract_all(html, {refresh})), '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) FROM p),
dt AS (SELECT url, {decoded} AS t, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AS bs, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS bo,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS bp FROM t WHERE url IS NOT NULL),
ft AS (SELECT url, regexp_matches(t, '^[?]') AS bare_query, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
         WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR bo = '' OR t = '' OR t[1] = '#' THEN NULL
         WHEN t[1:2] = '//' THEN bs || t WHEN t[1] = '/' THEN bo || t WHEN t[1] = '?' THEN bo || bp || t
         ELSE bo || coalesce(nullif(regexp_extract(bp, '(?s)^.*/'), ''), '/') || t END AS t FROM dt),
st AS (SELECT url, t, bare_query, regexp_extract(t, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS o, regexp_extract(t, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM ft WHERE t IS NOT NULL),
tt AS (SELECT url, CASE WHEN bare_query OR strpos(p, '/.') = 0 THEN t ELSE o
         || CASE WHEN regexp_matches(p, '/[.][.]?$') THEN {folded} || '/' ELSE {folded} END || substr(t, length(o) + length(p) + 1) END AS t FROM st),
e AS (SELECT DISTINCT {alias('url')} AS a, {alias('t')} AS b FROM tt WHERE t IS NOT NULL),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT x AS a, x AS b FROM (SELECT alias AS x FROM p WHERE url IS NOT NULL UNION SELECT a FROM s)
          UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a),
c AS (SELECT a AS alias, min(b) AS component FROM reach GROUP BY a),
known AS (SELECT alias AS k, host, path FROM p WHERE url IS NOT NULL UNION SELECT b, {host('b')}, {path('b')} FROM e UNION SELECT a, {host('a')}, {path('a')} FROM e),
kr AS (SELECT k, host, path, arg_max(v, length(name)) AS v FROM known JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
spread AS (SELECT component, min(v) AS carried FROM kr JOIN c ON c.alias = kr.k GROUP BY component),
pr AS (SELECT rid, arg_max(name, length(name)) AS name, arg_max(v, length(name)) AS v FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, name AS rule, coalesce(v, carried, 'allow') AS verdict
FROM p LEFT JOIN pr USING (rid) LEFT JOIN c USING (alias) LEFT JOIN spread USING (component)"""

def op13() -> str:
    words = "regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')"
    letters = "(VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4))"
    orders = ", ".join(f"{letters} AS l{i}(f{i}, b{i})" for i in range(1, 6))
    apart = " AND ".join(f"b{i} <> b{j}" for i in range(1, 6) for j in range(i + 1, 6))
    steps = " UNION ALL ".join(
        f"SELECT f1 || f2 || f3 || f4 || f5 AS filter_order, {i} AS step, b{i} AS bit, {' + '.join(['0', *[f'(1 << b{j})' for j in range(1, i)]])} AS before FROM orders" for i in range(1, 6))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, len({words}) AS n, len(list_distinct({words})) AS u FROM d),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT d.part, coalesce(marks.good, 0) AS good, coalesce(marks.toxic, 0) AS toxic,
        CASE WHEN n < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * u < 50 * n THEN 2 ELSE 0 END
        + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * len(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > first_id THEN 16 ELSE 0 END AS mask
      FROM d JOIN w USING (rid) JOIN firsts USING (t) LEFT JOIN marks ON marks.doc_id = d.doc_id),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
orders AS (SELECT * FROM {orders} WHERE {apart}),
steps AS ({steps}),
s AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (before + (1 << bit)) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & (1 << bit) <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before <> 0 AND mask & (1 << bit) <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = (1 << bit) THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & (1 << bit) <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & (1 << bit) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM cell, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM s
"""


def op11() -> str:
    key = "(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))"
    bits = f"list_transform(range(8 * length({key})), lambda p: CASE WHEN p % 8 = 0 THEN CAST(ascii(substr({key}, p // 8 + 1, 1)) AS BIGINT) ELSE 0 END)"
    crc = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))))"
    return f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS fault FROM conversations),
dm AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
       FROM src WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM dm),
f AS (SELECT *, left(role, 1) AS c, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS c2, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut FROM o),
ins(state, k, mid, added) AS (VALUES (0, 0, 0, CAST([] AS VARCHAR[])), (1, 0, 1, []), (2, 0, 2, []), (3, 0, 3, []), (0, 1, 2, ['user:']), (1, 1, 2, ['user:']), (2, 1, 3, ['assistant:']),
   (3, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 2, 3, ['user:', 'assistant:'])),
ed(letter, price) AS (VALUES ('D', 2), ('K', 0), ('R', 1)),
walk(conv_id, i, state, cost, audit, rest) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM src
  UNION ALL
  SELECT conv_id, i, state, cost, audit, rest FROM (
    SELECT w.conv_id, f.i, CASE letter WHEN 'D' THEN mid WHEN 'R' THEN CASE mid WHEN 2 THEN 3 ELSE 2 END ELSE CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS state,
      CAST(cost + 5 * k + price + CASE WHEN letter <> 'D' AND cut THEN 5 ELSE 0 END AS BIGINT) AS cost, audit || repeat('I', k) || letter AS audit,
      list_concat(rest, list_concat(added, CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE mid WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END)) AS rest
    FROM walk AS w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1 JOIN ins ON ins.state = w.state CROSS JOIN ed
    WHERE letter = 'D' OR (NOT blank AND NOT again AND (letter = 'R' OR (c = 's' AND mid = 0) OR (c = 'u' AND mid <> 2) OR (c = 'a' AND mid = 2))))
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
size AS (SELECT conv_id, count(*) AS n FROM f GROUP BY conv_id),
fin AS (SELECT w.conv_id, cost + 5 * k AS cost, audit || repeat('I', k) AS audit, list_concat(rest, added) AS rest
        FROM walk AS w LEFT JOIN size ON w.conv_id IS NOT DISTINCT FROM size.conv_id JOIN ins ON ins.state = w.state
        WHERE w.i = coalesce(n, 0) AND mid IN (0, 3)
        QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY cost + 5 * k, audit || repeat('I', k)) = 1),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
            count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (c2 IS NOT NULL AND c || c2 NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT fin.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, cost, audit, sha256(array_to_string(rest, chr(10))) AS repaired_sha256
FROM fin LEFT JOIN stats ON fin.conv_id IS NOT DISTINCT FROM stats.conv_id
"""
