"""DuckDB SQL for the queries that SQL can express."""

from . import decontaminate, filter_audit, licenses, merkle, secrets, url_filter

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _phrase(phrase: str) -> str:
    words = phrase.split()
    test = " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(words))
    return f"list_filter(range(0, len(words)), lambda i: {test})"


_FOUND = ", ".join(f"{_phrase(p)} AS p{k}" for k, (p, _) in enumerate(licenses.BASE))
_BASE_LABELS = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(licenses.BASE))


def _stands(template: str) -> str:
    """Plain wording is looked for as it is, one with regions by its pattern."""
    pattern = licenses.as_regex(template)
    return f"contains(framed, '{pattern}')" if not set(template) & set("[]{}()|") else f"regexp_matches(framed, '{pattern}')"


_LABELS = ", ".join(f"CASE WHEN {_stands(t)} THEN '{label}' END" for label, t in licenses.TEMPLATES)
_ALL = " || ".join(f"p{k}" for k in range(len(licenses.BASE)))
OP2 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({lowered("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
f AS (SELECT doc_id, words, ' ' || array_to_string(words, '  ') || ' ' AS framed, {_FOUND} FROM w),
l AS (SELECT doc_id, len(words) AS n_words, {_ALL} AS places,
    list_sort(list_distinct(list_filter([{_BASE_LABELS}], lambda x: x IS NOT NULL))) AS named,
    list_distinct(list_filter([{_LABELS}], lambda x: x IS NOT NULL)) AS accepted FROM f)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
    array_to_string(named, ',') AS base_labels, array_to_string(list_sort(list_distinct(named || accepted)), ',') AS labels,
    1 - 0.6::DOUBLE ** len(named) * 0.4::DOUBLE ** len(accepted) AS score
FROM l
"""

OP3 = f"""
WITH t AS (SELECT doc_id, sha256({lowered("text")}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""


def _hits(kind: secrets.Kind, rank: int) -> str:
    """A match's place from the gaps and whole matches before it; a whole match may begin with one character that is not its own."""
    pattern = quoted(f"(?:^|[^{kind.after[1:]})({kind.pattern})" if kind.after else f"({kind.pattern})")
    value = f"regexp_extract(hit, {quoted(kind.value)}, 1)" if kind.value else "hit"
    needs = "".join(f" AND regexp_matches(value, {quoted(n)})" for n in kind.needs)
    return f"""
SELECT doc_id, owner, repository, start, start + length(hit) AS stop, {rank} AS rank, {quoted(kind.name)} AS kind, {kind.base} AS base, sha256(value) AS hash
FROM (SELECT doc_id, owner, repository, hit, start, {value} AS value FROM (
    SELECT doc_id, owner, repository, hits[i] AS hit,
        list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + list_sum(list_transform(wholes[1:i], lambda x: length(x)))::BIGINT - length(hits[i]) AS start
    FROM (SELECT doc_id, owner, repository, hits, wholes, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT doc_id, source AS owner, concat_ws('/', source, lang) AS repository,
            regexp_extract_all(coalesce(text, ''), {pattern}, 1) AS hits, regexp_extract_all(coalesce(text, ''), {pattern}) AS wholes, string_split_regex(coalesce(text, ''), {pattern}) AS gaps
        FROM documents))))
WHERE length(value) >= {kind.least}{needs}"""


OP4 = f"""
WITH hits AS ({" UNION ALL ".join(_hits(k, rank) for rank, k in enumerate(secrets.KINDS))}),
owned AS (SELECT hash, count(DISTINCT coalesce(owner, '\x01')) AS owners, count(DISTINCT (coalesce(owner, '\x01'), repository)) AS repositories FROM hits GROUP BY hash),
rated AS (SELECT hits.*, owners < {secrets.COPIED} AND repositories < {secrets.SPREAD} AS live, repositories, concat_ws(':', kind, start, stop) AS span FROM hits JOIN owned USING (hash)),
spans AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (base), '') AS base,
        string_agg(span, ',' ORDER BY start, rank) AS spans, count(*) FILTER (live) AS n_live, max(repositories) AS repositories
    FROM rated WHERE base OR live GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(repositories, 0) AS repositories
FROM documents LEFT JOIN spans USING (doc_id)
"""


def _rule_sql(out: str) -> str:
    ordered = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    whens = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if out == 'rule' else v}'" for v, h, p in ordered)
    return f"CASE {whens} END"


def _mixed(n: str, total: str) -> str:
    p = f"1.0::DOUBLE / {url_filter.ALPHABET}"
    for k in range(1, url_filter.ORDER + 1):
        p = f"({n}{k} + {url_filter.MIX}::DOUBLE * ({p})) / ({total}{k} + {url_filter.MIX}::DOUBLE)"
    return p


_K = range(1, url_filter.ORDER + 1)
_GRAMS = ", ".join(map(str, _K))
_WIDE = ", ".join(f"max({n}) FILTER (k = {k}) AS {n}{k}" for k in _K for n in ("a", "ta", "b", "tb"))
_O = url_filter.ORDER
OP10 = f"""
WITH u0 AS (SELECT DISTINCT coalesce(url, '') AS url FROM pages),
u1 AS (SELECT url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u0),
u2 AS (SELECT url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u1),
u AS (SELECT *, {_rule_sql("rule")} AS rule, {_rule_sql("verdict")} AS ruled, ('0x' || substr(md5(url), 1, 6))::INT % {url_filter.HOLD} = 0 AS held FROM u2),
padded AS (SELECT url, ruled, held, repeat(chr(2), {_O - 1}) || {lowered("url")} || chr(3) AS text FROM u),
positions AS (SELECT url, ruled, held, substr(text, i, {_O}) AS win FROM (SELECT *, unnest(range(1, length(text) - {_O - 2})) AS i FROM padded)),
seen AS (SELECT win, count(*) FILTER (ruled = 'allow' AND NOT held) AS allow, count(*) FILTER (ruled = 'block' AND NOT held) AS block FROM positions GROUP BY win),
grams AS (SELECT win, allow, block, k, substr(win, {_O} + 1 - k, k) AS gram FROM (SELECT *, unnest([{_GRAMS}]) AS k FROM seen)),
counts AS (SELECT k, gram, substr(gram, 1, k - 1) AS context, sum(allow) AS a, sum(block) AS b FROM grams GROUP BY k, gram),
totals AS (SELECT k, context, sum(a) AS ta, sum(b) AS tb FROM counts GROUP BY k, context),
wide AS (SELECT win, {_WIDE} FROM grams JOIN counts USING (k, gram) JOIN totals USING (k, context) GROUP BY win),
ratios AS (SELECT win, ln(({_mixed("a", "ta")}) / ({_mixed("b", "tb")})) AS ratio FROM wide),
scores AS (SELECT url, avg(ratio) AS score FROM positions JOIN ratios USING (win) GROUP BY url),
spread AS (SELECT avg(score) FILTER (ruled = 'allow') AS ma, stddev_pop(score) FILTER (ruled = 'allow') AS sa, avg(score) FILTER (ruled = 'block') AS mb, stddev_pop(score) FILTER (ruled = 'block') AS sb
    FROM u JOIN scores USING (url) WHERE held),
level AS (SELECT CASE WHEN ma IS NULL OR mb IS NULL THEN 0 WHEN sa + sb > 0 THEN (ma * sb + mb * sa) / (sa + sb) ELSE (ma + mb) / 2 END AS level FROM spread)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= (SELECT level FROM level) THEN 'allow' ELSE 'block' END) AS verdict,
    CASE WHEN rule IS NULL THEN round(score - (SELECT level FROM level), 6) END AS score
FROM pages JOIN u ON coalesce(pages.url, '') = u.url JOIN scores ON u.url = scores.url
"""

_SETS = range(filter_audit.SETS)
_FILTERS = filter_audit.FILTERS
_FAILS = f"""len(w) < {filter_audit.LEAST_WORDS}|100 * len(list_distinct(w)) < {filter_audit.LEAST_DISTINCT} * len(w)|100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filter_audit.MOST_CAPITALS} * length(t)""".split("|")
_FAILS += [f"regexp_matches(t, '{filter_audit.SYMBOLS}')", "doc_id > min(doc_id) OVER (PARTITION BY t)"]
_PERMUTED = " AND ".join(f"f{j}.f <> f{i}.f" for i in range(5) for j in range(i))
OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
s AS (SELECT doc_id, part, {" + ".join(f"CASE WHEN {x} THEN {1 << k} ELSE 0 END" for k, x in enumerate(_FAILS))} AS fails FROM d),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM s LEFT JOIN l USING (doc_id) GROUP BY part, fails),
f AS (SELECT unnest(range({len(_FILTERS)})) AS f),
o AS (SELECT [f0.f, f1.f, f2.f, f3.f, f4.f] AS o FROM f f0, f f1, f f2, f f3, f f4 WHERE {_PERMUTED}),
p AS (SELECT o, step, 1 << o[step] AS own, list_sum(list_transform([0] || o[1:step - 1], lambda x, i: CASE WHEN i = 1 THEN 0 ELSE 1 << x END))::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, o, step, own,
    coalesce(sum(n) FILTER (fails & (own | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails & own > 0 AND fails & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails & own > 0 AND fails & before > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails & own > 0 AND fails & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails & own > 0 AND fails & before = 0), 0)::BIGINT AS toxic_lost
    FROM m, p GROUP BY part, o, step, own)
SELECT part, array_to_string(list_transform(o, lambda x: '{_FILTERS}'[x + 1]), '') AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""


def _crc_table() -> list[int]:
    """The CRC-32 of every byte, by its rule."""
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in out]
    return out


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR END"


def _nodes(name: str, leaves: str) -> str:
    return f"""{name} AS (SELECT g, 0 AS lvl, i, n, h FROM {leaves}
    UNION ALL SELECT g, lvl + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, lvl, i // 3)"""


def _steps(name: str, nodes: str, leaves: str) -> str:
    """For each leaf and level the hex digests left and right of its node."""
    own = "(a.i // (3 ** b.lvl)::BIGINT)"
    side = lambda op: f"coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i {op} {own}), '')"
    return f"""{name} AS (SELECT g, i, list(struct_pack(l := l, r := r) ORDER BY lvl) AS steps FROM (
    SELECT a.g, a.i, b.lvl, {side("<")} AS l, {side(">")} AS r FROM {leaves} a JOIN {nodes} b ON a.g = b.g AND b.n > 1 AND b.i // 3 = {own} // 3 GROUP BY ALL) GROUP BY g, i)"""


_LEAF = "sha256(" + " || ".join(_field(c) for c in merkle.FIELDS) + ")"
_CRC = f"list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, ({_crc_table()}::BIGINT[])[(xor(a, b) & 255) + 1]))"
OP12 = f"""
WITH RECURSIVE
d AS (SELECT *, {_CRC} & 1 = 1 AS tampered FROM documents),
hashed AS (SELECT doc_id, source, {_LEAF} AS h FROM d),
damaged AS (SELECT doc_id, {_LEAF} AS f FROM (SELECT doc_id, source, lang, n_chars, CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS text FROM d)),
leaves AS (SELECT doc_id, h, f, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM hashed JOIN damaged USING (doc_id)),
{_nodes("nodes", "leaves")},
subroots AS (SELECT 0 AS g, g AS i, count(*) OVER () AS n, h FROM nodes WHERE n = 1),
{_nodes("tops", "subroots")},
{_steps("low", "nodes", "leaves")},
{_steps("high", "tops", "subroots")},
proved AS (SELECT doc_id, leaves.h AS leaf, f, subroots.h AS subroot, coalesce(low.steps, []) || coalesce(high.steps, []) AS steps
    FROM leaves JOIN subroots ON subroots.i = leaves.g LEFT JOIN low ON low.g = leaves.g AND low.i = leaves.i LEFT JOIN high ON high.i = leaves.g),
folded AS (SELECT *, (SELECT h FROM tops WHERE n = 1) AS root, list_reduce([f] || list_transform(steps, lambda s: s.l || ',' || s.r), lambda a, s: sha256(split_part(s, ',', 1) || a || split_part(s, ',', 2))) AS folded_root FROM proved)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

_WORDS = f"regexp_extract_all({lowered('text')}, '{decontaminate.WORD}')"
_WIN = decontaminate.WINDOW
OP13 = f"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
patterns AS (SELECT DISTINCT item, l, array_to_string(w[k:k + l - 1], ' ') AS win FROM (SELECT item, w, least(len(w), {_WIN}) AS l, unnest(range(1, greatest(len(w) - {_WIN - 1}, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, l, k, array_to_string(w[k:k + l - 1], ' ') AS win FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM patterns))),
hits AS (SELECT * FROM places SEMI JOIN patterns USING (win)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS place FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits JOIN patterns USING (win)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SQL = {"op2_licenses": OP2, "op3_exact_dedup": OP3, "op4_secrets": OP4, "op10_url_filter": OP10, "op11_filter_audit": OP11, "op12_merkle": OP12, "op13_decontaminate": OP13}
