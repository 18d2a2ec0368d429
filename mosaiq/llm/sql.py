"""SQL (DuckDB) for what of the operators' results SQL can express: op5, op8 and op9 whole, and the columns of op1, op2 and
op10 that no method decides. Written from the definitions, for another engine, over the same tables; rules, patterns and limits are stated here
once more, so that a slip in the operators' own can't pass on both sides."""

from __future__ import annotations

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(texts) -> str:
    return "[" + ", ".join(map(_quoted, texts)) + "]"


#: CRC-32 of a list of bytes, bit by bit through a table of 256 entries that is made here.
CRC = """tab AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n)))"""


def _crc(text: str) -> str:
    digit = lambda i: f"(instr('0123456789ABCDEF', x[{i}]) - 1)"
    bytes_ = f"(SELECT list_transform(range(len(x) // 2), lambda i: {digit('2*i+1')} * 16 + {digit('2*i+2')}) FROM (SELECT CASE WHEN {text} = '' THEN [] ELSE string_split(hex(encode({text})), '') END AS x))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


# What fails a text (measure, low, high), and the stop words of four languages.
QUALITY = (
    ("length", "n_words", 50, None), ("word_length", "mean_word", 1.5, 20), ("symbols", "symbol_ratio", None, 0.25), ("stop_words", "stop_ratio", 0.02, None),
    ("repeated_lines", "dup_line_ratio", None, 0.5), ("repeated_words", "repeat_ratio", None, 0.5), ("separators", "separator_ratio", None, 0.2), ("shouting", "upper_ratio", None, 0.6),
)
STOP = """a als and are as as au auf avec be con das de de de del dem den der des des die du ein eine el elle en en es est et for für have il im in in is ist it la la las le les lo los
mit nicht no of on para pas por pour que que qui sich se su sur that the this to un un una und une von was with y zu dans al"""


def _quality() -> str:
    stop = dict.fromkeys(STOP.split())
    ratio = lambda part, of: f"CASE WHEN {of} > 0 THEN {part}::DOUBLE / {of} ELSE 0 END"
    sides = lambda m, low, high: " OR ".join(x for x in (low is not None and f"{m} < {low}::DOUBLE", high is not None and f"{m} > {high}::DOUBLE") if x)
    failed = ", ".join(f"CASE WHEN {sides(*r)} THEN '{name}' END" for name, *r in QUALITY)
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
s AS MATERIALIZED (SELECT *, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
win AS (SELECT n, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT n, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
twice AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, a, b, c) AS k FROM win) WHERE k > 1),
rep AS (SELECT n, count(DISTINCT p) AS k FROM (SELECT n, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY n),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
coalesce(k, 0) AS n_repeat_words, len(list_filter(w, lambda x: list_contains({_listed(stop)}, lower(x)))) AS n_stop, length(t) - length(translate(t, '|', '')) AS n_separators,
length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS n_letters, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_upper FROM s LEFT JOIN rep USING (n)),
q AS (SELECT *, {ratio('word_chars', 'n_words')} AS mean_word, {ratio('n_symbols', 'word_chars')} AS symbol_ratio, {ratio('n_stop', 'n_words')} AS stop_ratio, {ratio('n_dup_lines', 'n_lines')} AS dup_line_ratio,
{ratio('n_repeat_words', 'n_words')} AS repeat_ratio, {ratio('n_separators', 'n_words')} AS separator_ratio, {ratio('n_upper', 'n_letters')} AS upper_ratio FROM m),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {failed}) AS failed FROM q)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
base_failed, NOT base_failed AND failed = '' AS kept, failed FROM f"""


# Kind, pattern, group, least characters of it. The first three are the base.
SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16),
    ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1), ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1), ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1), ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


def _secrets() -> str:
    each = []
    for order, (kind, pattern, group, least) in enumerate(SECRETS):
        p = _quoted(pattern)
        start = "CAST(coalesce(list_sum(list_transform(b[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS BIGINT)"
        each.append(f"SELECT n, {order} AS o, '{kind}' AS kind, {start} AS s, length(m[k]) AS len FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT n, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS g, string_split_regex(t, {p}) AS b FROM d)) WHERE length(g[k]) >= {least}")
    text = "kind || ':' || s || ':' || (s + len), ',' ORDER BY s, o"
    counts = ", ".join(f"CAST(count(*) FILTER (o = {i}) AS BIGINT) AS n_{kind}" for i, (kind, *_) in enumerate(SECRETS[:3]))
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({' UNION ALL '.join(each)})
SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce(string_agg({text}) FILTER (o < 3), '')) AS base_sha256, coalesce(string_agg({text}) FILTER (o IS NOT NULL), '') AS spans
FROM d LEFT JOIN x USING (n) GROUP BY n"""


NEAR_VECTORS = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
fine AS MATERIALIZED (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS k FROM p GROUP BY a) l ON l.a = vec_id JOIN (SELECT id, min(c) AS component_id FROM r GROUP BY id) g ON g.id = vec_id"""


SHARDS = f"""WITH {CRC}
SELECT doc_id, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, CAST({_crc('t')} AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(1 AS BIGINT) AS shards_of_text, true AS gapless
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), tab"""


# The contract's rules.
URLS = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def _urls() -> str:
    host = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cases = ""
    for verdict, rule in sorted(URLS, key=lambda r: -len(r[1])):
        domain, slash, rest = rule.partition("/")
        cases += f" WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash}{rest}') THEN '{verdict} {rule}'"
    return rf"""WITH u AS (SELECT page_id, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages), f AS (SELECT *, CASE{cases} END AS f FROM u)
SELECT page_id, host, path, split_part(f, ' ', 2) AS rule, split_part(f, ' ', 1) AS ruled FROM f"""


TOKENS = f"""WITH {CRC},
d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, {_crc("coalesce(doc_id::VARCHAR, '')")} % 7 = 2 AS held_out, list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}'), lambda x: x <> ''), chr(10)) AS w FROM documents, tab),
t AS MATERIALIZED (SELECT n, held_out, unnest(w) AS w FROM d),
c AS MATERIALIZED (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
a AS (SELECT coalesce(sum(c), 0) AS total, count(*) AS types FROM c)
SELECT any_value(doc_id) AS doc_id, any_value(d.held_out) AS held_out, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(c.c) AS BIGINT) AS n_known, CAST(any_value(total) AS BIGINT) AS train_tokens,
round(sum(log10((coalesce(c.c, 0) + 1) / (total + types + 1)::DOUBLE)), 3) AS base_score FROM d JOIN t USING (n) LEFT JOIN c ON c.w = t.w, a GROUP BY n"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": _quality(), "op8_find_secrets": _secrets(), "op9_near_vectors": NEAR_VECTORS,
        "fixed1_shards": SHARDS, "fixed2_rules": _urls(), "fixed10_counts": TOKENS,
    }
