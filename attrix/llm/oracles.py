"""DuckDB SQL for the operators that SQL can express over whole tables."""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
origin AS (SELECT h, min(doc_id) AS first_id FROM win GROUP BY h),
hit AS (SELECT doc_id, p FROM win JOIN origin USING (h) WHERE first_id < doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM hit, range(0, 50) t(k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other),
part AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN part USING (vec_id) LEFT JOIN n ON n.a = v.vec_id"""

SHINGLE_JOIN = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
part AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d JOIN part USING (doc_id) LEFT JOIN n USING (doc_id)"""


def _crc_table() -> list[int]:
    """CRC-32 of every byte, by its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a SQL string expression."""
    return (f"xor(4294967295, list_reduce(list_transform(range(1, 2 * strlen({text}), 2), lambda i: CAST('0x' || substr(hex({text}), i, 2) AS BIGINT)), "
            f"lambda c, b: xor(c >> 8, ({_crc_table()})[CAST(xor(c, b) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)))")


_ASCII_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

RESAMPLE = rf"""
WITH texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_ASCII_LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts),
f AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]),
             list_transform(range(1, len(w) - 1), lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]))) AS feature FROM w),
n AS (SELECT side, id, feature, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT feature, {crc32("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM n)),
c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM n JOIN h USING (feature) GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM c),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM c, a),
d AS (SELECT id AS doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM n JOIN h USING (feature) JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
x AS (SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             CAST('0x' || substr(sha256('42:' || w.id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d ON d.doc_id = w.id WHERE side = 0),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
r AS (SELECT *, n_words >= 20 AS candidate, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS total FROM y)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN candidate AND place <= 5 * total // 100 THEN place END AS rank FROM r"""


def _weight(url: str, terms: list[str], weight: int) -> str:
    return " + ".join(rf"CASE WHEN regexp_matches({url}, '(^|[^\pL\pN]){t}($|[^\pL\pN])') THEN {weight} ELSE 0 END" for t in terms)


def url_filter(strict, soft, limit: int) -> str:
    """Host, path and rules of every page; then terms with no letter or digit beside them."""
    return rf"""
WITH u AS (SELECT page_id, url, translate(regexp_extract(url, '://([^/?#]*)', 1), {_ASCII_LOWER}) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT page_id, url, coalesce(host, '') AS host, coalesce(path, '') AS path FROM u),
rules(verdict, rule) AS (VALUES ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'), ('allow', 'org/fr/')),
split AS (SELECT *, substr(rule, 1, strpos(rule, '/') - 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN split
         ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
hits AS (SELECT page_id, {_weight("t", strict, limit)} + {_weight("t", soft, 1)} AS weight FROM (SELECT page_id, lower(url_decode(url)) AS t FROM p))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN weight >= {limit} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits USING (page_id) LEFT JOIN hits USING (page_id)"""


def _conversation_repair() -> str:
    """A row a step: the least (cost, audit, text so far) for each state that the repaired roles can be in.

    Insertions between two rows come before the later row's own edit.
    """
    def add(state: str, cost: str, letter: str, role: str | None = None, text: str = "''") -> str:
        line = "" if role is None else f", {{'k': {state}.k + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || [{role} || ':' || {text}]}}"
        return f"CASE WHEN {state} IS NOT NULL THEN {line[2:]} END" if line else f"CASE WHEN {state} IS NOT NULL THEN {{'k': {state}.k + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t}} END"

    # Insertions: u from nothing, s or a; then a from u; then u from a.
    opened = ("SELECT *, e AS e1, s AS s1, least(u, {eu}, {su}, {au}) AS u1, a AS a0 FROM q").format(
        eu=add("e", "3", "I", "'user'"), su=add("s", "3", "I", "'user'"), au=add("a", "3", "I", "'user'"))
    closed = f"SELECT *, least(a0, {add('u1', '3', 'I', chr(39) + 'assistant' + chr(39))}) AS a1 FROM ({opened})"
    keep = lambda state, initial: f"CASE WHEN must OR initial <> '{initial}' THEN NULL ELSE {add(state, 'late', 'K', 'role', 'text')} END"
    turn = lambda state, role: f"CASE WHEN must THEN NULL ELSE {add(state, '3 + late', 'R', chr(39) + role + chr(39), 'text')} END"
    gone = lambda state: add(state, "4", "D")
    u = [gone("u1")] + [f(x, k) for x in ("e1", "s1", "a1") for f, k in ((keep, "u"), (turn, "user"))]
    a = [gone("a1"), keep("u1", "a"), turn("u1", "assistant")]
    row = (f"SELECT conv_id, i, n, {gone('e1')} AS e, least({gone('s1')}, {keep('e1', 's')}) AS s, least({', '.join(u)}) AS u, least({', '.join(a)}) AS a "
           f"FROM ({closed})")
    state = "STRUCT(k BIGINT, a VARCHAR, t VARCHAR[])"
    none = f"CAST(NULL AS {state})"
    kind = crc32("(conv_id || ':' || turn)")
    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, {kind} % 20 AS kind FROM conversations),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind <> 0),
bare AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b, substr(role, 1, 1) AS initial,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn, copy) > 1 AS again FROM damaged),
rows AS (SELECT *, b = '' AS is_blank, b <> '' AND again AS is_again, b <> '' AND NOT again AND substr(b, -1) NOT IN ('.', '!', '?') AS is_cut,
                lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS is_illegal, count(*) OVER (PARTITION BY conv_id) AS n FROM bare),
sums AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE is_blank) AS blank, count(*) FILTER (WHERE is_again) AS duplicate,
                count(*) FILTER (WHERE is_cut) AS truncated, count(*) FILTER (WHERE is_illegal) AS illegal FROM rows GROUP BY conv_id),
steps AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, max(n) AS n, CAST({{'k': 0, 'a': '', 't': []}} AS {state}) AS e, {none} AS s, {none} AS u, {none} AS a FROM rows GROUP BY conv_id
  UNION ALL SELECT * FROM (WITH q AS (SELECT p.conv_id, r.i, p.n, e, s, u, a, role, text, initial, is_blank OR is_again AS must, CASE WHEN is_cut THEN 3 ELSE 0 END AS late
                                      FROM steps p JOIN rows r ON r.conv_id = p.conv_id AND r.i = p.i + 1) {row})),
q AS (SELECT * FROM steps WHERE i = n),
ends AS (SELECT conv_id, least(e1, a1) AS best FROM ({closed}))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.k, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums USING (conv_id) LEFT JOIN ends USING (conv_id)"""


CONVERSATION_REPAIR = _conversation_repair()
