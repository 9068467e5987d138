"""SQL (DuckDB) for the queries that SQL can express."""

from gridloom.llm import mixing, quality_ledger, url_reputation

WORD = r"[^\x20\x09-\x0D]+"


def base32(hexed: str) -> str:
    letters = []
    for at in range(0, 40, 5):
        number = f"('0x' || substr({hexed}, {at + 1}, 5))::INT"
        letters += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({number} >> {by}) & 31) + 1, 1)" for by in (15, 10, 5, 0)]
    return " || ".join(letters)


def _op2() -> str:
    bits = " + ".join(f"(CASE WHEN {fails} THEN {1 << bit} ELSE 0 END)" for bit, fails in quality_ledger.RULES.values())
    base, v1 = quality_ledger.mask("base"), quality_ledger.mask("v1")
    symbols = " + ".join(f"(length(t) - length(replace(t, '{c}', '')))" for c in quality_ledger.SYMBOLS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(len(words))) AS p, unnest(words) AS w FROM d),
win AS (SELECT doc_id, p, w || ' ' || {" || ' ' || ".join(f"lead(w, {n}) OVER o" for n in range(1, 8))} AS s FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
rep AS (SELECT doc_id, p FROM win WHERE s IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, p + k FROM rep, (SELECT unnest(range(8)) AS k)) GROUP BY 1),
ln AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, ({symbols})::BIGINT AS n_symbols,
  coalesce(ln.dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(ln.n, 0)::BIGINT AS n_lines,
  length(array_to_string(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]+'), ''))::BIGINT AS n_caps, length(array_to_string(regexp_extract_all(t, '\p{{L}}+'), ''))::BIGINT AS n_letters
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN ln ON ln.doc_id = d.doc_id),
b AS (SELECT *, ({bits})::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {base}) <> 0 AS base_failed, (failed_bits & {base}) = 0 AND (failed_bits & {v1}) = 0 AS kept, failed_bits FROM b"""


def _ablations() -> str:
    whole = quality_ledger.mask("v1")
    each = [f"SELECT '{n}' AS rule, count(*) FILTER (b & {bit} <> 0) AS failed, count(*) FILTER (b = {bit}) AS failed_alone, count(*) FILTER (b & {whole - bit} = 0) AS kept_without FROM l" for n in quality_ledger.POLICIES["v1"] for bit in [1 << quality_ledger.RULES[n][0]]]
    return f"WITH l AS (SELECT failed_bits & {whole} AS b FROM ({_op2()})) {' UNION ALL '.join(each)}"


OP3 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT *, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {base32("x")} AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM g"""


def _op5() -> str:
    rule = "NULL"
    for r in sorted(url_reputation.RULES, key=lambda r: (len(r), r)):
        at = r.index("/")
        rule = f"CASE WHEN (host = '{r[:at]}' OR ends_with(host, '.{r[:at]}')) AND starts_with(path, '{r[at:]}') THEN '{r}' ELSE {rule} END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in url_reputation.RULES.items()) + f" ELSE CASE WHEN low > (SELECT {url_reputation.LIFT}*p/(1 - p + {url_reputation.LIFT}*p) FROM t) THEN 'block' ELSE 'allow' END END"
    two = ", ".join(f"'{s}'" for s in url_reputation.TWO_LABEL_SUFFIXES)
    last = lambda n: f"array_to_string(string_split(host, '.')[-{n}:], '.')"
    moments = ", ".join(
        f"k_{lv} AS (SELECT CASE WHEN rho > 0 THEN least(10000, greatest(2, 1/rho - 1)) ELSE 10000 END AS k FROM (SELECT CASE WHEN p > 0 AND p < 1 AND (tn - sum(n*n)/tn - (count(*)-1)) > 0 THEN ((sum(bad*bad/n) - tb*tb/tn)/(p*(1-p)) - (count(*)-1))/(tn - sum(n*n)/tn - (count(*)-1)) ELSE 0 END AS rho FROM (SELECT {lv}, sum(n) AS n, sum(bad) AS bad FROM h WHERE n > 0 GROUP BY 1), t GROUP BY p, tn, tb))"
        for lv in url_reputation.LEVELS
    )
    z = url_reputation.Z
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h0 AS (SELECT host, count(quality)::DOUBLE AS n, coalesce(sum(1 - quality), 0)::DOUBLE AS bad FROM u LEFT JOIN labels ON doc_id = page_id GROUP BY 1 HAVING host <> '' OR n > 0),
h AS (SELECT *, CASE WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM h0),
t AS (SELECT sum(n) AS tn, sum(bad) AS tb, sum(bad)/sum(n) AS p FROM h), {moments},
s AS (SELECT suffix, (sum(bad) + any_value(k)*any_value(p))/(sum(n) + any_value(k)) AS ms FROM h, k_suffix, t GROUP BY 1),
dm AS (SELECT h.suffix, domain, (sum(bad) + any_value(k)*any_value(ms))/(sum(n) + any_value(k)) AS md FROM h JOIN s ON s.suffix = h.suffix, k_domain GROUP BY 1, 2),
q AS (SELECT host, n + k AS size, (bad + k*md)/(n + k) AS m FROM h JOIN dm ON dm.suffix = h.suffix AND dm.domain = h.domain, k_host),
low AS (SELECT host, greatest(m - {z}*sqrt(m*(1-m)/(size+1)), 0) AS low FROM q),
j0 AS (SELECT u.*, low.low AS low FROM u LEFT JOIN low ON low.host = u.host), j AS (SELECT *, {rule} AS rule FROM j0)
SELECT page_id, host, path, rule, {verdict} AS verdict FROM j"""


def _op6() -> str:
    key = "coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))"
    u = [f"('0x' || substr(md5(key || ':{n // 4}'), {8 * (n % 4) + 1}, 8))::BIGINT" for n in range(mixing.SEEDS)]
    weights = f"[{', '.join(map(str, mixing.WEIGHTS))}]"
    n = mixing.SEEDS
    sums = ", ".join(f"[{', '.join(f'sum(CASE WHEN half = {h} AND {u[i]} < chance THEN size ELSE 0 END)' for i in range(n))}] AS x{h}" for h in (0, 1))
    pick = f"CASE (CASE WHEN half = 0 THEN seed // {n} ELSE seed % {n} END) " + " ".join(f"WHEN {i} THEN {u[i]}" for i in range(n)) + " END"
    return rf"""
WITH l AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, {key} AS key, ('0x' || substr(md5({key} || ':half'), 1, 1))::INT % 2 AS half FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM l GROUP BY 1),
r AS (SELECT *, {weights}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)})::INT + 1] AS w, ss*{mixing.CAP} AS full_ FROM s),
v AS (SELECT *, row_number() OVER o AS place, ((sum(ss) OVER ())::BIGINT - coalesce(sum(full_) OVER b, 0)::BIGINT)/((sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER b, 0)::BIGINT)::DOUBLE AS lv FROM r WINDOW o AS (ORDER BY full_/w::DOUBLE, source NULLS LAST), b AS (ORDER BY full_/w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT (SELECT lv FROM v WHERE lv*w <= full_ ORDER BY place LIMIT 1) AS lv),
t AS (SELECT source, ss, CASE WHEN c.lv IS NULL OR c.lv*w > full_ THEN full_::DOUBLE ELSE c.lv*w END AS target FROM v, c),
a AS (SELECT *, floor(coalesce(target/nullif(ss, 0), 0))::BIGINT AS whole, trunc((coalesce(target/nullif(ss, 0), 0) - floor(coalesce(target/nullif(ss, 0), 0)))*4294967296)::BIGINT AS chance FROM t),
x AS (SELECT a.source, any_value(target - whole*ss) AS wanted, {sums} FROM l JOIN a ON l.source IS NOT DISTINCT FROM a.source GROUP BY a.source),
e AS (SELECT source, k AS seed FROM x, (SELECT unnest(range({n * n})) AS k) QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(x0[k // {n} + 1] + x1[k % {n} + 1] - wanted), k) = 1)
SELECT doc_id, size, ss AS source_size, target, (size*(whole + CASE WHEN {pick} < chance THEN 1 ELSE 0 END))::BIGINT AS taken FROM l JOIN a ON l.source IS NOT DISTINCT FROM a.source JOIN e ON l.source IS NOT DISTINCT FROM e.source"""


OP9 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, 15 + length(role) + len(string_split(role, '\')) - 1 + len(string_split(role, '<')) - 1 + len(string_split(role, chr(10))) - 1 + length(text) + len(string_split(text, '\')) - 1 + len(string_split(text, '<')) - 1 AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p, count(*) OVER (PARTITION BY conv_id) AS m FROM c),
r AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY p) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256, coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(CASE WHEN role = 'assistant' OR p = m THEN upto END)::BIGINT AS formatted_chars FROM r GROUP BY conv_id"""


OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT row_number() OVER () AS pid, lang, w FROM (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d) WHERE len(w) > 0),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS MATERIALIZED (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE words = 1 GROUP BY 1),
h AS MATERIALIZED (SELECT lang, words, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE f >= 30),
c AS (SELECT lang, phrase, words, w, f AS a, unnest(range(1, words)) AS k FROM h WHERE words >= 2),
j AS (SELECT c.lang, c.phrase, c.words, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score FROM c JOIN h x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN h y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
e AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS f FROM (SELECT *, unnest(range(1, words - m + 2)) AS i FROM h, (SELECT unnest([2, 3]) AS m) WHERE words > m) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN e ON e.lang = b.lang AND e.phrase = b.phrase WHERE e.f IS NULL OR 100::HUGEINT * e.f < 80::HUGEINT * b.a)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n ON n.lang = o.lang QUALIFY rank <= 2000"""


def _op12() -> str:
    def assign(name: str, book: str) -> str:
        met = f"SELECT s.rn, s.part, b.entry, sum((s.x - b.x)*(s.x - b.x))::BIGINT AS d FROM s JOIN {book} b ON b.part = s.part AND b.pos = s.pos GROUP BY ALL"
        return f"{name} AS MATERIALIZED (SELECT rn, part, min(d*64 + entry) % 64 AS entry, min(d*64 + entry) // 64 AS d FROM ({met}) GROUP BY ALL)"

    def move(name: str, assigned: str, book: str) -> str:
        mean = "(sum(s.x)::BIGINT - ((sum(s.x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*)"  # floors negative sums too
        means = f"SELECT s.part, a.entry, s.pos, {mean} AS x FROM s JOIN {assigned} a ON a.rn = s.rn AND a.part = s.part GROUP BY ALL"
        return f"{name} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN ({means}) m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"

    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256*x::DOUBLE)::BIGINT) AS e, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rn FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT rn, o // (n // 16) AS part, o % (n // 16) AS pos, e[o + 1] AS x FROM (SELECT rn, e, len(e) AS n, unnest(range(len(e))) AS o FROM v)),
b0 AS MATERIALIZED (SELECT part, rn AS entry, pos, x FROM s WHERE rn < 64),
{assign('a0', 'b0')}, {move('b1', 'a0', 'b0')}, {assign('a1', 'b1')}, {move('b2', 'a1', 'b1')}, {assign('a2', 'b2')},
c AS (SELECT rn, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256 FROM v JOIN c ON c.rn = v.rn"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_ledger": _op2(), "quality_ablations": _ablations(), "op3_warc_salvage": OP3, "op5_url_reputation": _op5(), "op6_source_mixing": _op6(), "op9_chat_format": OP9, "op11_phrase_collocations": OP11, "op12_vector_codes": _op12()}
