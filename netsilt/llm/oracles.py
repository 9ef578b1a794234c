"""DuckDB SQL of the llm queries that SQL can express."""

#: A conversation's digests do not depend on the template except for formatted_chars: each turn
#: adds the marks (12 + 1 + 10 + 1 characters) and one character per backslash; "<|" keeps its length.
OP7 = r"""
WITH given AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + 24 + length(role || text) - length(replace(role || text, '\', '')))::BIGINT AS formatted_chars
FROM given GROUP BY conv_id
"""

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM m
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CTE ``crc(doc_id, c)``: unsigned CRC-32 of the decimal doc_id.
CRC = """
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table)"""

OP11 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex(LOWERED, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
w AS (SELECT lang, piece, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM numbered),
w3 AS (SELECT lang, x, lead(x) OVER next AS y, lead(x, 2) OVER next AS z FROM w WINDOW next AS (PARTITION BY piece ORDER BY i)),
g AS (SELECT lang, 1 AS k, x AS phrase, count(*)::BIGINT AS f FROM w3 GROUP BY ALL
  UNION ALL SELECT lang, 2, x || ' ' || y, count(*)::BIGINT FROM w3 WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*)::BIGINT FROM w3 WHERE z IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM g WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.*, j, array_to_string(ws[:j], ' ') AS one, array_to_string(ws[j + 1:], ' ') AS two FROM c, (VALUES (1), (2)) AS s(j) WHERE j < k),
scored AS (SELECT u.lang, u.phrase, a, u.k, j, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts u JOIN g x ON x.lang = u.lang AND x.phrase = one JOIN g y ON y.lang = u.lang AND y.phrase = two),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
around AS (SELECT lang, array_to_string(ws[j:j + 1], ' ') AS phrase, max(a) AS a FROM c, (VALUES (1), (2)) AS s(j) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN around o ON o.lang = w.lang AND o.phrase = w.phrase AND k = 2 WHERE o.a IS NULL OR 100 * o.a < 50 * w.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
""".replace("LOWERED", _LOWER.format("coalesce(text, '')"))

_DOMAIN = "regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '')"
_SUFFIXES = """('ac.uk','co.jp','co.nz','co.uk','co.za','com.ar','com.au','com.br','com.cn','com.mx','com.tr','gov.uk',
  'ne.jp','net.au','or.jp','org.au','org.uk')"""
_WEIGHT = """(SELECT 1 / least(greatest(CASE WHEN most <> 0 THEN over_::DOUBLE / most::DOUBLE ELSE 1e-4::DOUBLE END, 1e-4::DOUBLE), 0.5::DOUBLE) - 1 AS w FROM (
  SELECT sum(round_even(((bad - n * m) * (bad - n * m) - n * m * (1 - m)) * 1000000, 0)::HUGEINT) AS over_,
    sum(round_even(n * m * (1 - m) * (n - 1) * 1000000, 0)::HUGEINT) AS most FROM {}))"""

OP12 = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, rule, name, start) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
fit AS (SELECT p.host, p.path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) p JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY ALL),
outcomes AS (SELECT doc_id, max(toxic) AS bad FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
counted AS (SELECT host, count(o.bad)::DOUBLE AS n, coalesce(sum(o.bad), 0)::DOUBLE AS bad FROM p LEFT JOIN outcomes o ON o.doc_id = page_id GROUP BY host),
named AS (SELECT *, {_DOMAIN} AS name, array_to_string(string_split(name, '.')[-2:], '.') AS two,
  regexp_matches(name, '^([0-9]+\\.){{3}}[0-9]+$|^\\[') OR NOT contains(name, '.') AS address FROM counted),
host AS (SELECT host, n, bad, CASE WHEN address THEN name WHEN two IN {_SUFFIXES} THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE two END AS domain,
  CASE WHEN address THEN '' WHEN two IN {_SUFFIXES} THEN two ELSE string_split(name, '.')[-1] END AS suffix FROM named),
domain AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM host GROUP BY ALL),
suffix AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (sum(sum(bad)) OVER () + 1.0::DOUBLE) / (sum(sum(n)) OVER () + 2.0::DOUBLE) AS m FROM domain GROUP BY suffix),
suffix_share AS (SELECT suffix, (bad + w * m) / ((bad + w * m) + (n - bad + w * (1 - m))) AS m FROM suffix, {_WEIGHT.format('suffix')}),
domain_prior AS (SELECT domain, d.n, d.bad, s.m FROM domain d JOIN suffix_share s USING (suffix)),
domain_share AS (SELECT domain, (bad + w * m) / ((bad + w * m) + (n - bad + w * (1 - m))) AS m FROM domain_prior, {_WEIGHT.format('domain_prior')}),
host_prior AS (SELECT host, h.n, h.bad, d.m FROM host h JOIN domain_share d USING (domain)),
ab AS (SELECT host, bad + w * m AS a, n - bad + w * (1 - m) AS b FROM host_prior, {_WEIGHT.format('host_prior')}),
bound AS (SELECT host, greatest(0.0::DOUBLE, a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS bound FROM ab)
SELECT page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, CASE WHEN bound > 0.25 AND (SELECT sum(n) FROM counted) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit ON fit.host = p.host AND fit.path = p.path JOIN bound ON bound.host = p.host
"""


def _tree(name: str, depth: int) -> str:
    """CTEs of the levels ``{name}0`` (given) to ``{name}<depth>`` and of their runs of 16 nodes."""
    return ",\n".join(f"""{name}_run{k} AS (SELECT grp, pos // 16 AS run, list(digest ORDER BY pos) AS ds, any_value(n) AS n FROM {name}{k} WHERE n > 1 GROUP BY ALL),
{name}{k + 1} AS (SELECT grp, run AS pos, (n + 15) // 16 AS n, sha256(array_to_string(ds, '')) AS digest FROM {name}_run{k})""" for k in range(depth))


def _walk(first: str, name: str, grp: str, at: str, prefix: str, depth: int) -> tuple[str, str]:
    """CTEs that take the rows of ``first`` up ``depth`` levels: cur is folded, proof grows by the siblings."""
    out, last = [], first
    for k in range(depth):
        out.append(f"""{prefix}{k} AS (SELECT w.* EXCLUDE ({at}, cur, proof), {at} // 16 AS {at},
  CASE WHEN r.ds IS NULL THEN cur ELSE sha256(array_to_string(r.ds[:{at} % 16], '') || cur || array_to_string(r.ds[{at} % 16 + 2:], '')) END AS cur,
  proof || CASE WHEN r.ds IS NULL THEN '' ELSE array_to_string(r.ds[:{at} % 16], '') || array_to_string(r.ds[{at} % 16 + 2:], '') END AS proof
  FROM {last} w LEFT JOIN {name}_run{k} r ON r.grp = {grp} AND r.run = {at} // 16)""")
        last = f"{prefix}{k}"
    return ",\n".join(out), last


_DEPTH = 6      # up to 16 ** 6 rows a source, and sources
_up, _end = _walk("start", "node", "w.grp", "pos", "up", _DEPTH)
_top, _root = _walk(f"{_end}", "src", "0", "gpos", "top", _DEPTH)
_field = lambda c, v=None: f"coalesce(octet_length(encode(({v or c})::VARCHAR))::VARCHAR || ':' || ({v or c})::VARCHAR, '-')"
_leaf = lambda text: "sha256(" + " || ".join(
    [*map(_field, ("d.doc_id", "source", "lang", "n_chars")), _field("text", text)]) + ")"

OP13 = f"""
WITH {CRC},
given AS (SELECT d.doc_id, source, {_leaf('text')} AS leaf, CASE WHEN c % 5 = 0 THEN {_leaf(_LOWER.format('text'))} END AS other
  FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, count(*) OVER (PARTITION BY source) AS n,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM given),
node0 AS (SELECT grp, pos, n, leaf AS digest FROM placed),
{_tree('node', _DEPTH)},
sub AS ({" UNION ALL ".join(f"SELECT grp, digest FROM node{k} WHERE n = 1" for k in range(_DEPTH + 1))}),
src0 AS (SELECT 0 AS grp, grp AS pos, count(*) OVER () AS n, digest FROM sub),
{_tree('src', _DEPTH)},
root AS ({" UNION ALL ".join(f"SELECT digest FROM src{k} WHERE n = 1" for k in range(_DEPTH + 1))}),
start AS (SELECT doc_id, leaf, grp, grp AS gpos, pos, coalesce(other, leaf) AS cur, '' AS proof FROM placed),
{_up},
{_top}
SELECT doc_id, leaf, sub.digest AS subroot, root.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root.digest AS verified
FROM {_root} w JOIN sub ON sub.grp = w.grp, root
"""

ORACLES: dict[str, str] = {
    "op1_topk": OP1, "op7_chat": OP7, "op10_warc": OP10, "op11_collocations": OP11, "op12_url_reputation": OP12, "op13_manifest": OP13}
