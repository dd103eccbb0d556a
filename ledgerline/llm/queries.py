"""The registered queries of the document operators: ``opN_`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import embeddings, exact, importance, jaccard, langid, licenses, lines, mixing, packing, quality, repeats, tokens, trie
from ._shared import ready, table


def _vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


MIX_ENTROPY = 0.97   # of the entropy that equal weights would have


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of as many tokens as the corpus has, a row for each time a document is read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    tokens = docs.agg(F.sum(mixing.estimated_tokens(F.col("text"))).alias("n")).first()["n"] or 0
    mixed = mixing.mix(docs, target_entropy=MIX_ENTROPY, budget_tokens=tokens)
    return mixed.select("doc_id", "source", "mix_pass", "mix_block", "mix_rank", "mix_tokens")


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def _bisected() -> str:
    """The exponent by the same bisection, one step a row."""
    z, s = "(SELECT sum(pow(p, mid)) FROM p)", "(SELECT sum(pow(p, mid) * ln(p)) FROM p)"
    return f"""
p AS (SELECT tokens / (SELECT sum(tokens) FROM sizes)::DOUBLE AS p FROM sizes),
ends AS (SELECT count(*) AS n, min(p) AS lo, max(p) AS hi, -sum(p * ln(p)) AS h FROM p),
b AS (SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0.5::DOUBLE AS mid
  UNION ALL
  SELECT step + 1, CASE WHEN lower THEN low ELSE mid END, CASE WHEN lower THEN mid ELSE high END,
    CASE WHEN lower THEN (low + mid) / 2 ELSE (mid + high) / 2 END
  FROM (SELECT *, ln({z}) - mid * {s} / {z} < {MIX_ENTROPY} * ln(n) AS lower FROM b, ends WHERE step < {mixing.STEPS})),
power AS (SELECT CASE WHEN lo = hi OR h >= {MIX_ENTROPY} * ln(n) THEN 1.0 ELSE round((SELECT low FROM b WHERE step = {mixing.STEPS}), 6) END AS a FROM ends)"""


def _round(i: int) -> str:
    """One round over what is not taken yet: documents by draw, as long as they fit the room left."""
    return f"""
f{i} AS (SELECT *, NOT taken AND tokens <= room AS fits, sum(CASE WHEN NOT taken AND tokens <= room THEN tokens ELSE 0 END) OVER (PARTITION BY source, block, pass
      ORDER BY {_draw("'0'", "pass::VARCHAR", "'doc'", "coalesce(doc_id::VARCHAR, '-')")}, doc_id RANGE UNBOUNDED PRECEDING) AS spent FROM r{i}),
r{i + 1} AS (SELECT doc_id, source, pass, block, rnk, tokens, room - max(CASE WHEN fits AND spent <= room THEN spent ELSE 0 END) OVER (PARTITION BY source, block, pass) AS room,
    taken OR (fits AND spent <= room) AS taken FROM f{i})"""


OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, greatest(1, ceil(strlen(coalesce(text, '')) / 4))::BIGINT AS tokens FROM documents),
sizes AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY source),{_bisected()},
z AS (SELECT sum(pow(tokens::DOUBLE, a)) AS z, sum(tokens)::DOUBLE AS t FROM sizes, power),
plan AS (SELECT source, tokens, round(pow(tokens::DOUBLE, a) / z * t)::BIGINT AS budget,
    ceil(tokens / greatest({mixing.BLOCK_TOKENS}, t::BIGINT // {mixing.MOST_BLOCKS} + 1))::BIGINT AS blocks FROM sizes, power, z),
sized AS (SELECT d.*, {_draw("'0'", "coalesce(doc_id::VARCHAR, '-')")} % blocks AS block FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
held AS (SELECT source, block, sum(tokens)::BIGINT AS size FROM sized GROUP BY ALL),
turns AS (SELECT held.source, block, size, budget // tokens AS passes, budget % tokens AS rest, unnest(range(0, budget // tokens + 1)) AS pass
    FROM held JOIN plan ON held.source IS NOT DISTINCT FROM plan.source),
placed AS (SELECT *, row_number() OVER w AS rnk, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM turns
    WINDOW w AS (PARTITION BY source, pass ORDER BY {_draw("'0'", "pass::VARCHAR", "coalesce(source, '-')", "block::VARCHAR")}, block)),
kept AS (SELECT *, CASE WHEN pass < passes OR upto <= rest THEN NULL ELSE rest - (upto - size) END AS room FROM placed),
r0 AS (SELECT doc_id, sized.source, pass, sized.block, rnk, tokens, room, room IS NULL AS taken
    FROM sized JOIN kept ON sized.source IS NOT DISTINCT FROM kept.source AND sized.block = kept.block WHERE room IS NULL OR room > 0),
{",".join(_round(i) for i in range(mixing.ROUNDS))}
SELECT doc_id, source, pass::INT AS mix_pass, block AS mix_block, rnk::INT AS mix_rank, tokens AS mix_tokens FROM r{mixing.ROUNDS} WHERE taken
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), keep_ids=False)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.languages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_known", F.size("matches").alias("n_matches"), F.array_join("licences", ",").alias("licences"))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _map(pairs) -> str:
    keys, values = zip(*pairs)
    return f"map([{', '.join(map(_text, keys))}], [{', '.join(map(_text, values))}])"


OP10_SQL = rf"""
WITH a AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.TAG}', chr(10) || chr(10) || 'spdx-license-identifier \1' || chr(10) || chr(10), 'g') AS t FROM documents),
l AS (SELECT doc_id, chr(2) || regexp_replace(regexp_replace(regexp_replace(t, '{licenses.ENDS}', chr(1), 'g'), '[^0-9a-z\x01\n]+', ' ', 'g'), '\n', chr(2), 'g') || chr(2) AS t FROM a),
-- Every end of a line or sentence twice, so that one can close a known sentence and the other open the next.
k AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([\x01\x02])', '\1\1', 'g'), '([\x01\x02] ?){licenses.pattern("[ " + chr(92) + "x02]+")}( ?[\x01\x02])', '\1' || chr(1) || '\2\3\4' || chr(1) || '\5', 'g') AS t FROM l),
b AS (SELECT doc_id, string_split(regexp_replace(t, '[ \x02]+', ' ', 'g'), chr(1)) AS s FROM k),
c AS (SELECT doc_id, list_filter(list_transform(s, lambda x: trim(x)), lambda x: x <> '') AS s FROM b),
e AS (SELECT doc_id, s, list_filter(range(1, len(s) + 1), lambda i: map_contains({_map(licenses.known().items())}, s[i])) AS spots FROM c),
f AS (SELECT doc_id, len(s) AS n_sentences, len(spots) AS n_known, coalesce(array_to_string(list_transform(range(1, len(spots) + 1),
    lambda k: CASE WHEN k > 1 AND spots[k] - spots[k - 1] - 1 > {licenses.GAP} THEN '|' ELSE '' END || {_map(licenses.known().items())}[s[spots[k]]] || ' '), ''), '') AS codes FROM e),
g AS (SELECT *, list_transform(regexp_extract_all(codes, '{"|".join(r for r, _ in licenses.rules())}'), lambda x: {_map(licenses.rules())}[x]) AS found FROM f)
SELECT doc_id, n_sentences::INT AS n_sentences, n_known::INT AS n_known, len(found)::INT AS n_matches, coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS licences FROM g
"""


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_rules(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) x(k) GROUP BY r),
raw AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
l AS (SELECT r, source, md5(t) AS copy, unnest(l) AS l FROM d JOIN raw USING (r)),
n AS (SELECT r, source, copy, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS l FROM l),
f AS (SELECT source, l FROM n JOIN (SELECT source AS s, count(DISTINCT md5(t)) AS texts FROM d GROUP BY ALL) ON source IS NOT DISTINCT FROM s
      GROUP BY source, l, texts HAVING count(DISTINCT copy) > MOST_DOCS AND 100 * count(DISTINCT copy) > MOST_PERCENT * texts),
lost AS (SELECT r, sum(len(string_split(n.l, ' '))) AS n FROM n JOIN f ON n.source IS NOT DISTINCT FROM f.source AND n.l = f.l GROUP BY r),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed
  FROM d JOIN w USING (r) JOIN raw USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_words - n_removed >= 10 AND 100 * n_removed <= MOST_REMOVED * n_words AS kept FROM v
""".replace("MOST_DOCS", str(lines.MOST_DOCS)).replace("MOST_PERCENT", str(lines.MOST_PERCENT)).replace("MOST_REMOVED", str(lines.MOST_REMOVED))


# CRC-32 of the words in a list ``w``, byte by byte; the table of 256 follows from the polynomial.
CRC_SQL = """
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab)"""


def _crc(x: str) -> str:
    """CRC-32 of a text in SQL, where ``crc_table`` is among the tables read."""
    octets = f"list_transform(range(octet_length(encode({x}))), lambda k: ('0x' || substr(hex(encode({x})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT)"


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = rf"""
WITH {CRC_SQL.strip()},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{importance.UPPER}', '{importance.LOWER}'), '{importance.WORD}') AS w FROM documents),
e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{importance.UPPER}', '{importance.LOWER}'), '{importance.WORD}') AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS w FROM d), ew AS (SELECT unnest(w) AS w FROM e),
b AS (SELECT w, {_crc('w')} % {importance.BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM ew), crc_table),
s AS (SELECT b, count(*) AS s FROM dw JOIN b USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM ew JOIN b USING (w) GROUP BY b),
g AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {importance.BUCKETS})) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM ew) + {importance.BUCKETS}))))::BIGINT AS g
  FROM s LEFT JOIN t USING (b)),
m AS (SELECT r, floor(sum(g) / count(*))::BIGINT AS m FROM dw JOIN b USING (w) JOIN g USING (b) GROUP BY r),
z AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(m, 0)::BIGINT AS weight,
  (coalesce(m, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM d LEFT JOIN m USING (r)),
k AS (SELECT *, n_features >= {importance.LEAST_WORDS} AS able, row_number() OVER (PARTITION BY n_features >= {importance.LEAST_WORDS} ORDER BY score DESC, doc_id) AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT count(*) FROM z WHERE n_features >= {importance.LEAST_WORDS}) * {importance.PERCENT} // 100 THEN place END AS rank FROM k
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = rf"""
WITH {CRC_SQL.strip()},
t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, m, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS k FROM t),
c AS (SELECT conv_id, {_crc('conv_id::VARCHAR')} % {trie.HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
r AS (SELECT c.conv_id, 0 AS part, k, m, words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % {trie.BLOCK} AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, m, words FROM c JOIN o ON o.conv_id = c.conv_id AND k > h),
p AS (SELECT c.conv_id, coalesce(list(m ORDER BY part, k) FILTER (m IS NOT NULL), []) AS l, coalesce(list(words ORDER BY part, k) FILTER (m IS NOT NULL), []) AS w
  FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
x AS (SELECT conv_id, l, w, unnest(range(0, len(l) + 1)) AS d FROM p),
n AS (SELECT array_to_string(l[1:d], '') AS key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d = 0 THEN 0 ELSE w[d] END) AS words,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(l)), '') AS ends FROM x GROUP BY ALL),
kids AS (SELECT left(key, 32 * (depth - 1)) AS key, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL),
a AS (SELECT key, depth, words, n_convs, unnest(range(0, depth + 1)) AS up FROM n),
s AS (SELECT left(a.key, 32 * up) AS key, up AS depth, sum((n_convs - 1) * words) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
  FROM a LEFT JOIN kids ON kids.key = a.key AND kids.depth = a.depth GROUP BY ALL)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON s.key = n.key AND s.depth = n.depth LEFT JOIN kids ON kids.key = n.key AND kids.depth = n.depth
LEFT JOIN n u ON u.key = left(n.key, 32 * (n.depth - 1)) AND u.depth = n.depth - 1
"""


def _configured(fn: Callable) -> Callable:
    def run(spark, sf_dir):
        return fn(ready(spark), sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: _configured(fn) for name, fn in sorted(globals().items()) if name[:2] == "op" and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: globals()[f"{name.split('_')[0].upper()}_SQL"] for name in queries() if f"{name.split('_')[0].upper()}_SQL" in globals()}
