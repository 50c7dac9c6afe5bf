"""Registered queries of this subpackage: name -> (function of a session and a table folder, DuckDB SQL or None)."""
from pyspark.sql import functions as F

from studyloom.llm import bitsliced, intervals, kneserney, licences, mixing, orderminhash, phrases, quadratic, rans, redirects, relz, tiling, toolcalls
from studyloom.llm.tables import Scratch


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(column, n):
    """Remainder of the crc32 of a column's text: the folds of the held-out rows."""
    return F.crc32(F.col(column).cast("string")) % n


#: Tools that the turns of a conversation call: a user's turn asks for an answer, a system's turn sets up.
TOOLS = {
    "answer": {"type": "object", "required": ["text", "words", "after"], "additionalProperties": False,
               "properties": {"text": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1, "maximum": 60},
                              "after": {"type": "array", "items": {"type": "string"}}}},
    "configure": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "maxLength": 400}, "words": {"type": "number"}}},
}


def turns_as_calls(conversations):
    """(calls, results) out of plain turns. A user's or system's turn is a call, the assistant's turn after it its result.

    A call uses the result of the call four turns before it; about one in sixteen (by its text) also that of two turns later.
    """
    t = conversations.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("bigint").alias("pos"), "role", "text")
    name = lambda turn: F.concat(F.lit("c"), "conv_id", F.lit("-"), turn.cast("string"))
    ref = lambda turn: F.struct(name(turn).alias("$ref"))
    pos = F.col("pos")
    after = F.array_compact(F.array(F.when(pos >= 4, ref(pos - 4)), F.when(F.crc32("text") % 16 == 0, ref(pos + 2))))
    arguments = F.to_json(F.struct("text", F.size(F.split("text", r"\s+")).alias("words"), after.alias("after")))
    calls = t.where("role in ('user', 'system')").select("conv_id", name(pos).alias("call_id"), "pos", F.when(F.col("role") == "user", "answer").otherwise("configure").alias("name"), arguments.alias("arguments"))
    results = t.where("role = 'assistant'").select("conv_id", name(pos - 1).alias("call_id"), "pos", F.col("text").alias("content"))
    return calls, results


def op1_tool_call_linking(spark, sf_dir):
    return toolcalls.link(spark, *turns_as_calls(table(spark, sf_dir, "conversations")), TOOLS)


def encoded(spark, docs):
    """Files of token ids with the end id 2, and what is read back from them."""
    import public_tokenizers

    path = f"{Scratch(spark).base}/blocks"
    freq, bits = rans.write(spark, docs, path, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return rans.read(spark, path, freq, bits)


def op2_token_ids_rans(spark, sf_dir):
    return encoded(spark, table(spark, sf_dir, "documents"))


def op3_mixing_temperature(spark, sf_dir):
    """At most four passes through a source for one through the source repeated least."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    got = mixing.copied(spark, docs, repeats=4.0)
    return got.select("doc_id", "source", F.col("__epoch").alias("epoch"), F.col("__place").alias("place"))


def op4_licence_sentence_rules(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_url_redirect_classes(spark, sf_dir):
    return redirects.judge(spark, table(spark, sf_dir, "pages"))


def op6_decontamination_tiling(spark, sf_dir):
    return tiling.find(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_duplicates_order_minhash(spark, sf_dir):
    return orderminhash.classes(spark, table(spark, sf_dir, "documents")).drop("node")


#: Labels of four crc32 fifths are used; one of these fits the curve.
TOXICITY = dict(id_col="doc_id", text_col="text", label_col="toxic", train=lambda key: F.crc32(key.cast("string")) % 5 != 0,
                calibrate=lambda key: F.crc32(key.cast("string")) % 5 == 4)


def op8_toxicity_kneser_ney(spark, sf_dir):
    return kneserney.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), **TOXICITY)


def op9_quality_quadratic(spark, sf_dir):
    return quadratic.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "quality",
                              bucket("doc_id", 3) != 1)


def op10_topk_bitsliced(spark, sf_dir):
    v = bitsliced.quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return bitsliced.top_k(spark, v, v.where("id % 50 = 0"), 5)


def op11_substring_dedup_relative_lz(spark, sf_dir):
    found = relz.factors(spark, table(spark, sf_dir, "documents"), spans=False)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i FROM d),
v AS (SELECT r, i, w, string_agg(w, ' ') OVER o AS text, count(*) OVER o AS n FROM t WINDOW o AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
h AS (SELECT r, i, row_number() OVER (PARTITION BY text ORDER BY r, i) AS k FROM v WHERE n = 20),
c AS (SELECT t.r, t.i, w, coalesce(max(h.i) FILTER (k > 1) OVER (PARTITION BY t.r ORDER BY t.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone
  FROM t LEFT JOIN h ON h.r = t.r AND h.i = t.i),
g AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (r)"""


def op12_phrases_direct_tiling(spark, sf_dir):
    return phrases.mine(spark, table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT piece, lang, unnest(w) AS w, unnest(range(len(w))) AS i FROM w),
s AS (SELECT lang, w AS x, lead(w, 1) OVER o AS y, lead(w, 2) OVER o AS z FROM t WINDOW o AS (PARTITION BY piece ORDER BY i)),
g AS (SELECT lang, 1 AS k, x AS phrase FROM s UNION ALL SELECT lang, 2, x || ' ' || y FROM s WHERE y IS NOT NULL UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM s WHERE z IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
parted AS (SELECT lang, k, phrase, a, 1 AS i, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM c
  UNION ALL SELECT lang, k, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] FROM c WHERE k = 3),
cut AS (SELECT parted.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS s FROM parted
  JOIN f x ON x.lang = parted.lang AND x.phrase = lp JOIN f y ON y.lang = parted.lang AND y.phrase = rp),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY s, i) = 1),
inner_ AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS m FROM inner_ GROUP BY ALL)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY s DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, CAST(s AS BIGINT) AS score
FROM best LEFT JOIN longer USING (lang, phrase) JOIN n USING (lang) WHERE k = 3 OR m IS NULL OR 100 * m < 50 * a QUALIFY rank <= 2000"""


def op13_ranked_search_intervals(spark, sf_dir):
    return intervals.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


OP13_SQL = r"""
WITH p AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term),
fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS big, 'abcdefghijklmnopqrstuvwxyz' AS small),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), big, small), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents, fold),
q AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), big, small), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark, fold),
asked AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(t) AS t FROM q) GROUP BY ALL),
size AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, size GROUP BY t, n),
imp AS (SELECT r, doc_id, tf.t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.t) * n) // l))) AS v FROM tf JOIN w ON w.t = tf.t JOIN d USING (r), size),
s AS (SELECT q, r, doc_id, CAST(sum(times * v) AS BIGINT) AS score FROM asked JOIN imp ON imp.t = asked.t GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s JOIN q USING (q) QUALIFY rank <= 20"""


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, generate_subscripts(q, 1) AS i, unnest(q) AS x FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM e a JOIN e b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""

def _op4_sql():
    known = ", ".join(f"('{s}', '{n}')" for n, many in licences.SENTENCES.items() for s in many)
    steps, before = [], "s0"
    for i, (name, need) in enumerate(licences.RULES, 1):
        pattern = "(.*?)".join(f"<{n}>" for n in need)
        kept = "".join(f"\\{j}" for j in range(1, len(need)))
        steps.append(f"s{i} AS (SELECT * REPLACE (CASE WHEN regexp_matches(left_, '{pattern}', 's') AND NOT list_contains(found, '{name}') "
                     f"THEN list_append(found, '{name}') ELSE found END AS found, regexp_replace(left_, '{pattern}', '{kept}', 'gs') AS left_) FROM {before})")
        before = f"s{i}"
    return rf"""
WITH known(sentence, name) AS (VALUES {known}), m AS (SELECT map(list(sentence), list(name)) AS m FROM known),
i AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n|[.!?;]+(\s|$)'),
  lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: map_contains(m, s)), lambda s: m[s]) AS ids FROM documents, m),
s0 AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS left_, CAST([] AS VARCHAR[]) AS found FROM i),
{', '.join(steps)}
SELECT doc_id, array_to_string(found, ',') AS licences, array_to_string(ids, ',') AS sentences,
  array_to_string(regexp_extract_all(left_, '<([a-z0-9]+)>', 1), ',') AS unknown,
  CASE WHEN len(found) > 1 THEN 'several' WHEN len(found) = 1 THEN 'one' WHEN left_ <> '' THEN 'unknown' ELSE 'none' END AS verdict
FROM {before}"""


OP5_SQL = r"""
WITH RECURSIVE rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
found AS (SELECT row_number() OVER () AS rid, page_id, url, html FROM pages),
tags AS (SELECT rid, unnest(regexp_extract_all(html, '(<(?:link|meta)[^>]*>)', 1, 'is')) AS t FROM found),
named AS (SELECT rid, CASE WHEN regexp_matches(t, '^<link', 'is') AND lower(regexp_extract(t, 'rel\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is')) = 'canonical'
    THEN regexp_extract(t, 'href\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is')
  WHEN regexp_matches(t, '^<meta', 'is') AND lower(regexp_extract(t, 'http-equiv\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is')) = 'refresh'
    THEN regexp_extract(t, 'url\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is') END AS url FROM tags),
u AS (SELECT rid, page_id, url, true AS page FROM found UNION ALL SELECT rid, NULL, url, false FROM named WHERE contains(url, '://')),
parts AS (SELECT *, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM u),
n AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') WHEN page THEN '#' || page_id END AS place,
  (SELECT max_by(struct_pack(rule := h || p, v := v), length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS r FROM parts),
link AS (SELECT DISTINCT a.place AS x, b.place AS y FROM n a JOIN n b USING (rid) WHERE a.page AND NOT b.page),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
near(x, y) AS (SELECT x, y FROM edge UNION SELECT near.x, edge.y FROM near JOIN edge ON near.y = edge.x),
said AS (SELECT near.x, bool_or(r.v = 'allow') AS ok, bool_or(r.v = 'block') AS bad FROM near JOIN n ON n.place = near.y WHERE r IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.v, CASE WHEN ok THEN 'allow' WHEN bad THEN 'block' END, 'allow') AS verdict
FROM n LEFT JOIN said ON said.x = n.place WHERE page"""

QUERIES = {
    "op1_tool_call_linking": (op1_tool_call_linking, None),
    "op3_mixing_temperature": (op3_mixing_temperature, None),
    "op4_licence_sentence_rules": (op4_licence_sentence_rules, _op4_sql()),
    "op5_url_redirect_classes": (op5_url_redirect_classes, OP5_SQL),
    "op2_token_ids_rans": (op2_token_ids_rans, None),
    "op6_decontamination_tiling": (op6_decontamination_tiling, None),
    "op7_near_duplicates_order_minhash": (op7_near_duplicates_order_minhash, None),
    "op8_toxicity_kneser_ney": (op8_toxicity_kneser_ney, None),
    "op9_quality_quadratic": (op9_quality_quadratic, None),
    "op10_topk_bitsliced": (op10_topk_bitsliced, OP10_SQL),
    "op11_substring_dedup_relative_lz": (op11_substring_dedup_relative_lz, OP11_SQL),
    "op12_phrases_direct_tiling": (op12_phrases_direct_tiling, OP12_SQL),
    "op13_ranked_search_intervals": (op13_ranked_search_intervals, OP13_SQL),
}
