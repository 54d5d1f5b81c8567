"""The registered queries of the operators: thin, on whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import decontam, extract, langid, lexical, media, neardup, packing, phrases, quality, secrets, storage, suffix, urls, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a lossless baseline JPEG, read back and hashed."""
    stored = media.with_media(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return media.media_features(stored, ["doc_id", "n_bytes"])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from labels that are not held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents outside every 200-byte string that occurs more than once."""
    return suffix.repeated_strings(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, written content-addressed and read back."""
    path = storage.new_path(spark, "archive")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    storage.drop_at_end(spark, path)
    return warc.parse_records(warc.read_archive(spark, path)).withColumnRenamed("record_id", "page_id")


def vocabulary(json_path: str | None = None, ranks_path: str | None = None) -> packing.Vocabulary:
    """The public byte-level vocabulary, as a tokenizer and as ranks."""
    return packing.Vocabulary.read(json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of at most 2048 tokens as vector best fit finds."""
    return packing.tokenize_and_pack(_table(spark, sf_dir, "documents"), vocabulary())


#: Of ``packing_capacities``: pieces of at most 1,024 tokens, and capacities of which each decides for some sequences.
BOUNDED = packing.Capacity(tokens=1536, documents=3, attention=1_150_000)
BOUNDED_PIECE = 1024


def packing_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences that are bounded in tokens, pieces and attention cost, by the weighted dot product."""
    cut = storage.written(packing.pieces(_table(spark, sf_dir, "documents"), vocabulary(), size=BOUNDED_PIECE), "pieces")
    return packing.pack(cut, capacity=BOUNDED, weights=(1.0, 1.0, 1.0), rule="dot")


#: Fixed rules.
URL_RULES = (
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules, then by its redirect and canonical aliases."""
    judged = urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in which a benchmark item is found, copied or reworded."""
    benchmark = _table(spark, sf_dir, "benchmark")
    return decontam.contaminated(_table(spark, sf_dir, "documents"), benchmark, answer="answer" if "answer" in benchmark.columns else None)


def op9_language(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = quality.held_out(F.col("doc_id"), 4, 2)
    pieces = langid.read_vocabulary(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    model = langid.fit(docs.where(~held_out), pieces)
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents over five-word shingles at a similarity of 0.75."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item, among all."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 strongest phrases among those that occur 100 times."""
    return phrases.collocations(_table(spark, sf_dir, "documents"), support=100, top=2000)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document, by patterns and by tests of randomness."""
    return secrets.scan(_table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES: dict[str, Query] = {
    "op1_media": op1_media,
    "op2_quality": op2_quality,
    "op3_main_text": op3_main_text,
    "op4_suffix": op4_suffix,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "packing_capacities": packing_capacities,
    "op7_decontam": op7_decontam,
    "op8_urls": op8_urls,
    "op9_language": op9_language,
    "op10_neardup": op10_neardup,
    "op11_search": op11_search,
    "op12_phrases": op12_phrases,
    "op13_secrets": op13_secrets,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p),
b AS (
  SELECT page_id, payload_bytes, last,
    list_reduce(list_transform(range(8), lambda i: list_reduce(list_transform(range(4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT >> (15 - 5 * j)) & 31 AS INTEGER), 1)), lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest
  FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM b
"""

#: Links are read where they name an absolute URL; relative ones do not occur in the tables.
ORACLE_SQL["op8_urls"] = r"""
WITH RECURSIVE
rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
links AS (
  SELECT url AS u, regexp_extract(tag, '(?is)href\s*=\s*["'']?([^"''\s>]+)', 1) AS v FROM tags WHERE regexp_matches(tag, '(?is)rel\s*=\s*["'']?canonical')
  UNION ALL
  SELECT url, regexp_extract(tag, '(?is)url\s*=\s*([^"''\s;>]+)', 1) FROM tags WHERE regexp_matches(tag, '(?is)http-equiv\s*=\s*["'']?refresh')),
edges AS (SELECT u, v FROM links WHERE v LIKE '%://%' UNION SELECT v, u FROM links WHERE v LIKE '%://%'),
nodes AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT v FROM edges),
parts AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM nodes),
judged AS (
  SELECT p.url, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY ALL),
reached(url) AS (SELECT url FROM judged WHERE verdict = 'block' UNION SELECT e.v FROM reached x JOIN edges e ON e.u = x.url)
SELECT p.page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, j.rule,
  coalesce(j.verdict, CASE WHEN p.url IN (SELECT url FROM reached) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN judged j ON p.url = j.url
"""

#: Every window of 200 bytes, as 400 hexadecimal digits.
ORACLE_SQL["op4_suffix"] = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 199)) AS i FROM t WHERE length(h) >= 400)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
m AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS fresh FROM c),
s AS (SELECT doc_id, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM s GROUP BY ALL),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS begin_at, a AS end_at FROM spans
  UNION ALL SELECT t.doc_id, coalesce(max(b), 0), any_value(length(h) // 2) FROM t LEFT JOIN spans USING (doc_id) GROUP BY t.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * begin_at + 1, 2 * (end_at - begin_at)), '' ORDER BY begin_at) AS k FROM gaps JOIN t USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM t JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

#: Shingles as texts; components by walking all links.
ORACLE_SQL["op10_neardup"] = r"""
WITH RECURSIVE
t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(doc_id, goal) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.goal),
m AS (SELECT doc_id, min(goal) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: Every document scored for every item.
ORACLE_SQL["op11_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
k AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
f AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, k GROUP BY term, n_docs),
s AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term), k GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""

#: Every phrase of up to five words counted.
ORACLE_SQL["op12_phrases"] = r"""
WITH p AS (SELECT row_number() OVER () AS p, lang, w FROM (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)) WHERE len(w) > 0),
t AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM t, range(1, 6) x(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM g WHERE k > 1),
longer AS (SELECT lang, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase, a FROM c WHERE k > 2),
kept AS (SELECT * FROM c ANTI JOIN longer USING (lang, phrase, a)),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS j FROM kept),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, x.f AS l, y.f AS r, n.n, CAST((1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN n ON n.lang = cuts.lang JOIN g x ON x.lang = cuts.lang JOIN g y ON y.lang = cuts.lang WHERE x.k = j AND x.phrase = array_to_string(w[1:j], ' ') AND y.k = cuts.k - j AND y.phrase = array_to_string(w[j + 1:cuts.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
"""


def _either_case(pattern: str) -> str:
    """Letters of the keywords in either case, of ASCII only."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in pattern)


def _secrets_sql() -> str:
    """All matches placed by window sums, all tokens tested, and the step-up rule over sorted steps."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    assign = _either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    listed = lambda values: "[" + ", ".join(map(quoted, values)) + "]"
    encoding = "CASE " + " ".join(f"WHEN regexp_matches(v, {quoted(e[1])}) THEN {i}" for i, e in enumerate(secrets.ENCODINGS)) + " END"
    patterns = map(quoted, (assign, "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_-]{20,}"))
    found = " UNION ALL ".join(f"SELECT r, {kind} AS kind, regexp_extract_all(x, {p}) AS v, string_split_regex(x, {p}) AS g FROM t" for kind, p in enumerate(patterns))
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
found AS ({found}),
single AS (SELECT r, kind, unnest(v) AS v, unnest(g[1:len(v)]) AS g, unnest(range(len(v))) AS i FROM found),
placed AS (SELECT r, kind, v, CAST(sum(length(g) + length(v)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS e FROM single),
spans AS (SELECT *, e - length(v) AS s FROM placed WHERE CASE kind WHEN 0 THEN length(regexp_extract(v, {quoted(assign)}, 2)) >= 6 WHEN 1 THEN length(v) >= 20 WHEN 2 THEN length(v) >= 24 ELSE regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') END),
base AS (SELECT * FROM spans WHERE kind < 3),
tokens AS (SELECT *, {encoding} AS code, length(v)::DOUBLE AS n FROM spans t WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = t.r AND b.s < t.e AND t.s < b.e)),
coded AS (SELECT *, {listed(e[2] for e in secrets.ENCODINGS)}[code + 1] AS alphabet, {listed("L" * (len(e[2]) // 2) + "H" * (len(e[2]) // 2) for e in secrets.ENCODINGS)}[code + 1] AS sides FROM tokens),
sized AS (SELECT *, length(alphabet)::DOUBLE AS k, translate(v, alphabet, sides) AS half, list_transform(string_split(v, ''), lambda c: instr(alphabet, c) - (length(alphabet) + 1) / 2.0) AS p FROM coded),
tested AS (
  SELECT *, (k / n * list_sum(list_transform(string_split(alphabet, ''), lambda c: pow(n - length(replace(v, c, '')), 2))) - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS chi,
    (n - (length(replace(half, 'LH', '')) + length(replace(half, 'HL', ''))) / 2.0 - (n - 1) / 2) / sqrt((n - 1) / 4) AS runs,
    list_sum(list_transform(range(1, length(v)), lambda i: CASE WHEN i % 4096 = 0 THEN 0 ELSE p[i] * p[i + 1] END)) / (sqrt(n - 1 - (length(v) - 1) // 4096) * (k * k - 1) / 12) AS serial FROM sized),
z AS (SELECT *, greatest(abs(chi), abs(runs), abs(serial)) AS z FROM tested),
stepped AS (
  SELECT r, s, e, code * 100 + CAST(floor(log2(n)) AS INTEGER) AS class,
    least(greatest(floor(((z * z / 2 + ln(sqrt(2 * pi()) / 2) + ln(z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65)))))) / ln(10) - log10(3)) * 100), 0), 4000) AS step FROM z),
counts AS (SELECT class, step, count(*) AS n FROM stepped GROUP BY ALL),
rule AS (SELECT class, step, pow(10.0, -step / 100.0) * sum(n) OVER (PARTITION BY class) AS expected, sum(n) OVER (PARTITION BY class ORDER BY step DESC) AS rank FROM counts),
bounds AS (SELECT class, min(step) AS least FROM rule WHERE expected <= 0.05 * rank GROUP BY class),
every AS (SELECT r, kind, s, e FROM base UNION ALL SELECT r, 3, s, e FROM stepped LEFT JOIN bounds USING (class) WHERE least IS NULL OR step < least),
named AS (SELECT r, kind, s, {listed(secrets.KINDS)}[kind + 1] || ':' || s || ':' || e AS said FROM every),
summed AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(said, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY s, kind) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN summed USING (r)
"""


ORACLE_SQL["op13_secrets"] = _secrets_sql()
