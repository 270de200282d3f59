"""One query for each operator, with production parameters over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat, collocations, decontam, fingerprints, langid, lm, neardup, pieces, pii, toxicity, urls, warc
from .common import table

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


_HOST = "translate(coalesce(CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^([^/?#]*)', 1) END, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) END, '')"
URL_SQL = f"""
WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
f AS (SELECT u.*, ('.' || host) LIKE '%.com' AS c, ('.' || host) LIKE '%.example.com' AS e, ('.' || host) LIKE '%.www.example.com' AS w, ('.' || host) LIKE '%.net' AS n FROM u),
r AS (SELECT page_id, host, path, CASE
  WHEN w AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN e AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN n AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN n AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN c AND starts_with(path, '/') THEN 'com/' END AS rule FROM f)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r"""


@query("op3_url_filters", URL_SQL)
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.DEFAULT_RULES, urls.RULE_SCHEMA)
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def piece_model(name: str = PIECE_MODEL) -> str:
    """Path of the given model, which the machines of a cluster have installed like the library itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_documents(table(spark, sf_dir, "documents"), piece_model())


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, min(r.b) = n.doc_id AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""


@query("op9_minhash_neardup", NEAR_SQL)
def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), 4)


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_personal_data")
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


# A conversation that holds the template's own marks.
MARKED = "\\### Assistant: </turn> ok"
CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, 14 + length(regexp_replace(role, '[\\#<:]', '--', 'g')) + length(regexp_replace(text, '[\\#<]', '--', 'g')) AS chars,
  row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR pos = n) AS n_examples
FROM g GROUP BY conv_id"""


@query("op6_chat_prefix_targets", CHAT_SQL)
def op6_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(marked)))


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_masked_pseudo_likelihood")
def op8_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


# Occurrences of 1 to 4 words inside pieces, per lang; every cut of a candidate; those inside a longer one with 80 % of the count are left out.
COLLOCATION_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM p),
c AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])), ' ') AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
x AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (SELECT x.*, unnest(range(1, k)) AS cut FROM x),
s AS (SELECT u.lang, u.phrase, u.k, u.a, u.cut, y.a AS l, z.a AS r, CAST(CAST(2000000 AS HUGEINT) * u.a // (CAST(y.a AS HUGEINT) + z.a) AS BIGINT) AS score FROM u
  JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[1:u.cut], ' ') JOIN f z ON z.lang = u.lang AND z.phrase = array_to_string(u.w[u.cut + 1:], ' ')),
b AS (SELECT lang, phrase, any_value(k) AS k, any_value(a) AS a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM s GROUP BY lang, phrase),
i AS (SELECT lang, array_to_string(w[o:o + m - 1], ' ') AS phrase, max(a) AS outer_a FROM x, (SELECT unnest([1, 2, 3]) AS o), (SELECT unnest([2, 3]) AS m) WHERE m < k AND o + m - 1 <= k GROUP BY ALL),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.outer_a IS NULL OR 100 * i.outer_a < 80 * b.a)
SELECT t.lang, rank, phrase, a, l, r, c.n, score FROM t JOIN c ON c.lang = t.lang WHERE rank <= 2000"""


@query("op11_collocations", COLLOCATION_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


# Digests in base32: 32 characters of five bits, taken from eight groups of five hexadecimal digits.
WARC_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
r AS (SELECT *, row_number() OVER w AS pos, first_value(page_id) OVER w AS lead FROM p WINDOW w AS (PARTITION BY x ORDER BY page_id NULLS LAST, url))
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN pos = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN pos > 1 THEN lead END AS refers_to FROM r"""


@query("op12_warc", WARC_SQL)
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), piece_model(BYTE_MODEL), piece_model())
