"""Queries over whole chains: chunks with provenance, staged retrieval, reports and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.functions import rules as Q
from citewright.functions import text as T
from citewright.operators import chunking as K
from citewright.operators import corpus as C
from citewright.operators import evaluation as E
from citewright.operators import pipeline as P
from citewright.operators import reports as R
from citewright.operators import retrieval as S
from citewright.plans.corpus import PACK_SQL, halves_sql, pack_sql
from citewright.plans.retrieval import _GRAMS, _MEASURES, _METRICS, _QRELS, _TF, _bm25_sql, _metrics, _top_sql, docs, items, qrels, query, table

# --- documents as articles: a line is a clause, the first one stands before them ---

MOST = 120
_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x != '')"
_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x != ''))"
_UNITS = f"""l AS (SELECT doc_id, i, ls[i + 1] AS line FROM (SELECT doc_id, {_LINES} AS ls, unnest(range(len({_LINES}))) AS i FROM documents)),
a AS (SELECT *, doc_id % 13 = 0 AND i % 2 = 1 AS repealed, {_WORDS.format('line')} AS n FROM l), u AS (SELECT * FROM a WHERE NOT repealed)"""


def units(spark, sf_dir) -> DataFrame:
    """Every line of a document as a unit; some are repealed, some amended."""
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "text"))
    amended = F.col("doc_id") % 7 == 0
    return rows.select(
        F.lit("Corpus").alias("doc_id"), F.col("i").alias("pos"), F.col("doc_id").cast("string").alias("article"), F.lit("Document").alias("article_title"), F.when(F.col("i") > 0, F.col("i").cast("string")).alias("clause"),
        F.lit(None).cast("string").alias("point"), "text", F.when((F.col("doc_id") % 13 == 0) & (F.col("i") % 2 == 1), "repealed").otherwise("active").alias("status"),
        F.when(amended, F.array(F.concat(F.lit("op"), (F.col("i") % 3).cast("string")))).alias("amended_by"), F.when(amended, F.date_add(F.lit("2024-01-01").cast("date"), F.col("i") % 400)).alias("effective_from"),
    )


def chunks(spark, sf_dir) -> DataFrame:
    sources = spark.createDataFrame([("Corpus", "https://example.org/corpus", "2024-05-01", "A;B")], "doc_id string, url string, accessed_at string, affected_by string")
    op_docs = spark.createDataFrame([("op0", "Second"), ("op1", "First")], "op string, amending_doc string")
    return K.build_chunks(units(spark, sf_dir), sources, op_docs, MOST, title=lambda c: c)


_HEAD = "'Corpus | Điều ' || doc_id || '. Document'"
_CHUNKS = f"""{_UNITS},
g AS (SELECT doc_id, sum(n) AS total, count(*) FILTER (i > 0) AS clauses, string_agg(line, chr(10) ORDER BY i) AS body, min(i) FILTER (i > 0) AS first, max(line) FILTER (i = 0) AS intro FROM u GROUP BY 1),
whole AS (SELECT 'D' || doc_id AS key, doc_id, {_HEAD} AS header, body FROM g WHERE 5 + total <= {MOST}),
c AS (SELECT u.doc_id, u.i, line, i = first AND intro IS NOT NULL AS led, intro, CASE WHEN i = first AND intro IS NOT NULL THEN intro || chr(10) || line ELSE line END AS body FROM u JOIN g USING (doc_id) WHERE i > 0 AND 5 + total > {MOST}),
cn AS (SELECT *, {_WORDS.format('body')} AS n, {_HEAD} || ' | Khoản ' || i AS header, led AND regexp_matches(line, '^[a-zđ]\\)\\s+') AS two FROM c),
one AS (SELECT 'D' || doc_id || '__K' || i AS key, doc_id, header, body FROM cn WHERE 8 + n <= {MOST}),
fl AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(intro, '([.;:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x != '') AS ss FROM g WHERE 5 + total > {MOST} AND clauses = 0),
pieces AS (SELECT 'D' || doc_id AS key, k, ss[k] AS piece, {MOST - 5} AS room FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS k FROM fl)
UNION ALL SELECT 'D' || doc_id || '__K' || i, 1, CASE WHEN two THEN intro ELSE body END, {MOST - 10} FROM cn WHERE 8 + n > {MOST}
UNION ALL SELECT 'D' || doc_id || '__K' || i, 2, line, {MOST - 10} FROM cn WHERE 8 + n > {MOST} AND two),
{halves_sql('pieces')}, {pack_sql('e')},
parts AS (SELECT key, part, CASE WHEN contains(key, '__K') THEN string_agg(text, chr(10) ORDER BY idx) ELSE string_agg(text, ' ' ORDER BY idx) END AS body FROM r GROUP BY key, part),
k AS (SELECT key, doc_id, header, body FROM whole UNION ALL SELECT * FROM one
UNION ALL SELECT parts.key || '__P' || part, doc_id, {_HEAD}, body FROM parts JOIN fl ON parts.key = 'D' || fl.doc_id
UNION ALL SELECT parts.key || '__P' || part, doc_id, header || ' (phần ' || part || ')', parts.body FROM parts JOIN cn ON parts.key = 'D' || cn.doc_id || '__K' || cn.i),
ck AS (SELECT 'Corpus__' || key AS chunk_id, doc_id, header || chr(10) || body AS chunk_text, body FROM k)"""


@query(
    f"""WITH {'RECURSIVE'} {_CHUNKS},
m AS (SELECT doc_id, list_sort(list_distinct(list(CASE i % 3 WHEN 0 THEN 'Second' WHEN 1 THEN 'First' ELSE 'op2' END))) AS am, max(DATE '2024-01-01' + CAST(i % 400 AS INTEGER)) AS eff FROM u WHERE doc_id % 7 = 0 GROUP BY 1)
SELECT chunk_id, {_WORDS.format('chunk_text')} AS n_tokens, sha256(chunk_text) AS text_sha256, coalesce(array_to_string(am, ','), '') AS amended_by, CAST(eff AS VARCHAR) AS effective_from FROM ck LEFT JOIN m USING (doc_id)"""
)
def build_chunks(spark, sf_dir):
    """Documents cut into chunks of at most 120 words by article, clause and sentence, with what amended them."""
    rows = chunks(spark, sf_dir)
    return rows.select("chunk_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.sha2("chunk_text", 256).alias("text_sha256"), F.array_join("amended_by", ",").alias("amended_by"), F.col("effective_from").cast("string").alias("effective_from"))


@query(
    f"""WITH RECURSIVE {_CHUNKS} SELECT 'Corpus' AS doc_id, CASE WHEN regexp_matches(chunk_id, '__K.*__P') THEN 'part of a clause' WHEN contains(chunk_id, '__P') THEN 'part of an article' WHEN contains(chunk_id, '__K') THEN 'clause' ELSE 'article' END AS kind, count(*) AS count FROM ck GROUP BY 2"""
)
def chunk_kinds(spark, sf_dir):
    return R.chunk_kinds(chunks(spark, sf_dir))


@query(
    f"""WITH {_UNITS} SELECT CAST(doc_id AS VARCHAR) AS article, count(*) FILTER (i > 0) AS n_clauses, sha256(string_agg(line, chr(10) ORDER BY i)) AS text_sha256, CASE WHEN doc_id % 7 = 0 THEN count(*) ELSE 0 END AS n_amended,
CAST(sum(CAST(repealed AS INT)) AS BIGINT) AS n_repealed, CAST(sum(n) AS BIGINT) AS n_words FROM a GROUP BY doc_id"""
)
def article_table(spark, sf_dir):
    rows = R.article_table(units(spark, sf_dir))
    return rows.select("article", "n_clauses", F.sha2("text", 256).alias("text_sha256"), "n_amended", "n_repealed", "n_words")


@query(f"WITH RECURSIVE {PACK_SQL} SELECT chunk_id, part, n_parts, n_tokens, chunk_text FROM pk")
def chunk_pack(spark, sf_dir):
    """Documents cut into chunks of at most 200 words: whole sentences where they fit."""
    rows = C.chunk_texts(docs(spark, sf_dir))
    return rows.select("chunk_id", *[F.col(c).cast("bigint").alias(c) for c in ("part", "n_parts", "n_tokens")], "chunk_text")


@query(
    f"""WITH RECURSIVE {PACK_SQL} SELECT 'repeated text' AS rule, chunk_id FROM pk WHERE chunk_text IN (SELECT chunk_text FROM pk GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'repeated id', chunk_id FROM pk WHERE chunk_id IN (SELECT chunk_id FROM pk GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'empty', chunk_id FROM pk WHERE trim(chunk_text) = '' UNION ALL SELECT 'too long', chunk_id FROM pk WHERE n_tokens > 200"""
)
def check_chunks(spark, sf_dir):
    """Chunks that are empty or too long, or repeat an id or a text."""
    return C.check_chunks(C.chunk_texts(docs(spark, sf_dir)))


# --- turns as questions, conversations as their groups ---

_TYPE = "CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 300 THEN 'middle' ELSE 'long' END"
_QUESTIONS = f"qs AS (SELECT conv_id * 1000 + turn AS query_id, conv_id AS group_id, {_TYPE} AS type, text AS question FROM conversations WHERE role = 'user'), gh AS (SELECT group_id, arg_min(type, query_id) AS kind, count(*) AS n_questions FROM qs GROUP BY 1)"
_SPLIT = """sn AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('42:' || group_id), group_id) AS nth, count(*) OVER (PARTITION BY kind) AS n FROM gh),
sf AS (SELECT *, floor(n * 0.4) AS a, floor(n * 0.2) AS b, floor(n * 0.4) AS c FROM sn), sr AS (SELECT *, n - a - b - c AS rest, n * 0.4 - a AS pa, n * 0.2 - b AS pb, n * 0.4 - c AS pc FROM sf),
so AS (SELECT *, a + CASE WHEN CAST(pb > pa AS INT) + CAST(pc > pa AS INT) < rest THEN 1 ELSE 0 END AS x, b + CASE WHEN CAST(pa >= pb AS INT) + CAST(pc > pb AS INT) < rest THEN 1 ELSE 0 END AS y FROM sr),
sp AS (SELECT group_id, kind, n_questions, CASE WHEN nth <= x THEN 'train' WHEN nth <= x + y THEN 'validation' ELSE 'test' END AS split FROM so)"""


def questions(spark, sf_dir) -> DataFrame:
    kind = F.when(F.length("text") < 100, "short").when(F.length("text") < 300, "middle").otherwise("long")
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("conv_id").alias("group_id"), kind.alias("type"), F.col("text").alias("question"))


def splits(spark, sf_dir) -> DataFrame:
    return C.group_split(R.group_headers(questions(spark, sf_dir)))


@query(
    f"""WITH {_QUESTIONS}, {_SPLIT} SELECT coalesce(kind, 'all') AS kind, {', '.join(f"count(*) FILTER (split = '{s}') AS {s}_groups, CAST(coalesce(sum(n_questions) FILTER (split = '{s}'), 0) AS BIGINT) AS {s}_questions" for s in ('train', 'validation', 'test'))} FROM sp GROUP BY ROLLUP (kind)"""
)
def split_sizing(spark, sf_dir):
    return R.split_sizing(splits(spark, sf_dir))


@query(
    f"""WITH {_QUESTIONS}, {_SPLIT}, j AS (SELECT qs.*, split FROM qs LEFT JOIN sp USING (group_id))
SELECT 'total' AS what, 'questions' AS name, count(*) AS count FROM j UNION ALL SELECT 'total', 'groups', count(DISTINCT group_id) FROM j UNION ALL SELECT 'questions by type', type, count(*) FROM j GROUP BY 2
UNION ALL SELECT 'groups by split', split, count(DISTINCT group_id) FROM j GROUP BY 2 UNION ALL SELECT 'questions by split', split, count(*) FROM j GROUP BY 2"""
)
def manifest_counts(spark, sf_dir):
    return R.manifest_counts(questions(spark, sf_dir), splits(spark, sf_dir))


@query(f"WITH {_QUESTIONS}, {_SPLIT} SELECT query_id, group_id, split FROM qs JOIN sp USING (group_id) WHERE split != 'test' AND type != 'long' AND trim(question) != ''")
def question_bank(spark, sf_dir):
    """Questions that suggestions may come from: not of the test split, and of an answerable type."""
    return P.question_bank(questions(spark, sf_dir), splits(spark, sf_dir), unanswerable=("long",)).select("query_id", "group_id", "split")


_STOP = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + "]"
_BARE = "replace(strip_accents(lower(coalesce({0}, ''))), 'đ', 'd')"
_CONTENT = rf"""CASE WHEN {_BARE.format('question')} != lower(question) THEN list_transform(list_filter(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+'), lambda w: NOT list_contains({_STOP(Q.STOPWORDS)}, w) AND NOT regexp_matches(w, '^[0-9]+$') AND length(w) > 1), lambda w: {_BARE.format('w')})
ELSE list_filter(regexp_extract_all({_BARE.format('question')}, '[\p{{L}}\p{{N}}_]+'), lambda w: NOT list_contains({_STOP({Q.plain(w) for w in Q.STOPWORDS} - set(Q.PLAIN_EXCEPTIONS))}, w) AND NOT regexp_matches(w, '^[0-9]+$') AND length(w) > 1) END"""


@query(
    rf"""WITH {_QUESTIONS}, {_SPLIT}, w AS (SELECT query_id, group_id, type, split, list_distinct(regexp_extract_all({_BARE.format('question')}, '[\p{{L}}\p{{N}}_]+')) AS w, {_CONTENT} AS c, trim({_BARE.format('question')}, ' ?') AS t FROM qs JOIN sp USING (group_id)),
p AS (SELECT a.query_id, b.query_id AS doc_id, b.group_id AS g, 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) AS score, len(list_intersect(a.c, b.c)) AS shared
FROM w a, w b WHERE a.query_id % 50 = 0 AND b.split != 'test' AND b.type != 'long' AND a.group_id != b.group_id AND a.t != b.t AND len(list_intersect(a.w, b.w)) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY round(score, 6) DESC, doc_id) AS n FROM p WHERE round(score, 6) >= 0.05),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM o WHERE n = 1 QUALIFY r <= 9)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank, round(score, 4) AS score, shared FROM x WHERE shared >= 2 QUALIFY rank <= 3"""
)
def similar_by_words(spark, sf_dir):
    """For every 50th question, similar ones of the bank that share at least two content words."""
    bank = P.question_bank(questions(spark, sf_dir), splits(spark, sf_dir), unanswerable=("long",))
    out = P.similar_by_words(questions(spark, sf_dir).filter("query_id % 50 = 0"), bank, 3, 0.05)
    return out.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 4).alias("score"), F.col("shared").cast("bigint").alias("shared"))


@query("SELECT conv_id * 1000 + turn AS query_id, 'query: ' || text AS input FROM conversations WHERE role = 'user' AND regexp_full_match(text, '[^ \\s]+( [^ \\s]+)*') AND NOT regexp_matches(text, '\\s[,.;:!?)]|^\\s*[•●▪◦·–—*+-]|[\\x00-\\x1f\\x7f]')")
def model_input(spark, sf_dir):
    """What an encoder of questions is given, for the turns that cleaning leaves as they are."""
    turns = questions(spark, sf_dir).filter(F.col("question").rlike(r"^[^ \s]+( [^ \s]+)*$") & ~F.col("question").rlike(r"\s[,.;:!?)]|^\s*[•●▪◦·–—*+-]|[\x00-\x1f\x7f]"))
    return P.model_input(turns.select("query_id", "question"), "query: ").select("query_id", "input")


# --- labels as raters' judgements ---

_AGREE = """x AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'answerable' WHEN doc_id % 2 > 0 THEN 'answerable' ELSE 'no_answer' END AS x, CASE WHEN doc_id % 4 != 0 THEN CAST(toxic = 0 AS DOUBLE) END AS ax,
CASE WHEN quality > 0 THEN 'answerable' ELSE 'no_answer' END AS y, CAST(quality = 1 AS DOUBLE) AS ay FROM labels)"""


@query(
    f"""WITH {_AGREE}, n AS (SELECT count(*) AS n, avg(CAST(x = y AS DOUBLE)) AS po, count(*) FILTER (x = 'answerable') / count(*) AS px, count(*) FILTER (y = 'answerable') / count(*) AS py, avg(ax) AS agree_first, avg(ay) AS agree_second, count(*) FILTER (x != y) AS n_differ FROM x)
SELECT n, round((po - (px * py + (1 - px) * (1 - py))) / (1 - (px * py + (1 - px) * (1 - py))), 6) AS kappa, round(agree_first, 6) AS agree_first, round(agree_second, 6) AS agree_second, n_differ FROM n"""
)
def agreement(spark, sf_dir):
    """Two raters made from the labels: kappa of their verdicts and how often they accept the type."""
    l = table(spark, sf_dir, "labels")  # noqa: E741
    first = l.select(F.col("doc_id").alias("query_id"), F.when(F.col("quality") == 1, "answerable").alias("verdict"), F.when(F.col("doc_id") % 4 != 0, F.when(F.col("toxic") == 0, "yes").otherwise("no")).alias("type_agree"), (F.col("doc_id") % 2).alias("n_labels"))
    second = l.select(F.col("doc_id").alias("query_id"), F.lit(None).cast("string").alias("verdict"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("type_agree"), F.col("quality").alias("n_labels"))
    out = R.agreement(first, second, l.select(F.col("doc_id").alias("query_id")))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("kappa", "agree_first", "agree_second")], "n_differ")


@query(
    """WITH p AS (SELECT quality + CAST(doc_id % 2 AS INT) AS x, (1 - toxic) + CAST(doc_id // 2 % 2 AS INT) AS y FROM labels), n AS (SELECT count(*) AS n, avg(CAST((x > 0) = (y > 0) AS DOUBLE)) AS po, avg(CAST(x > 0 AS DOUBLE)) AS px, avg(CAST(y > 0 AS DOUBLE)) AS py, avg(1 - abs(x - y) / 2.0) AS wo, count(*) FILTER (x != y) AS n_differ FROM p),
m AS (SELECT avg(1 - abs(a.x - b.y) / 2.0) AS we FROM p a, p b), k AS (SELECT n, (po - (px * py + (1 - px) * (1 - py))) / (1 - (px * py + (1 - px) * (1 - py))) AS kappa, (wo - we) / (1 - we) AS kappa_weighted, n_differ FROM n, m)
SELECT n, round(kappa, 6) AS kappa, round(kappa_weighted, 6) AS kappa_weighted, n_differ, kappa < 0.6 AS review FROM k"""
)
def kappa_report(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("doc_id") % 2).alias("x"), (1 - F.col("toxic") + F.expr("doc_id div 2") % 2).alias("y"))
    return R.kappa_report(rows).select("n", F.round("kappa", 6).alias("kappa"), F.round("kappa_weighted", 6).alias("kappa_weighted"), "n_differ", "review")


# --- what keeps the data from being frozen ---

_TYPES = ("short", "middle", "long", "none")
_FREEZE = f"""{_QUESTIONS}, {_SPLIT}, fs AS (SELECT group_id, split FROM sp WHERE group_id % 17 != 0 UNION ALL SELECT group_id, 'extra' FROM sp WHERE group_id % 19 = 0),
fq AS (SELECT doc_id % 97 * 1000 AS query_id, CAST(doc_id * 2 AS VARCHAR) AS chunk_id, quality + toxic AS relevance FROM labels), fd AS (SELECT DISTINCT source FROM documents),
ft AS (SELECT unnest(['short', 'middle', 'long', 'none']) AS type), fw AS (SELECT type, unnest(['train', 'validation', 'test']) AS split FROM ft), fj AS (SELECT DISTINCT type, split FROM qs LEFT JOIN fs USING (group_id))"""


@query(
    f"""WITH {_FREEZE}
SELECT 'error' AS severity, 'source without url, date or status' AS rule, source AS key FROM fd WHERE length(source) % 2 = 0
UNION SELECT 'error', 'empty chunk', CAST(doc_id AS VARCHAR) FROM documents WHERE trim(coalesce(text, ''), ' ') = ''
UNION SELECT 'error', 'type without question', type FROM ft WHERE type NOT IN (SELECT type FROM qs)
UNION SELECT 'warning', 'repeated text', lower(trim(question, ' ')) FROM qs GROUP BY 3 HAVING count(*) > 1
UNION SELECT 'error', 'label of no question', CAST(query_id AS VARCHAR) FROM fq WHERE query_id NOT IN (SELECT query_id FROM qs)
UNION SELECT 'error', 'label of no chunk', query_id || ' ' || chunk_id FROM fq WHERE CAST(chunk_id AS BIGINT) NOT IN (SELECT doc_id FROM documents)
UNION SELECT 'error', 'relevance other than 1 or 2', query_id || ' ' || chunk_id FROM fq WHERE relevance NOT IN (1, 2)
UNION SELECT 'error', 'label of an unanswerable question', CAST(query_id AS VARCHAR) FROM qs WHERE type = 'long' AND query_id IN (SELECT query_id FROM fq)
UNION SELECT 'error', 'question without label', CAST(query_id AS VARCHAR) FROM qs WHERE type != 'long' AND query_id NOT IN (SELECT query_id FROM fq)
UNION SELECT 'error', 'repeated label', query_id || ' ' || chunk_id FROM fq GROUP BY query_id, chunk_id HAVING count(*) > 1
UNION SELECT 'error', 'group in several splits', CAST(group_id AS VARCHAR) FROM fs GROUP BY group_id HAVING count(DISTINCT split) > 1
UNION SELECT 'error', 'group in no split', CAST(group_id AS VARCHAR) FROM qs WHERE group_id NOT IN (SELECT group_id FROM fs)
UNION SELECT 'warning', 'type missing from a split', split || ' ' || type FROM fw WHERE NOT EXISTS (SELECT 1 FROM fj WHERE fj.type = fw.type AND fj.split = fw.split)
UNION SELECT 'warning', 'generated question', CAST(query_id AS VARCHAR) FROM qs WHERE query_id % 11 = 0"""
)
def freeze_checks(spark, sf_dir):
    """All rules over tables that break most of them."""
    d, l, s = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), splits(spark, sf_dir)  # noqa: E741
    asked = questions(spark, sf_dir).withColumn("source", F.when(F.col("query_id") % 11 == 0, "generated").otherwise("people"))
    rel = l.select((F.col("doc_id") % 97 * 1000).alias("query_id"), (F.col("doc_id") * 2).cast("string").alias("chunk_id"), (F.col("quality") + F.col("toxic")).alias("relevance"))
    sources = d.select("source").distinct().select(F.col("source").alias("doc_id"), F.col("source").alias("url"), F.when(F.length("source") % 2 == 1, "2024").alias("accessed_at"), F.lit("in force").alias("status"))
    of = s.select("group_id", "split").filter("group_id % 17 != 0").unionByName(s.filter("group_id % 19 = 0").select("group_id", F.lit("extra").alias("split")))
    return R.freeze_checks(d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("chunk_text")), asked, rel, sources, of, _TYPES, ("long",))


# --- retrieval in stages; TF-IDF cosine stands for a dense index, Dice for a scorer of pairs ---


def _routed_sql(name: str = "ro", k1: float = 1.5, b: float = 0.9) -> str:
    """BM25 of items with accents over the texts, of the others over the stripped texts."""
    out = []
    for p, doc, item, where in (("ra", "lower(coalesce(text, ''))", "lower(coalesce(text, ''))", "!="), ("rb", _BARE.format("text"), _BARE.format("text"), "=")):
        tok = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+')"
        out.append(
            f"""{p}d AS (SELECT doc_id, {tok.format(doc)} AS w FROM documents), {p}t AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM {p}d) GROUP BY ALL), {p}f AS (SELECT term, count(*) AS df FROM {p}t GROUP BY 1),
{p}s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM {p}d), {p}q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tok.format(item)}) AS term FROM benchmark WHERE {_BARE.format('text')} {where} lower(text)) GROUP BY ALL),
{p} AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * dl / a))) AS score FROM {p}q JOIN {p}t USING (term) JOIN {p}f USING (term), {p}s GROUP BY ALL)"""
        )
    return ", ".join([*out, f"{name} AS (SELECT * FROM ra UNION ALL SELECT * FROM rb)"])


def _dice(a, b):
    return T.dice(T.tokens(a), T.tokens(b))


_TOKENS = r"list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'))"
_HYBRID = """z AS (SELECT item_id AS query_id, doc_id FROM benchmark, documents), hf AS (SELECT z.query_id, z.doc_id, coalesce(ti.score, 0) AS x, coalesce(ro.score, 0) AS y FROM z LEFT JOIN ti USING (query_id, doc_id) LEFT JOIN ro USING (query_id, doc_id)),
hm AS (SELECT *, min(x) OVER q AS xl, max(x) OVER q AS xh, min(y) OVER q AS yl, max(y) OVER q AS yh FROM hf WINDOW q AS (PARTITION BY query_id)),
hy AS (SELECT query_id, doc_id, 0.9 * CASE WHEN xh - xl < 1e-12 THEN 0 ELSE (x - xl) / (xh - xl) END + (1 - 0.9) * CASE WHEN yh - yl < 1e-12 THEN 0 ELSE (y - yl) / (yh - yl) END AS score FROM hm)"""


def _pool_sql(extra: int, p: str = "") -> str:
    """The hybrid's best twenty and, of the routed BM25's best, those that it lacks, with their Dice."""
    return f"""{p}t1 AS (SELECT query_id, doc_id, score, rank AS place FROM {_top_sql('(SELECT * FROM hy WHERE score > 0)', 20)}),
{p}e1 AS (SELECT query_id, doc_id, 20 + rank AS place FROM {_top_sql('ro', max(extra, 1))} b WHERE {extra} > 0 AND NOT EXISTS (SELECT 1 FROM {p}t1 t WHERE t.query_id = b.query_id AND t.doc_id = b.doc_id)),
{p}c AS (SELECT * FROM {p}t1 UNION ALL BY NAME SELECT e.query_id, e.doc_id, coalesce(hy.score, 0) AS score, e.place FROM {p}e1 e LEFT JOIN hy USING (query_id, doc_id)),
{p}x AS (SELECT c.*, CASE WHEN len(qw) = 0 OR len(dw) = 0 THEN 0 ELSE 2.0 * len(list_intersect(qw, dw)) / (len(qw) + len(dw)) END AS ce FROM {p}c c JOIN (SELECT item_id AS query_id, {_TOKENS} AS qw FROM benchmark) k USING (query_id) JOIN (SELECT doc_id, {_TOKENS} AS dw FROM documents) l USING (doc_id))"""


def _stage(name: str, source: str, k: int = 5) -> str:
    return f"SELECT '{name}' AS stage, query_id, doc_id, rank, round(score, 4) AS score FROM {_top_sql(source, k)}"


_ZEROS = "(SELECT z.query_id, z.doc_id, coalesce(s.score, 0) AS score FROM z LEFT JOIN {} s USING (query_id, doc_id))"


@query(f"WITH {_routed_sql()} SELECT query_id, doc_id, rank, round(score, 4) AS score FROM {_top_sql('ro', 10)}")
def routed_bm25(spark, sf_dir):
    top = S.top_k(P.routed_bm25(docs(spark, sf_dir), items(spark, sf_dir)), 10)
    return top.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 4).alias("score"))


@query(
    f"""WITH {_TF}, {_bm25_sql()}, {_GRAMS}, {_routed_sql()}, {_HYBRID}, {_pool_sql(5)}, rk AS (SELECT query_id, doc_id, ce AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(ce, 6) DESC, place) AS rank FROM x)
{_stage('bm25_raw', _ZEROS.format('bm'))} UNION ALL {_stage('bm25', _ZEROS.format('ro'))} UNION ALL {_stage('dense', _ZEROS.format('ti'))} UNION ALL {_stage('hybrid', 'hy')}
UNION ALL SELECT 'rerank', query_id, doc_id, rank, round(score, 4) FROM rk WHERE rank <= 5"""
)
def retrieve_stages(spark, sf_dir):
    """The five best of every stage of one frozen spec."""
    runs = P.stage_runs(docs(spark, sf_dir), items(spark, sf_dir), P.Spec(), k=5, dense=S.tfidf, score=_dice)
    return runs.select("stage", "query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 4).alias("score"))


_EXTRAS, _BLENDS = (0, 5), (0.0, 0.4)
_SETTINGS = [(i, e, b) for i, (e, b) in enumerate((e, b) for e in _EXTRAS for b in _BLENDS)]


def _reranked_sql(place: int, extra: int, blend: float) -> str:
    return f"""rw{place} AS (SELECT query_id, doc_id, place, {blend} * CASE WHEN max(score) OVER q - min(score) OVER q < 1e-12 THEN 0 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END + (1 - {blend}) * ce AS f FROM p{extra}x WINDOW q AS (PARTITION BY query_id)),
rv{place} AS (SELECT {place} AS place, {extra} AS extra_bm25, {blend} AS blend, query_id, coalesce(1.0 / min(CASE WHEN qr.doc_id IS NOT NULL THEN rank END), 0) AS rr FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 6) DESC, place) AS rank FROM rw{place}) r LEFT JOIN qr USING (query_id, doc_id) WHERE query_id IN (SELECT query_id FROM qr) GROUP BY query_id)"""


@query(
    f"""WITH {_GRAMS}, {_routed_sql()}, {_HYBRID}, {_QRELS}, {', '.join(_pool_sql(e, f'p{e}') for e in _EXTRAS)}, {', '.join(_reranked_sql(*s) for s in _SETTINGS)}
{' UNION ALL '.join(f'SELECT place, extra_bm25, CAST(blend AS DOUBLE) AS blend, round(avg(rr), 4) AS mrr FROM rv{s[0]} GROUP BY ALL' for s in _SETTINGS)}"""
)
def rerank_grid(spark, sf_dir):
    """Mean reciprocal rank of four settings of the reranker; each pair is scored once for all."""
    rel = qrels(spark, sf_dir)
    grid = P.rerank_grid(docs(spark, sf_dir), items(spark, sf_dir), P.Spec(), _EXTRAS, _BLENDS, dense=S.tfidf, score=_dice)
    labelled = grid.join(rel.select("query_id").distinct(), "query_id", "left_semi").join(rel.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    rr = labelled.groupBy("place", "extra_bm25", "blend", "query_id").agg(F.coalesce(1.0 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"))
    return rr.groupBy("place", "extra_bm25", "blend").agg(F.round(F.avg("rr"), 4).alias("mrr"))


@query(f"WITH {_TF}, {_bm25_sql(1.5, 0.75)} SELECT query_id, rank, doc_id, round(score, 4) AS score, substr(text, 1, 400) AS preview FROM {_top_sql('bm', 3)} JOIN documents USING (doc_id)")
def chunk_finder(spark, sf_dir):
    out = P.find_chunks(docs(spark, sf_dir), items(spark, sf_dir), 3)
    return out.withColumns({"rank": F.col("rank").cast("bigint"), "score": F.round("score", 4)})


def _draw(word: str, a: str, b: str) -> str:
    return f"(CAST('0x' || substr(md5('{word}:' || {a} || ':' || {b}), 1, 12) AS BIGINT) / 281474976710656.0)"


@query(
    f"""WITH {_TF}, {_bm25_sql()}, {_bm25_sql(2.0, 0.6, 'bo')}, {_QRELS}, {', '.join(f"r{p} AS (SELECT q.query_id, coalesce(1.0 / min(CASE WHEN qr.doc_id IS NOT NULL THEN r.rank END), 0) AS rr FROM (SELECT DISTINCT query_id FROM qr) q JOIN {_top_sql(p, 10)} r USING (query_id) LEFT JOIN qr ON qr.query_id = r.query_id AND qr.doc_id = r.doc_id GROUP BY 1)" for p in ('bm', 'bo'))},
xd AS (SELECT row_number() OVER (ORDER BY query_id) - 1 AS i, rbm.rr AS new_value, rbo.rr AS old_value, rbm.rr - rbo.rr AS diff FROM rbm JOIN rbo USING (query_id)), xn AS (SELECT count(*) AS n FROM xd),
xm AS (SELECT b, avg(diff) AS mean FROM (SELECT b, CAST(floor({_draw('boot', 'b', 'j')} * n) AS BIGINT) AS i FROM range(10000) t(b), xn, range((SELECT n FROM xn)) u(j)) JOIN xd USING (i) GROUP BY 1), xk AS (SELECT mean, row_number() OVER (ORDER BY mean, b) - 1 AS k FROM xm),
xs AS (SELECT b, abs(avg(CASE WHEN {_draw('flip', 'b', 'i')} < 0.5 THEN diff ELSE -diff END)) AS m FROM range(10000) t(b), xd GROUP BY 1),
xp AS (SELECT (1 + sum(CAST(m >= (SELECT abs(avg(diff)) FROM xd) - 1e-12 AS INT))) / 10001.0 AS p FROM xs)
SELECT 'rr' AS metric, 'bm25' AS new, 'bm25_flat' AS old, (SELECT n FROM xn) AS n, round((SELECT avg(old_value) FROM xd), 6) AS old_mean, round((SELECT avg(new_value) FROM xd), 6) AS new_mean, (SELECT count(*) FROM xd WHERE diff > 0) AS better, (SELECT count(*) FROM xd WHERE diff < 0) AS worse,
round(max(CASE WHEN k = 250 THEN mean END), 6) AS low, round(max(CASE WHEN k = 9749 THEN mean END), 6) AS high, round((SELECT p FROM xp), 6) AS p, round((SELECT p FROM xp), 6) AS p_holm FROM xk"""
)
def compare_stages(spark, sf_dir):
    """Reciprocal ranks of two settings of BM25: interval and p of their difference."""
    d, q, rel = docs(spark, sf_dir), items(spark, sf_dir), S.settled(qrels(spark, sf_dir))
    both = S.Index(d, [S.Field(T.tokens(F.col("text")), q)]).scores(bm25=S.Bm25(), bm25_flat=S.Bm25(0, 2.0, 0.6))
    of = lambda name: E.ranking_metrics(S.top_k(both.select("query_id", "doc_id", F.col(name).alias("score")), 10), rel).select(F.lit(name).alias("stage"), "query_id", "rr")
    out = R.compare_stages(S.settled(of("bm25").unionByName(of("bm25_flat"))), [("bm25", "bm25_flat")], "rr")
    return out.select("metric", "new", "old", "n", *[F.round(c, 6).alias(c) for c in ("old_mean", "new_mean")], "better", "worse", *[F.round(c, 6).alias(c) for c in ("low", "high", "p", "p_holm")])


@query(
    f"""WITH {_TF}, {_bm25_sql()}, {_QRELS}, {_METRICS}, gq AS (SELECT *, max(relevance) OVER (PARTITION BY query_id) AS top FROM qr), gb AS (SELECT query_id, doc_id, relevance = 2 OR top < 2 AS best FROM gq),
mo AS (SELECT unnest([1, 2]) AS depth), cv AS (SELECT depth, gb.query_id, count(*) FILTER (best) AS covered, count(*) AS rq FROM gb JOIN run USING (query_id, doc_id), mo WHERE rank <= depth GROUP BY ALL), nb AS (SELECT query_id, count(*) FILTER (best) AS n_best FROM gb GROUP BY 1)
SELECT 'first ' || mo.depth AS mode, count(*) AS n, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(ndcg_5), 6) AS ndcg_5, round(avg(coalesce(covered, 0) / n_best), 6) AS coverage, round(avg(coalesce(rq, 0)), 6) AS right_quotes
FROM me JOIN nb ON nb.query_id = me.query_id CROSS JOIN mo LEFT JOIN cv ON cv.depth = mo.depth AND cv.query_id = me.query_id GROUP BY mo.depth"""
)
def multi_intent_table(spark, sf_dir):
    """Two modes that quote the first one and the first two documents of the same run."""
    run = S.top_k(S.bm25(docs(spark, sf_dir), items(spark, sf_dir)), 10)
    modes = [run.withColumn("mode", F.lit(f"first {k}")) for k in (1, 2)]
    both = modes[0].unionByName(modes[1])
    quoted = both.filter(F.col("rank") <= F.substring("mode", 7, 1).cast("int")).select("mode", "query_id", "doc_id")
    out = R.multi_intent_table(both.select("mode", "query_id", "doc_id", "rank"), quoted, qrels(spark, sf_dir))
    return out.select("mode", "n", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "ndcg_5", "coverage", "right_quotes")])


@query(
    f"""WITH {_TF}, {_bm25_sql()}, {_bm25_sql(2.0, 0.6, 'bo')}, {_QRELS}, tp AS (SELECT pl AS pipeline, item_id AS query_id, round(coalesce(max(score), 0), 6) AS s, item_id % 3 = 0 AS lacking, item_id IN (SELECT query_id FROM qr) AS a FROM (SELECT unnest(['bm25', 'bm25_flat']) AS pl) a CROSS JOIN benchmark LEFT JOIN (SELECT 'bm25' AS p, * FROM bm UNION ALL SELECT 'bm25_flat', * FROM bo) b ON b.p = a.pl AND b.query_id = item_id GROUP BY ALL),
ds AS (SELECT DISTINCT pipeline, s FROM tp), th AS (SELECT pipeline, (s + lead(s) OVER (PARTITION BY pipeline ORDER BY s)) / 2 AS t FROM ds), tt AS (SELECT * FROM th WHERE t IS NOT NULL UNION SELECT DISTINCT pipeline, 0.0 FROM tp),
ra AS (SELECT pipeline, c, t, avg(CASE WHEN NOT a THEN CAST(s < t OR (c AND lacking) AS DOUBLE) END) AS correct, avg(CASE WHEN a THEN CAST(s < t OR (c AND lacking) AS DOUBLE) END) AS wrong FROM tp JOIN tt USING (pipeline), (SELECT unnest([false, true]) AS c) GROUP BY ALL),
be AS (SELECT pipeline, c, t, correct, wrong FROM ra QUALIFY row_number() OVER (PARTITION BY pipeline, c ORDER BY CAST(coalesce(wrong, 0) <= 0.1 AND correct IS NOT NULL AS INT) DESC, CASE WHEN coalesce(wrong, 0) <= 0.1 THEN round(correct, 9) END DESC, t) = 1),
jo AS (SELECT f.pipeline, f.t AS off, g.t AS on_, coalesce(g.correct >= f.correct AND coalesce(g.wrong, 0) <= 0.1, false) AS keep FROM be f JOIN be g ON f.pipeline = g.pipeline AND NOT f.c AND g.c)
SELECT pipeline, round(off, 6) AS threshold_without, round(on_, 6) AS threshold_with, keep AS check, round(CASE WHEN keep THEN on_ ELSE off END, 6) AS threshold FROM jo"""
)
def choose_thresholds(spark, sf_dir):
    """Thresholds and the choice of the evidence check for two pipelines; every third item lacks evidence."""
    d, q = docs(spark, sf_dir), items(spark, sf_dir)
    has = qrels(spark, sf_dir).select("query_id").distinct().withColumn("answerable", F.lit(True))
    of = lambda name, **how: q.select("query_id").join(S.bm25(d, q, **how).groupBy("query_id").agg(F.max("score").alias("score")), "query_id", "left").withColumn("pipeline", F.lit(name))
    tops = of("bm25").unionByName(of("bm25_flat", k1=2.0, b=0.6)).join(has, "query_id", "left").withColumns({"answerable": F.coalesce("answerable", F.lit(False)), "lacking": F.col("query_id") % 3 == 0})
    out = R.choose_thresholds(tops)
    return out.select("pipeline", F.round("threshold_without", 6).alias("threshold_without"), F.round("threshold_with", 6).alias("threshold_with"), "check", "threshold")


@query(
    """WITH t AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations), a AS (SELECT conv_id, arg_min(text, turn) AS q, round(avg(n), 4) AS f FROM t GROUP BY 1), b AS (SELECT conv_id, arg_max(text, turn) AS q, CAST(max(n) AS DOUBLE) AS f FROM t GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (a.q != b.q) AS changed, round(avg(a.f), 4) AS f1_first, round(avg(b.f), 4) AS f1_second, count(*) FILTER (a.q != b.q AND b.f > a.f) AS better, count(*) FILTER (a.q != b.q AND b.f < a.f) AS worse, count(*) FILTER (a.q != b.q AND b.f = a.f) AS equal FROM a JOIN b USING (conv_id)"""
)
def compare_quotes(spark, sf_dir):
    """Two made scorers: each conversation's first turn with its mean length, and its last with the greatest."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "turn", "text", F.length("text").alias("n"))
    first = t.groupBy("query_id").agg(F.min_by("text", "turn").alias("quote"), F.round(F.avg("n"), 4).alias("f1"))
    second = t.groupBy("query_id").agg(F.max_by("text", "turn").alias("quote"), F.max("n").cast("double").alias("f1"))
    out = R.compare_quotes(first, second)
    return out.withColumns({c: F.round(c, 4) for c in ("f1_first", "f1_second")})


@query(
    """SELECT e.event_id AS id, coalesce(d.source, '–') AS topic, coalesce('Document ' || d.doc_id, '') AS citation FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id"""
)
def log_sources(spark, sf_dir):
    """Events as questions, users as the chunks that answered them."""
    q = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("top_chunk_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return R.log_with_sources(q, d, F.col("source"), F.concat(F.lit("Document "), F.col("doc_id").cast("string"))).select("id", "topic", "citation")


@query("SELECT lower(text) AS question, min(conv_id * 1000 + turn) AS query_id FROM conversations GROUP BY 1")
def first_seen(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.lower("text").alias("question"), (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"))
    return R.first_seen(t, "question", "query_id")


@query(f"WITH {_TF}, {_bm25_sql()}, tw AS (SELECT query_id // 2 AS query_id, CAST(query_id % 2 AS INTEGER) AS part, doc_id, rank FROM {_top_sql('bm', 10)}) SELECT query_id, part, array_to_string(list(doc_id ORDER BY rank), ',') AS top_chunks FROM tw WHERE rank <= 5 GROUP BY ALL")
def public_parts(spark, sf_dir):
    """Two items as the parts of one question, each with the first five documents."""
    run = S.top_k(S.bm25(docs(spark, sf_dir), items(spark, sf_dir)), 10)
    hits = run.select(F.expr("query_id div 2").alias("query_id"), (F.col("query_id") % 2).cast("int").alias("part"), "rank", "doc_id")
    out = R.public_parts(hits.select("query_id", "part").distinct(), hits)
    return out.withColumn("top_chunks", F.array_join(F.transform("top_chunks", lambda x: x.cast("string")), ","))


@query(f"WITH {_TF}, {_bm25_sql()}, {_QRELS}, {_METRICS} SELECT query_id, {', '.join(f'round({m}, 6) AS {m}' for m in _MEASURES)} FROM me")
def query_metrics(spark, sf_dir):
    """The measures of every labelled item by itself."""
    return _metrics(spark, sf_dir).select("query_id", *[F.round(m, 6).alias(m) for m in _MEASURES])
