"""The registered queries over `documents` and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import SHINGLE, SIGNATURE, Config
from .functions.text import STOPWORDS, basename, csv_text, json_text
from .operators import authorship, candidates, ranks, similarity, terms
from .plans import analysis, benchmark
from .scratch import scratch_path, settle
from .sources import readers, sinks

LOOKUP_TERM = "er"
_r = lambda name: F.round(name, 6).alias(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer files than cores are dealt out, as a file of one row group is else one task."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs._jdf.inputFiles()) < cores else docs


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.tokenized(documents(spark, sf_dir))


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that several plans read are cut once and written."""
    return settle(_tokens(spark, sf_dir), "tokens")


def _pairs(tokens: DataFrame, banding: tuple[int, int] = (20, 5)) -> DataFrame:
    """Band keys are read several times, and so written once."""
    return candidates.candidate_pairs(settle(candidates.band_lists(tokens, banding), "bands"))


def _scored(tokens: DataFrame, parts: tuple[str, ...] = similarity.PARTS) -> similarity.ClassScores:
    return similarity.candidate_scores(similarity.candidates_of(tokens), tokens, parts)


def _scores(spark: SparkSession, sf_dir: str, threshold: float | None = None) -> DataFrame:
    return _scored(_settled(spark, sf_dir)).pairs(threshold)


def _named(docs: DataFrame) -> DataFrame:
    """Documents under file names, as paths of either kind."""
    return docs.withColumn("filename", basename(F.concat(F.when(F.col("doc_id") % 2 == 0, "in/").otherwise("in\\"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt"))))


def tokenize(spark, sf_dir):
    each = _tokens(spark, sf_dir).select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    return each.withColumn("pos", F.col("pos").cast("long"))


def token_totals(spark, sf_dir):
    return terms.token_totals(_tokens(spark, sf_dir))


def term_counts(spark, sf_dir):
    return terms.term_counts(_tokens(spark, sf_dir)).select("doc_id", "term", "cnt")


def document_frequency(spark, sf_dir):
    return terms.document_frequency(terms.term_counts(_tokens(spark, sf_dir)))


def tfidf_weights(spark, sf_dir):
    return terms.tfidf_weights(_tokens(spark, sf_dir)).select("doc_id", "term", _r("tfidf"))


def tfidf_norms(spark, sf_dir):
    return terms.tfidf_norms(terms.tfidf_weights(_tokens(spark, sf_dir))).select("doc_id", _r("norm"))


def tfidf_lookup(spark, sf_dir):
    tokens = _settled(spark, sf_dir)
    return terms.tfidf_lookup(tokens, terms.tfidf_weights(tokens), LOOKUP_TERM).select("doc_id", "term", _r("tfidf"))


def minhash_signatures(spark, sf_dir):
    found = candidates.signatures(_tokens(spark, sf_dir)).select("doc_id", F.posexplode("signature").alias("k", "value"))
    return found.withColumn("k", F.col("k").cast("long"))


def lsh_band_keys(spark, sf_dir):
    return candidates.band_keys(_tokens(spark, sf_dir)).withColumn("band", F.col("band").cast("long"))


def lsh_candidates(spark, sf_dir):
    return _pairs(_tokens(spark, sf_dir)).withColumn("first_band", F.col("first_band").cast("long"))


def rk_fingerprints(spark, sf_dir):
    return candidates.fingerprints(_tokens(spark, sf_dir)).select("doc_id", F.explode("fingerprints").alias("fingerprint"))


def cosine_pairs(spark, sf_dir):
    return _scored(_settled(spark, sf_dir), ("cosine",)).pairs().select("a", "b", _r("cosine"))


def rk_pairs(spark, sf_dir):
    return _scored(_settled(spark, sf_dir), ("rabin_karp",)).pairs().select("a", "b", _r("rabin_karp"))


def similarity_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("a", "b", _r("cosine"), _r("rabin_karp"), _r("combined"))


def flagged_pairs(spark, sf_dir):
    return _scores(spark, sf_dir, 0.75).select("a", "b", _r("cosine"), _r("rabin_karp"), _r("combined"))


def pair_severity(spark, sf_dir):
    return similarity.with_severity(_scores(spark, sf_dir, 0.75)).select("a", "b", _r("combined"), "severity").orderBy(F.desc("combined"), "a", "b")


def similarity_long(spark, sf_dir):
    return similarity.similarity_long(_scores(spark, sf_dir), documents(spark, sf_dir)).select("row", "col", _r("score"))


def similarity_block(spark, sf_dir):
    docs = documents(spark, sf_dir)
    long = similarity.similarity_long(_scores(spark, sf_dir), docs)
    return similarity.matrix_block(long, docs, 0).select("row", "col", _r("score"))


def lm_ngrams(spark, sf_dir):
    return authorship.train(spark).ngrams.select(F.array_join("gram", " ").alias("gram"), "cnt")


def lm_contexts(spark, sf_dir):
    return authorship.train(spark).contexts.select(F.array_join("gram", " ").alias("gram"), "cnt")


def lm_vocabulary(spark, sf_dir):
    return authorship.train(spark).vocabulary


def doc_perplexity(spark, sf_dir):
    return authorship.perplexity(_tokens(spark, sf_dir), ["doc_id"], authorship.train(spark)).select("doc_id", _r("perplexity"))


def sentence_perplexity(spark, sf_dir):
    sentences = authorship.sentence_tokens(documents(spark, sf_dir))
    return authorship.perplexity(sentences, ["doc_id", "sentence"], authorship.train(spark)).select("doc_id", F.col("sentence").cast("long").alias("sentence"), _r("perplexity"))


def _authorship(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return authorship.authorship_scores(docs, terms.tokenized(docs), authorship.train(spark))


def sentence_variance(spark, sf_dir):
    return _authorship(spark, sf_dir).select("doc_id", F.round("perplexity_variance", 4).alias("variance"))


def ai_scores(spark, sf_dir):
    return _authorship(spark, sf_dir).select("doc_id", _r("mean_perplexity"), F.round("perplexity_variance", 4).alias("perplexity_variance"), _r("ai_score"), "flagged")


def ai_flagged(spark, sf_dir):
    return _authorship(spark, sf_dir).agg(F.count_if("flagged").alias("ai_flagged"))


def run_summary(spark, sf_dir):
    docs, tokens = documents(spark, sf_dir), _settled(spark, sf_dir)
    n = docs.agg(F.count(F.lit(1)).alias("documents"))
    pairs = _scored(tokens).pairs().agg(F.count(F.lit(1)).alias("candidate_pairs"), F.count_if(F.col("combined") >= 0.75).alias("flagged_pairs"))
    flagged = authorship.authorship_scores(docs, tokens, authorship.train(spark)).agg(F.count_if("flagged").alias("ai_flagged"))
    return n.crossJoin(pairs).crossJoin(flagged).select("documents", F.expr("documents * (documents - 1) div 2").alias("total_pairs"), "candidate_pairs", "flagged_pairs", "ai_flagged")


def folder_documents(spark, sf_dir):
    """Every document as a file of a folder, read back."""
    folder = scratch_path(spark, "folder")
    sinks.write_folder(_named(documents(spark, sf_dir)), folder)
    return readers.from_folder(spark, folder).select("doc_id", "filename", "bytes", F.md5("text").alias("text_md5"))


def flagged_order(spark, sf_dir):
    """Flagged pairs with their place in the order in which they were found."""
    flagged = _scores(spark, sf_dir, 0.75).select("a", "b", "first_band", "first_key")
    return ranks.numbered(flagged, "place", F.col("first_band"), F.col("first_key"), F.col("a"), F.col("b")).withColumn("first_band", F.col("first_band").cast("long"))


def flagged_names(spark, sf_dir):
    """Flagged pairs at a lower threshold, by file name, as clients read them."""
    names = _named(documents(spark, sf_dir)).select("doc_id", "filename")
    pairs = _scores(spark, sf_dir, 0.5)
    by = lambda side: names.select(F.col("doc_id").alias(side), F.col("filename").alias(f"doc_{side}"))
    return pairs.join(by("a"), "a").join(by("b"), "b").select("doc_a", "doc_b", _r("cosine"), _r("rabin_karp"), F.round("combined", 6).alias("score"))


def ai_ranking(spark, sf_dir):
    """Documents by falling score, as they are shown; of equal scores the least id comes first."""
    scores = _authorship(spark, sf_dir).select("doc_id", F.round(F.coalesce("ai_score", F.lit(0.0)), 6).alias("ai_score"))
    return ranks.numbered(scores, "place", F.desc("ai_score"), F.col("doc_id"))


def written_pairs(spark, sf_dir):
    """The whole analysis, written as tables, and its flagged pairs read back."""
    folder = scratch_path(spark, "out")
    docs = _named(documents(spark, sf_dir)).withColumn("bytes", F.octet_length("text").cast("long"))
    result = analysis.analyze(spark, docs, Config())
    try:
        analysis.write_long(folder, result)
    finally:
        result.close()
    return spark.read.parquet(f"{folder}/flagged_pairs").select("a", "b", _r("cosine"), _r("rabin_karp"), _r("combined"))


def written_scores(spark, sf_dir):
    """Authorship scores written as CSV by file name, and read back."""
    path = scratch_path(spark, "scores")
    scores = _authorship(spark, sf_dir).join(_named(documents(spark, sf_dir)).select("doc_id", "filename"), "doc_id")
    sinks.scores_csv(scores, path)
    return spark.read.option("header", True).csv(path).select("filename", "flagged")


def banded_candidates(spark, sf_dir):
    """Pairs of ten bands of eight rows."""
    return _pairs(_tokens(spark, sf_dir), Config(bands=10, rows=8).banding).select("a", "b", F.col("first_band").cast("long").alias("first_band"), "first_key")


def banding_fallback(spark, sf_dir):
    """Pairs of a banding of more values than a signature has."""
    return _pairs(_tokens(spark, sf_dir), Config(bands=50, rows=5).banding).select("a", "b")


def _corpus_model(spark, sf_dir):
    """A model of order 2 trained on files, one for each row of `benchmark`."""
    folder = scratch_path(spark, "corpus")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    sinks.write_folder(items.select(F.concat(F.col("item_id").cast("string"), F.lit(".txt")).alias("filename"), "text"), folder)
    return authorship.train(spark, readers.read_corpus(spark, folder), 2)


def corpus_ngrams(spark, sf_dir):
    return _corpus_model(spark, sf_dir).ngrams.select(F.array_join("gram", " ").alias("gram"), "cnt")


def corpus_perplexity(spark, sf_dir):
    return authorship.perplexity(_tokens(spark, sf_dir), ["doc_id"], _corpus_model(spark, sf_dir)).select("doc_id", _r("perplexity"))


def stopword_file(spark, sf_dir):
    """Token counts under a file of stopwords."""
    folder = scratch_path(spark, "stopwords")
    sinks.write_folder(spark.createDataFrame([("words.txt", "# not these\nThe  \n\nOF\nthe\nand\t\n")], "filename string, text string"), folder)
    words = readers.read_stopwords(spark, f"{folder}/words.txt")
    return terms.tokenized(documents(spark, sf_dir), words).select("doc_id", F.size("tokens").cast("long").alias("tokens"))


def escaped_texts(spark, sf_dir):
    """Texts as fields of CSV and as JSON strings."""
    text = F.coalesce("text", F.lit(""))
    return documents(spark, sf_dir).select("doc_id", F.md5(csv_text(text)).alias("csv_md5"), F.md5(json_text(text)).alias("json_md5"))


def stage_share(spark, sf_dir):
    stages = spark.createDataFrame(list(benchmark.STAGES), "stage string, ms double")
    return benchmark.stage_shares(stages).select("stage", "ms", _r("share"))


def amdahl_fit(spark, sf_dir):
    return benchmark.amdahl_fit(benchmark.points(spark)).select(F.round("serial_share", 3).alias("serial_share"), F.round("error", 9).alias("error"))


def amdahl_curve(spark, sf_dir):
    return benchmark.amdahl_curve(spark)


def thread_speedup(spark, sf_dir):
    return benchmark.thread_speedup(benchmark.points(spark)).select("threads", _r("speedup"), _r("efficiency"))


QUERIES = {f.__name__: f for f in (tokenize, token_totals, term_counts, document_frequency, tfidf_weights, tfidf_norms, tfidf_lookup, minhash_signatures, lsh_band_keys, lsh_candidates, rk_fingerprints, cosine_pairs, rk_pairs, similarity_scores, flagged_pairs, pair_severity, similarity_long, similarity_block, lm_ngrams, lm_contexts, lm_vocabulary, doc_perplexity, sentence_perplexity, sentence_variance, ai_scores, ai_flagged, run_summary, folder_documents, flagged_order, flagged_names, ai_ranking, written_pairs, written_scores, banded_candidates, banding_fallback, corpus_ngrams, corpus_perplexity, stopword_file, escaped_texts, stage_share, amdahl_fit, amdahl_curve, thread_speedup)}

# ---------------------------------------------------------------------------------------------------- SQL

_WORDS = ", ".join(f"'{w}'" for w in STOPWORDS)
_STEM = "CASE WHEN length(x) > 5 AND suffix(x, 'ing') THEN left(x, length(x) - 3) WHEN length(x) > 4 AND (suffix(x, 'ed') OR suffix(x, 'es')) THEN left(x, length(x) - 2) WHEN length(x) > 3 AND suffix(x, 's') THEN left(x, length(x) - 1) ELSE x END"


def _cut(text: str, words: str = _WORDS) -> str:
    found = f"regexp_extract_all(split_part(coalesce({text}, ''), chr(0), 1), '([A-Za-z0-9]{{1,255}})[A-Za-z0-9]?', 1)"
    return f"list_filter(list_transform(list_transform({found}, lambda y: lower(y)), lambda x: {_STEM}), lambda z: z NOT IN ({words}))"


_TOK = f"tok AS (SELECT doc_id, {_cut('text')} AS t FROM documents)"
_TF = """tf AS (SELECT doc_id, size, term, count(*) AS cnt FROM (SELECT doc_id, len(t) AS size, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, cnt / size * (ln((1 + (SELECT count(*) FROM tok)) / (1 + df)) + 1) AS tfidf FROM tf JOIN df USING (term)),
norm AS (SELECT doc_id, sqrt(sum(tfidf * tfidf)) AS norm FROM w GROUP BY doc_id)"""
_M = "4294967295"


def _u(x: str) -> str:
    return f"(({x}) & {_M}::UBIGINT)"


def _signatures() -> str:
    """h: for each word and place in a shingle, its hashes under all seeds; sh: a row for each shingle and seed."""
    fnv = _u("xor(acc, b) * 16777619::UBIGINT")
    m1 = f"list_reduce(bytes, lambda acc, b: {fnv}, xor(2166136261::UBIGINT, s))"
    m2 = f"xor({m1}, {_u('s * 2654435769::UBIGINT')})"
    # Multiplied in halves, as the product of two 32-bit numbers can pass 64 signed bits only in unsigned ones.
    fin = f"list_transform(list_transform(list_transform(sd, lambda s: {m2}), lambda v: xor(v, v >> 16)), lambda v: {_u('v * 2246822507::UBIGINT')})"
    h = f"list_transform({fin}, lambda v: xor(v, v >> 13))"
    step = lambda acc, x: _u(f"xor({acc}, {x}) * 16777619::UBIGINT")
    one = step("xor(2166136261::UBIGINT, seed)", "h1")
    two = f"CASE WHEN h2 IS NULL THEN {one} ELSE {step(one, 'h2')} END"
    three = f"CASE WHEN h3 IS NULL THEN v2 ELSE {step('v2', 'h3')} END"
    return f"""seeds AS (SELECT list(({_u('2654435769::UBIGINT + k::UBIGINT * 2246822507::UBIGINT')}) ORDER BY k) AS sd FROM range({SIGNATURE}) r(k)),
places AS (SELECT p, list_transform(sd, lambda s: {_u('s + p::UBIGINT * 17::UBIGINT')}) AS sd FROM seeds, range({SHINGLE}) r(p)),
word AS (SELECT word, list_transform(range(1, length(word) + 1), lambda i: ascii(word[i])::UBIGINT) AS bytes FROM (SELECT DISTINCT unnest(t) AS word FROM tok)),
hw AS (SELECT word, p, {h} AS h FROM word, places),
gram AS (SELECT DISTINCT doc_id, t[i] AS w1, CASE WHEN len(t) >= 2 THEN t[i + 1] END AS w2, CASE WHEN len(t) >= 3 THEN t[i + 2] END AS w3
  FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - {SHINGLE - 1}, least(len(t), 1)) + 1)) AS i FROM tok)),
met AS (SELECT doc_id, a.h AS l1, b.h AS l2, c.h AS l3 FROM gram JOIN hw a ON a.word = w1 AND a.p = 0 LEFT JOIN hw b ON b.word = w2 AND b.p = 1 LEFT JOIN hw c ON c.word = w3 AND c.p = 2),
sh AS (SELECT doc_id, k, h3, {two} AS v2 FROM (SELECT doc_id, unnest(range({SIGNATURE})) AS k, unnest(l1) AS h1, unnest(l2) AS h2, unnest(l3) AS h3, unnest((SELECT sd FROM seeds)) AS seed FROM met)),
sv AS (SELECT doc_id, k, {three} AS v FROM sh),
sig AS (SELECT doc_id, k, min(CASE WHEN xor(v, v >> 15) = 0 THEN 1 ELSE xor(v, v >> 15) END)::BIGINT AS value FROM sv GROUP BY ALL
  UNION ALL SELECT doc_id, unnest(range({SIGNATURE})), 0 FROM tok WHERE len(t) = 0)"""


_SIG = _signatures()


def _bands(rows: int, count: int) -> str:
    return f"""band AS (SELECT doc_id, band, list_reduce(vs, lambda h, v: xor(h, {_u('v::UBIGINT + 2654435769::UBIGINT + ((h << 6) & 4294967295::UBIGINT) + (h >> 2)')}), xor(2166136261::UBIGINT, band::UBIGINT))::BIGINT AS key
  FROM (SELECT doc_id, k // {rows} AS band, list(value::UBIGINT ORDER BY k) AS vs FROM sig WHERE k < {rows * count} GROUP BY ALL)),
pair AS (SELECT a, b, min(f).band AS first_band, min(f).key AS first_key FROM (SELECT x.doc_id AS a, y.doc_id AS b, {{'band': x.band, 'key': x.key}} AS f FROM band x JOIN band y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id) GROUP BY ALL)"""


_BAND = _bands(5, 20)
_RK = f"""hash AS (SELECT word, CASE WHEN h = 0 THEN 1::UBIGINT ELSE h END AS h FROM (SELECT word, list_reduce(list_transform(range(1, length(word) + 1), lambda i: ascii(word[i])::UBIGINT), lambda acc, b: {_u('xor(acc, b) * 16777619::UBIGINT')}, 2166136261::UBIGINT) AS h FROM (SELECT DISTINCT unnest(t) AS word FROM tok))),
hashed AS (SELECT doc_id, list(h ORDER BY i) AS hs FROM (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS i FROM tok) JOIN hash USING (word) GROUP BY doc_id),
fp AS (SELECT DISTINCT doc_id, CASE WHEN x = 0 THEN 1 ELSE x END::BIGINT AS fingerprint FROM (SELECT doc_id, list_reduce(hs[i:i + 4], lambda acc, v: {_u('acc * 16777619::UBIGINT + v')}, 0::UBIGINT) AS x FROM (SELECT doc_id, hs, unnest(range(1, len(hs) - 3)) AS i FROM hashed)))"""
_SCORE = f"""{_RK},
dot AS (SELECT a, b, sum(x.tfidf * y.tfidf) AS dot FROM pair JOIN w x ON x.doc_id = a JOIN w y ON y.doc_id = b AND y.term = x.term GROUP BY a, b),
cosine AS (SELECT a, b, coalesce(dot / (m.norm * n.norm), 0) AS cosine FROM pair LEFT JOIN dot USING (a, b) LEFT JOIN norm m ON m.doc_id = a LEFT JOIN norm n ON n.doc_id = b),
nf AS (SELECT doc_id, count(*) AS n FROM fp GROUP BY doc_id),
common AS (SELECT a, b, count(*) AS c FROM pair JOIN fp x ON x.doc_id = a JOIN fp y ON y.doc_id = b AND y.fingerprint = x.fingerprint GROUP BY a, b),
rk AS (SELECT a, b, CASE WHEN coalesce(m.n, 0) + coalesce(n.n, 0) = 0 THEN 0 ELSE coalesce(c, 0) / (coalesce(m.n, 0) + coalesce(n.n, 0) - coalesce(c, 0)) END AS rabin_karp FROM pair LEFT JOIN common USING (a, b) LEFT JOIN nf m ON m.doc_id = a LEFT JOIN nf n ON n.doc_id = b),
score AS (SELECT a, b, cosine, rabin_karp, 0.6::DOUBLE * cosine + 0.4::DOUBLE * rabin_karp AS combined FROM cosine JOIN rk USING (a, b))"""
_LM = f"""corpus AS (SELECT {_cut(repr(authorship.FALLBACK))} AS t),
lm3 AS (SELECT array_to_string(t[i:i + 2], ' ') AS gram, array_to_string(t[i:i + 1], ' ') AS context FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM corpus)),
n3 AS (SELECT gram, count(*) AS n FROM lm3 GROUP BY gram),
n2 AS (SELECT context, count(*) AS c FROM lm3 GROUP BY context),
vocabulary AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(t) AS word FROM corpus) GROUP BY word)"""


def _perplexity(name: str, source: str, keys: str) -> str:
    return f"""{name}g AS (SELECT {keys}, array_to_string(t[i:i + 2], ' ') AS gram, array_to_string(t[i:i + 1], ' ') AS context FROM (SELECT {keys}, t, unnest(range(1, len(t) - 1)) AS i FROM {source})),
{name}e AS (SELECT {keys}, exp(avg(-ln((coalesce(n, 0) + 1) / (coalesce(c, 0) + (SELECT count(*) FROM vocabulary))))) AS e FROM {name}g LEFT JOIN n3 USING (gram) LEFT JOIN n2 USING (context) GROUP BY {keys}),
{name} AS (SELECT {keys}, CASE WHEN len(t) = 0 THEN 1000 WHEN len(t) < 3 THEN 500 / len(t) ELSE e END AS perplexity FROM {source} LEFT JOIN {name}e USING ({keys}))"""


_DOCP = _perplexity("docp", "tok", "doc_id")
_SENT = f"""sent AS (SELECT * FROM (SELECT doc_id, sentence, {_cut('piece')} AS t FROM (SELECT doc_id, unnest(ps) AS piece, unnest(range(len(ps))) AS sentence FROM (SELECT doc_id, regexp_split_to_array(split_part(coalesce(text, ''), chr(0), 1), '[.!?]') AS ps FROM documents))) WHERE len(t) > 0),
{_perplexity('sentp', 'sent', 'doc_id, sentence')}"""
_AI = """var AS (SELECT d.doc_id, CASE WHEN count(s.perplexity) > 1 THEN avg(pow(s.perplexity - d.perplexity, 2)) ELSE 0 END AS variance FROM docp d LEFT JOIN sentp s USING (doc_id) GROUP BY d.doc_id),
ai AS (SELECT doc_id, perplexity, variance, least(greatest(100 / (1 + perplexity / 75) * (1 / (1 + sqrt(variance) / 100)), 0), 100) AS ai_score FROM docp JOIN var USING (doc_id))"""
_ALL_PAIRS = f"{_TOK}, {_SIG}, {_BAND}"
_ALL_SCORES = f"{_TOK}, {_TF}, {_SIG}, {_BAND}, {_SCORE}"
_ALL_AI = f"{_TOK}, {_LM}, {_DOCP}, {_SENT}, {_AI}"
_ROUNDED = "round(cosine, 6) AS cosine, round(rabin_karp, 6) AS rabin_karp, round(combined, 6) AS combined"

_NAME = "lpad({}::VARCHAR, 12, '0') || '.txt'"
_CORPUS = f"""corpus AS (SELECT {_cut('text')} AS t FROM benchmark),
lm2 AS (SELECT array_to_string(t[i:i + 1], ' ') AS gram, t[i] AS context FROM (SELECT t, unnest(range(1, len(t))) AS i FROM corpus)),
n2 AS (SELECT gram, count(*) AS n FROM lm2 GROUP BY gram),
n1 AS (SELECT context, count(*) AS c FROM lm2 GROUP BY context),
vocabulary AS (SELECT DISTINCT unnest(t) AS word FROM corpus)"""
_CORPUS_P = """g AS (SELECT doc_id, array_to_string(t[i:i + 1], ' ') AS gram, t[i] AS context FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM tok)),
e AS (SELECT doc_id, exp(avg(-ln((coalesce(n, 0) + 1) / (coalesce(c, 0) + (SELECT greatest(count(*), 1) FROM vocabulary))))) AS e FROM g LEFT JOIN n2 USING (gram) LEFT JOIN n1 USING (context) GROUP BY doc_id)"""

SQL = {
    "folder_documents": f"SELECT row_number() OVER (ORDER BY {_NAME.format('doc_id')}) - 1 AS doc_id, {_NAME.format('doc_id')} AS filename, strlen(coalesce(text, ''))::BIGINT AS bytes, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "flagged_order": f"WITH {_ALL_SCORES} SELECT a, b, first_band, first_key, row_number() OVER (ORDER BY first_band, first_key, a, b) - 1 AS place FROM score JOIN pair USING (a, b) WHERE combined >= 0.75",
    "flagged_names": f"WITH {_ALL_SCORES} SELECT {_NAME.format('a')} AS doc_a, {_NAME.format('b')} AS doc_b, round(cosine, 6) AS cosine, round(rabin_karp, 6) AS rabin_karp, round(combined, 6) AS score FROM score WHERE combined >= 0.5",
    "ai_ranking": f"WITH {_ALL_AI} SELECT doc_id, round(ai_score, 6) AS ai_score, row_number() OVER (ORDER BY round(ai_score, 6) DESC, doc_id) - 1 AS place FROM ai",
    "written_pairs": f"WITH {_ALL_SCORES} SELECT a, b, {_ROUNDED} FROM score WHERE combined >= 0.75",
    "written_scores": f"WITH {_ALL_AI} SELECT {_NAME.format('doc_id')} AS filename, (ai_score >= 50)::VARCHAR AS flagged FROM ai",
    "banded_candidates": f"WITH {_TOK}, {_SIG}, {_bands(8, 10)} SELECT * FROM pair",
    "banding_fallback": f"WITH {_ALL_PAIRS} SELECT a, b FROM pair",
    "corpus_ngrams": f"WITH {_CORPUS} SELECT gram, n AS cnt FROM n2",
    "corpus_perplexity": f"WITH {_TOK}, {_CORPUS}, {_CORPUS_P} SELECT doc_id, round(CASE WHEN len(t) = 0 THEN 1000 WHEN len(t) < 2 THEN 500 / len(t) ELSE e END, 6) AS perplexity FROM tok LEFT JOIN e USING (doc_id)",
    "stopword_file": "SELECT doc_id, len(" + _cut("text", "'the', 'of', 'and'") + ")::BIGINT AS tokens FROM documents",
    "escaped_texts": """SELECT doc_id, md5(CASE WHEN regexp_matches(coalesce(text, ''), '[",\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE coalesce(text, '') END) AS csv_md5, md5(to_json(coalesce(text, ''))::VARCHAR) AS json_md5 FROM documents""",
    "tokenize": f"WITH {_TOK} SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM tok",
    "token_totals": f"WITH {_TOK} SELECT (SELECT count(*) FROM tok) AS documents, (SELECT sum(len(t)) FROM tok)::BIGINT AS tokens, (SELECT count(DISTINCT x) FROM (SELECT unnest(t) AS x FROM tok)) AS vocabulary",
    "term_counts": f"WITH {_TOK}, {_TF} SELECT doc_id, term, cnt FROM tf",
    "document_frequency": f"WITH {_TOK}, {_TF} SELECT term, df FROM df",
    "tfidf_weights": f"WITH {_TOK}, {_TF} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM w",
    "tfidf_norms": f"WITH {_TOK}, {_TF} SELECT doc_id, round(norm, 6) AS norm FROM norm",
    "tfidf_lookup": f"WITH {_TOK}, {_TF} SELECT doc_id, '{LOOKUP_TERM}' AS term, round(coalesce(tfidf, 0), 6) AS tfidf FROM tok LEFT JOIN (SELECT * FROM w WHERE term = '{LOOKUP_TERM}') USING (doc_id)",
    "minhash_signatures": f"WITH {_TOK}, {_SIG} SELECT doc_id, k, value FROM sig",
    "lsh_band_keys": f"WITH {_ALL_PAIRS} SELECT doc_id, band, key FROM band",
    "lsh_candidates": f"WITH {_ALL_PAIRS} SELECT * FROM pair",
    "rk_fingerprints": f"WITH {_TOK}, {_RK} SELECT * FROM fp",
    "cosine_pairs": f"WITH {_ALL_SCORES} SELECT a, b, round(cosine, 6) AS cosine FROM cosine",
    "rk_pairs": f"WITH {_ALL_SCORES} SELECT a, b, round(rabin_karp, 6) AS rabin_karp FROM rk",
    "similarity_scores": f"WITH {_ALL_SCORES} SELECT a, b, {_ROUNDED} FROM score",
    "flagged_pairs": f"WITH {_ALL_SCORES} SELECT a, b, {_ROUNDED} FROM score WHERE combined >= 0.75",
    "pair_severity": f"WITH {_ALL_SCORES} SELECT a, b, round(combined, 6) AS combined, CASE WHEN combined > 0.9 THEN 'High' WHEN combined > 0.8 THEN 'Medium' ELSE 'Low' END AS severity FROM score WHERE combined >= 0.75",
    "similarity_long": f'WITH {_ALL_SCORES} SELECT a AS "row", b AS col, round(combined, 6) AS score FROM score UNION ALL SELECT b, a, round(combined, 6) FROM score UNION ALL SELECT doc_id, doc_id, 1.0::DOUBLE FROM documents',
    "similarity_block": f'WITH {_ALL_SCORES}, near AS (SELECT a AS "row", b AS col, combined AS s FROM score UNION ALL SELECT b, a, combined FROM score UNION ALL SELECT doc_id, doc_id, 1 FROM documents), page AS (SELECT doc_id FROM documents WHERE doc_id BETWEEN 0 AND 19) SELECT x.doc_id AS "row", y.doc_id AS col, round(coalesce(s, 0), 6) AS score FROM page x CROSS JOIN page y LEFT JOIN near ON "row" = x.doc_id AND col = y.doc_id',
    "lm_ngrams": f"WITH {_LM} SELECT gram, n AS cnt FROM n3",
    "lm_contexts": f"WITH {_LM} SELECT context AS gram, c AS cnt FROM n2",
    "lm_vocabulary": f"WITH {_LM} SELECT word, cnt FROM vocabulary",
    "doc_perplexity": f"WITH {_TOK}, {_LM}, {_DOCP} SELECT doc_id, round(perplexity, 6) AS perplexity FROM docp",
    "sentence_perplexity": f"WITH {_TOK}, {_LM}, {_SENT} SELECT doc_id, sentence, round(perplexity, 6) AS perplexity FROM sentp",
    "sentence_variance": f"WITH {_ALL_AI} SELECT doc_id, round(variance, 4) AS variance FROM ai",
    "ai_scores": f"WITH {_ALL_AI} SELECT doc_id, round(perplexity, 6) AS mean_perplexity, round(variance, 4) AS perplexity_variance, round(ai_score, 6) AS ai_score, ai_score >= 50 AS flagged FROM ai",
    "ai_flagged": f"WITH {_ALL_AI} SELECT count(*) FILTER (ai_score >= 50) AS ai_flagged FROM ai",
    "run_summary": f"WITH {_ALL_SCORES}, {_LM}, {_DOCP}, {_SENT}, {_AI} SELECT count(*) AS documents, count(*) * (count(*) - 1) // 2 AS total_pairs, (SELECT count(*) FROM score) AS candidate_pairs, (SELECT count(*) FROM score WHERE combined >= 0.75) AS flagged_pairs, (SELECT count(*) FROM ai WHERE ai_score >= 50) AS ai_flagged FROM documents",
} | benchmark.SQL
