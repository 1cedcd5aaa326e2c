"""The registered queries of this subpackage: thin uses of its operators with
production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseframe.llm import ann, chat, decontam, htmlextract, lexical, license, linededup, minhash, packing, partenum, quality, urlfilter, whitening

#: The url rules of the contract.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
HARD_TURN = r"\### Assistant: </turn> ok"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(packing.TOKENIZER)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(
        [(-7, 0, "user", HARD_TURN), (-7, 1, "assistant", HARD_TURN)], "conv_id long, turn long, role string, text string"
    )
    out = chat.format_conversations(rows.unionByName(hard))
    out = out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    rules = urlfilter.rules_table(spark, URL_RULES)
    return urlfilter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmlextract.extract(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license.scan(_read(spark, sf_dir, "documents"))
    base = F.expr("transform(filter(places, p -> p.base), p -> p.start)")
    return out.withColumn("starts", base).select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(_read(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_chat": op1_chat,
    "op2_packing": op2_packing,
    "op3_minhash": op3_minhash,
    "op4_decontamination": op4_decontamination,
    "op5_urls": op5_urls,
    "op6_html": op6_html,
    "op7_quality": op7_quality,
    "op8_lines": op8_lines,
    "op9_licenses": op9_licenses,
    "op10_neighbours": op10_neighbours,
    "op11_search": op11_search,
    "op12_jaccard": op12_jaccard,
    "op13_whitening": op13_whitening,
}

_HARD_SQL = HARD_TURN.replace("'", "''")
_ESC = "replace(replace(replace(replace({c}, '\\', '\\s'), '<turn', '\\lturn'), '</turn', '\\l/turn'), '<part/', '\\lpart/')"

_LICENCES = license.templates()
_LICENCE_ROWS = ", ".join(
    f"({k}, '{t.label}', {str(t.base).lower()}, {t.key_at}, {len(t.key)}, '{' '.join(t.key)}')" for k, t in enumerate(_LICENCES)
)
_LICENCE_POSTS = ", ".join(f"({k}, '{w}', {r})" for k, t in enumerate(_LICENCES) for w, r in t.postings)

_CUT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = {
    "op11_search": f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_CUT} AS ts FROM documents),
items AS (SELECT row_number() OVER () AS iid, item_id, list_distinct({_CUT}) AS ts FROM benchmark),
held AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM docs) u GROUP BY rid, t),
wanted AS (SELECT iid, item_id, unnest(ts) AS t FROM items),
size AS (SELECT count(*) FILTER (WHERE len(ts) > 0)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM docs),
weights AS (SELECT t, floor(1000 * ln((2 * max(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, size GROUP BY t),
scored AS (
  SELECT q.iid, q.item_id, d.rid, d.doc_id,
    sum(g.w * ((1000000000 * h.tf) // (1000 * h.tf + 20 * (50 + (50 * len(d.ts)::BIGINT * s.n_docs) // s.n_terms))))::BIGINT AS score
  FROM wanted q JOIN held h USING (t) JOIN weights g USING (t) JOIN docs d USING (rid), size s GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, rid))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50""",
    "op12_jaccard": r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS s FROM docs
), posts AS (SELECT rid, len(s)::BIGINT AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT x.rid AS a, y.rid AS b FROM posts x JOIN posts y ON x.g = y.g AND x.rid <> y.rid AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 90
  GROUP BY x.rid, y.rid, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach(a, b) AS (SELECT rid, rid FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(d.doc_id) AS component_id
FROM reach r JOIN sets s ON s.rid = r.a JOIN docs d ON d.rid = r.b GROUP BY s.rid, s.doc_id, s.s""",
    # starts come from the key phrases here, not from an index
    "op9_licenses": f"""
WITH t(t, label, base, key_at, key_size, key) AS (VALUES {_LICENCE_ROWS}),
posts(t, w, r) AS (VALUES {_LICENCE_POSTS}),
files AS (
  SELECT row_number() OVER () AS rid, doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{license.SPLIT}', ' ', 'g')) AS norm FROM documents
), f AS (SELECT *, CASE WHEN norm = '' THEN []::VARCHAR[] ELSE string_split(norm, ' ') END AS words FROM files),
lexicon AS (SELECT DISTINCT w FROM posts),
counts AS (SELECT w, count(*) AS c FROM (SELECT DISTINCT rid, unnest(words) AS w FROM f) u JOIN lexicon USING (w) GROUP BY w),
idf AS (SELECT w, greatest(ln(((SELECT count(*) FROM f) + 1.0::DOUBLE) / (coalesce(c, 0) + 0.5::DOUBLE)), 0.001) AS idf FROM lexicon LEFT JOIN counts USING (w)),
totals AS (SELECT t, sum(idf) AS total FROM posts JOIN idf USING (w) GROUP BY t),
starts AS (
  SELECT rid, t, label, base, unnest([j FOR j IN range(0, len(words)) IF array_to_string(words[j + 1 : j + key_size], ' ') = key]) - key_at AS s
  FROM f JOIN t ON contains(' ' || norm || ' ', ' ' || key || ' ')
), mass AS (
  SELECT s.rid, s.t, s.label, s.base, s.s, CASE WHEN s.base THEN 1.0::DOUBLE ELSE
    round(coalesce(sum(CASE WHEN s.s + p.r >= 0 AND f.words[s.s + p.r + 1] = p.w THEN i.idf END), 0) / max(total), 9) END AS mass
  FROM starts s JOIN posts p USING (t) JOIN idf i USING (w) JOIN totals USING (t) JOIN f USING (rid) GROUP BY s.rid, s.t, s.label, s.base, s.s
), places AS (SELECT * FROM mass WHERE mass >= {license.MIN_MASS})
SELECT f.doc_id, len(f.words)::BIGINT AS n_words, count(*) FILTER (WHERE p.base)::BIGINT AS n_base,
  min(p.s) FILTER (WHERE p.base)::BIGINT AS first_word, max(p.s) FILTER (WHERE p.base)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT p.label, ',' ORDER BY p.label) FILTER (WHERE p.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT p.label, ',' ORDER BY p.label), '') AS labels, coalesce(max(p.mass), 0.0::DOUBLE) AS score
FROM f LEFT JOIN places p USING (rid) GROUP BY f.rid, f.doc_id, f.words""",
    "op1_chat": f"""
WITH rows_in AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_HARD_SQL}' UNION ALL SELECT -7, 1, 'assistant', '{_HARD_SQL}'
), marked AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens,
         length({_ESC.format(c='text')}) AS text_len,
         length(replace({_ESC.format(c='role')}, '"', '\\q')) AS role_len
  FROM rows_in WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(text_len + CASE WHEN opens THEN role_len + 23 ELSE 7 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id""",
    "op5_urls": """
WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
  ('net', '/de/', 'block'), ('example.net', '/de/8', 'allow'), ('org', '/es/', 'block')
), u AS (
  SELECT row_number() OVER () AS rid, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), fit AS (
  SELECT u.rid, arg_max(r.host || r.path, length(r.host) + length(r.path)) AS rule,
         arg_max(r.verdict, length(r.host) + length(r.path)) AS verdict
  FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.rid
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN fit USING (rid)""",
}
