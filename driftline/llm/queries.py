"""Registered queries of the document operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftline.llm.common import in_fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


@query("op8_exact_dedup", r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)""")
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from driftline.llm.exact_dedup import exact_groups

    return exact_groups(documents(spark, folder))


@query("op2_decontaminate")
def decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from driftline.llm.decontaminate import find_leaks

    return find_leaks(documents(spark, folder), table(spark, folder, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op5_near_dedup")
def near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from driftline.llm.near_dedup import near_groups

    return near_groups(documents(spark, folder))


def vocabulary() -> dict[str, str]:
    """The public vocabulary, once as a tokenizer file and once as ranks."""
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
            "pattern": public_tokenizers.PATTERN}


@query("op7_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    from driftline.llm.packing import pack

    return pack(documents(spark, folder), **vocabulary())


@query("op10_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    from driftline.llm.language_id import ROWS, fit, predict, sample_per_label

    docs = documents(spark, folder)
    labelled = docs.where(~in_fold("doc_id", 4, 2) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    model = fit(sample_per_label(labelled, "lang", "doc_id", ROWS), "lang", "text")
    return predict(docs, model).select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@query("op6_toxicity")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from driftline.llm.toxicity import THRESHOLD, fit, score

    docs = documents(spark, folder)
    fitted = fit(docs, table(spark, folder, "labels").where(~in_fold("doc_id", 3, 1)))
    return score(docs, fitted).select(
        "doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op1_quality")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    """Grades: 0 poor, 1 good but toxic, 2 good."""
    from driftline.llm.quality import fit, grade

    docs = documents(spark, folder)
    rating = (F.col("quality") + F.col("quality") * (1 - F.col("toxic"))).alias("rating")
    rated = table(spark, folder, "labels").where(~in_fold("doc_id", 3, 1)).select("doc_id", rating)
    return grade(docs, fit(docs, rated)).select(
        "doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "expected_grade", "likely_grade",
        F.try_element_at("tails", F.lit(1)).alias("p_above_0"), F.try_element_at("tails", F.lit(2)).alias("p_above_1"),
        F.coalesce(F.try_element_at("tails", F.lit(2)) >= 0.5, F.lit(False)).alias("selected"))


@query("op3_pii")
def pii(spark: SparkSession, folder: str) -> DataFrame:
    from driftline.llm.pii import find_pii

    one = F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return find_pii(documents(spark, folder)).withColumn("spans", F.concat_ws(",", one)).drop("found")


@query("op9_language_model")
def language_model(spark: SparkSession, folder: str) -> DataFrame:
    from driftline.llm.language_model import language_scores

    return language_scores(documents(spark, folder), in_fold("doc_id", 7, 2))


@query("op4_line_dedup", r"""
WITH RECURSIVE inst AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
long AS (SELECT * FROM inst WHERE length(line) >= 20),
own AS (SELECT line, length(line) AS n, min(struct_pack(d := doc_id, p := place)) AS first FROM long GROUP BY line),
links AS (SELECT a.line AS a, b.line AS b FROM own a JOIN own b ON b.n BETWEEN a.n AND a.n + 2 AND a.line <> b.line
  WHERE levenshtein(a.line, b.line) <= 2),
pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS line, b AS other FROM pairs UNION SELECT r.line, x.b FROM reach r JOIN pairs x ON r.other = x.a),
stay AS (SELECT first FROM own o WHERE NOT EXISTS (SELECT 1 FROM reach r JOIN own x ON r.other = x.line WHERE r.line = o.line AND x.first < o.first)),
marked AS (SELECT i.*, length(line) < 20 OR s.first IS NOT NULL AS kept
  FROM inst i LEFT JOIN stay s ON s.first.d = i.doc_id AND s.first.p = i.place)
SELECT d.doc_id, count(m.place) AS n_lines, count(*) FILTER (WHERE NOT m.kept) AS n_removed,
  sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.place) FILTER (WHERE m.kept), '')) AS text_sha256
FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id""")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from driftline.llm.line_dedup import dedup_lines

    return dedup_lines(documents(spark, folder).select("doc_id", "text")).select(
        "doc_id", "line_dedup.n_lines", "line_dedup.n_removed",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query("op12_fill_in_middle", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, len(units) AS n, h1 % (len(units) + 1) AS a, h2 % (len(units) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
  array_to_string(units[greatest(a, b) + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""")
def fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    from driftline.llm.fill_middle import fill_in_middle as arrange, restored

    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return arrange(documents(spark, folder)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


@query("op11_source_divergence", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
l AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT g.lang, g.source, l.v, coalesce(sum(c.c), 0)::HUGEINT AS n FROM grp g JOIN l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, (1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (g.n + 2 * g.v))::HUGEINT AS p,
  (1 + 1000000000::HUGEINT * (k.total + 2) // (l.n + 2 * l.v))::HUGEINT AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM rows)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""")
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    from driftline.llm.divergence import source_divergence as audit

    return audit(documents(spark, folder))


@query("op13_fingerprint")
def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    from driftline.llm.fingerprint import edits

    return edits(documents(spark, folder))
