"""The operators over their whole tables, as queries, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, langid, linededup, minhash, packing, personal, quality, rules, secretscan, urlfilter, variants, whitening
from .common import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its lines, the lines dropped, and a digest of the text kept."""
    kept = linededup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Per vector: how many it links with, its component, and whether it is the one that stays."""
    return embeddings.near_vectors(table(spark, folder, "embeddings"))


_TWINS = """SELECT vec_id, label, cast(embedding AS {doubles}) AS embedding FROM embeddings
  UNION ALL SELECT vec_id + 1000000, label, {map} FROM embeddings WHERE vec_id % 3 = 0
  UNION ALL SELECT 2000000 + vec_id, 7, cast(embedding AS {doubles}) FROM embeddings WHERE vec_id < 50"""


def near_vectors_of_twins(spark: SparkSession, folder: str) -> DataFrame:
    """``op2_embeddings`` where vectors have near ones: each third with a changed twin, some once more under another label."""
    table(spark, folder, "embeddings").createOrReplaceTempView("embeddings")
    twins = _TWINS.format(doubles="array<double>", map="transform(embedding, (x, i) -> cast(x AS double) * 2 + 0.0625 * (vec_id % 9) * ((i + vec_id) % 5 - 2))")
    return embeddings.near_vectors(spark.sql(twins))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: how likely it is of good quality, learned from the labels of other documents."""
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Per page: the host and path of its url, the rule that covers it, and the verdict."""
    judged = urlfilter.judge_urls(table(spark, folder, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its class of near duplicates, and whether it is the one that stays."""
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: what the rules count, whether the base rules fail, and whether it is kept."""
    judged = rules.judge_quality(table(spark, folder, "documents").select("doc_id", "text", "lang"), carry=("doc_id", "lang"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("rest.doc_id", *counts, "base_failed", "kept", "class_distance", "common_distance")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Per piece of a document: where it lies in which sequence of 4096 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: how many secrets of each fixed pattern, a digest of their places, and all places."""
    found = secretscan.scan_secrets(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def of(kind):
        return F.filter("secrets", lambda s: s["kind"] == kind)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: the number of its ids, and digests of the ids and of the text decoded from them."""
    return bpe.digest_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its language as predicted, learned from the other four fifths of the documents."""
    return langid.identify_languages(table(spark, folder, "documents"))


def op11_personal(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: how much personal data of each fixed pattern, a digest of its places, and all places."""
    found = personal.find_personal(table(spark, folder, "documents").select("doc_id", "text"), carry=("doc_id",))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.filter("personal", lambda s: s["kind"] == kind)

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in personal.BASE]
    base = F.filter("personal", lambda s: s["kind"].isin(*personal.BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("personal")).alias("spans"))


def op12_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Per word: its frequent spelling, the root that spellings lead to, and how many words are one letter away."""
    return variants.group_variants(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Per vector and component: the vector whitened, and how well the whole is."""
    white = whitening.whiten(table(spark, folder, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_embeddings": op2_embeddings,
    "near_vectors_of_twins": near_vectors_of_twins,
    "op3_quality": op3_quality,
    "op4_urls": op4_urls,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_secrets": op8_secrets,
    "op9_bpe": op9_bpe,
    "op10_language": op10_language,
    "op11_personal": op11_personal,
    "op12_variants": op12_variants,
    "op13_whitening": op13_whitening,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_NEAR = """
        WITH RECURSIVE fine AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
              ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach AS (SELECT vec_id, vec_id AS other FROM embeddings
                  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
        least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
        counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)"""

_TWINS_SQL = _TWINS.format(
    doubles="DOUBLE[]", map="list_transform(embedding, lambda x, i: x::DOUBLE * 2 + 0.0625 * (vec_id % 9) * ((i - 1 + vec_id) % 5 - 2))"
)

ORACLES: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split),
        keyed AS (SELECT *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS key FROM lines),
        frequent AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
                     GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last AS gone
                   FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op2_embeddings": _NEAR,
    "op12_variants": f"""
        WITH RECURSIVE table_of AS (
            SELECT list(c ORDER BY i) AS crcs FROM (
                SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                FROM range(256) r(i))),
        runs AS (
            SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS times
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
        hashed AS (
            SELECT run, times, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(id || run, ''),
                lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END))),
                lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) AS h FROM runs, table_of),
        words AS (
            SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(times)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(times) >= 5),
        places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
        without AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM places),
        near AS (
            SELECT x.word, y.word AS other, y.n AS other_n FROM without x JOIN without y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
            UNION SELECT x.word, y.word, y.n FROM without x JOIN words y ON x.a || x.b = y.word
            UNION SELECT y.word, x.word, x.n FROM without x JOIN words y ON x.a || x.b = y.word),
        best AS (
            SELECT word, count(*) AS n_near, max(other_n) AS most, min({{'n': -other_n, 'word': encode(other)}}) AS first FROM near GROUP BY word),
        formed AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN decode(first.word) END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n
            FROM words w LEFT JOIN best b ON w.word = b.word),
        ways AS (
            SELECT word, word AS at, form AS next FROM formed
            UNION ALL SELECT w.word, f.word, f.form FROM ways w JOIN formed f ON w.next = f.word)
        SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN ways w ON f.word = w.word AND w.next IS NULL""",
    "near_vectors_of_twins": _NEAR.replace("embeddings", "twins").replace("WITH RECURSIVE", f"WITH RECURSIVE twins AS ({_TWINS_SQL}),"),
}
