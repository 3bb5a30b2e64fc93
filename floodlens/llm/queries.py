"""One thin query for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from floodlens.llm.common import table
from floodlens.llm.chat import format_chat, read_back
from floodlens.llm.compression_classifier import compression_quality, fit_on_table
from floodlens.llm.html_text import extract_text
from floodlens.llm.near_dedup import near_duplicates
from floodlens.llm.packing import best_fit_packing
from floodlens.llm.phrases import collocations
from floodlens.llm.pii import personal_data, train_tagger
from floodlens.llm.piece_sampling import sample_pieces
from floodlens.llm.quality_rules import quality_rules
from floodlens.llm.range_join import near_vectors
from floodlens.llm.suffix_dedup import suffix_dedup
from floodlens.llm.topk import top_k
from floodlens.llm.whitening import whiten

QUERIES: dict = {}
#: What cannot be written in SQL that DuckDB runs on whole tables is held against brute force by tests/llm.
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str):
    """A function that finds a public tokenizer's file on the machine where it runs."""

    def find() -> str:
        import public_tokenizers

        return str(public_tokenizers.path(name))

    return find


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op10_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression_quality(docs, fit_on_table(docs, table(spark, sf_dir, "labels")))


#: A conversation whose texts are control strings of another template.
CONTROL_CONVERSATION = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_chat(turns.union(extra), vocabulary("byte_bpe_50k.json")))


@query
def op1_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, train_tagger(docs))


@query
def op5_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


@query
def op8_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op11_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op11_metric_range_join"] = """WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a, least(a, min(b)) AS component FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(low.component, e.vec_id) AS component_id,
  coalesce(coalesce(low.component, e.vec_id) = e.vec_id, true) AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""


@query
def op12_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_toivonen_phrases"] = r"""WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS words FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) p),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
freq AS (SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2),
      lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
    FROM pieces, (VALUES (1), (2), (3)) s(size) WHERE len(words) >= size) g
  GROUP BY lang, size, phrase HAVING count(*) >= 10),
parted AS (SELECT *, string_split(phrase, ' ') AS w FROM freq WHERE size > 1),
cuts AS (SELECT c.*, l.f AS l, r.f AS r,
    (1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS score FROM (
    SELECT *, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest
    FROM parted, (VALUES (1), (2)) v(k) WHERE k < size) c
  JOIN freq l ON l.lang = c.lang AND l.phrase = first_part JOIN freq r ON r.lang = c.lang AND r.phrase = rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, part, max(f) AS f FROM (
    SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM parted WHERE size = 3) x
  GROUP BY lang, part)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.f DESC, b.phrase) AS rank, b.phrase,
  b.f AS a, b.l, b.r, t.n, CAST(b.score AS BIGINT) AS score
FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN longer g ON g.lang = b.lang AND g.part = b.phrase
WHERE g.f IS NULL OR 100 * g.f < 50 * b.f
QUALIFY rank <= 2000"""
