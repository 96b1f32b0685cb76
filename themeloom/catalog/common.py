"""What the registered queries share: tables, a taxonomy for them, SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import text
from themeloom.operators.dataset import Taxonomy
from themeloom.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with the SQL that must give the same rows."""
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are worked on row by row, spread over all cores."""
    return spread(table(spark, sf_dir, name))


# Frequent function words of the four languages in the tables.
STOPWORDS = (
    "the", "and", "of", "to", "in", "that", "is", "for", "with", "on", "as", "at", "by",
    "le", "la", "les", "des", "une", "dans", "pour", "que", "qui", "est",
    "der", "die", "das", "und", "ein", "von", "zu", "den", "mit", "sich", "für",
    "el", "los", "las", "una", "por", "con", "para",
)

# The tables' languages play the general topics; es is the out-of-taxonomy label.  A category is
# language-source; one source per language is excluded, one left unmapped, one overridden.
OTHER = "other"
TOPICS = ("de", "en", "fr")
EXCLUDED = tuple(f"{g}-src18" for g in TOPICS)
OVERRIDE = ("en-src0", "^(the|th)", ("fr", "c"))


def _taxonomy() -> Taxonomy:
    categories = {}
    for g in TOPICS:
        for i in range(18):
            categories[f"{g}-src{i}"] = (g, "a" if i < 9 else "b")
    return Taxonomy(categories, EXCLUDED, (OVERRIDE,), TOPICS, OTHER)


TAXONOMY = _taxonomy()
LABELS = TAXONOMY.labels

# Phrase forms for the stand-in topics.
FORMS = {
    "en": ("medium", "books", "book", "bookish"),
    "fr": ("qualifier", "science", "science", "scientific"),
    "de": ("domain", "physics", "physics", "physical"),
}
HEADS = {"en": "volumes"}


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as cards: category, term (the first two words), definition."""
    docs = texts(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.concat_ws("-", "lang", "source").alias("category"),
        F.array_join(F.slice(F.split(text.squeeze(F.col("text")), " "), 1, 2), " ").alias("term"),
        F.col("text").alias("definition"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a joint label: language > half of the sources, es without a subtopic."""
    docs = texts(spark, sf_dir, "documents")
    low = F.substring("source", 4, 2).cast("int") < 10
    return docs.select("doc_id", "text", F.when(F.col("lang") == "es", F.lit(OTHER)).otherwise(
        F.concat(F.col("lang"), F.lit(" > "), F.when(low, "a").otherwise("b"))).alias("label"))


JOINT_CLASSES = ["de > a", "de > b", "en > a", "en > b", "fr > a", "fr > b", OTHER]

# ------------------------------------------------------------------------------------ SQL blocks

W = r"[\p{L}\p{N}_]"
NOT_W = r"(^|[^\p{L}\p{N}_])"


def rr(column: str, pattern: str, replacement: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_replace({column}, '{pattern}', '{replacement}', 'g')"


def norm(column: str) -> str:
    """Normal form in SQL (no table text is mojibake)."""
    t = f"nfc_normalize({column})"
    t = rr(t, r"<[^>]+>", " ")
    t = rr(t, r"(?i)(?:https?://\S+|www\.\S+)", " ")
    t = rr(t, f"{NOT_W}@{W}+", r"\1 ")
    t = rr(t, f"{NOT_W}#({W}+)", r"\1\2")
    t = rr(t, f"({W})['’`´]({W}+)", r"\1")
    t = rr(t, r"[\p{So}\p{Sk}\p{Co}]", "")
    t = f"lower(translate({t}, 'Iİ', 'ıi'))"
    number = f"{NOT_W}\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)?($|[^\\p{{L}}\\p{{N}}_])"
    t = rr(rr(t, number, r"\1 \2"), number, r"\1 \2")
    t = rr(t, r"[^\p{L}\p{N}_\s]", " ")
    t = rr(t, "_+", " ")
    return f"trim({rr(t, '\\s+', ' ')})"


def words(normalized: str) -> str:
    return f"list_filter(string_split({normalized}, ' '), lambda w: w <> '')"


def in_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def stems(normalized: str, stopwords=()) -> str:
    """Stemmed words longer than a letter, without stemmed stop words."""
    stemmed = f"list_transform({words(normalized)}, lambda w: substring(w, 1, 5))"
    kept = f"list_filter({stemmed}, lambda w: length(w) > 1)"
    if stopwords:
        stops = in_list(text.stemmed_stopwords(stopwords))
        kept = f"list_filter({kept}, lambda w: w NOT IN {stops})"
    return kept


def word_counts(source: str, id_col: str, high: int, text_col: str = "text", extra: str = "",
                stopwords=()) -> str:
    """Body of (id, extra, term, tf) of word n-grams."""
    grams = "t" if high == 1 else (
        "list_concat(t, list_transform(range(1, length(t)), lambda i: t[i] || ' ' || t[i + 1]))")
    more = f", {extra}" if extra else ""
    return f"""
      SELECT {id_col}{more}, term, count(*) AS tf FROM (
        SELECT {id_col}{more}, unnest({grams}) AS term FROM (
          SELECT {id_col}{more}, {stems(norm(text_col), stopwords)} AS t FROM {source}))
      GROUP BY ALL"""


def char_counts(source: str, id_col: str, low: int, high: int, text_col: str = "text") -> str:
    """Body of (id, term, tf) of character n-grams of padded words."""
    parts = " UNION ALL ".join(
        f"SELECT {id_col}, n, unnest(list_transform(range(1, length(p) - {size - 2}), "
        f"lambda i: substring(p, i, {size}))) AS term FROM wl" for size in range(low, high + 1))
    return f"""
      SELECT {id_col}, term, sum(n)::BIGINT AS tf FROM (
        WITH wl AS (SELECT {id_col}, ' ' || w || ' ' AS p, count(*) AS n FROM (
          SELECT {id_col}, unnest({words(norm(text_col))}) AS w FROM {source}) GROUP BY ALL)
        {parts}) GROUP BY ALL"""


def idf(n: str = "(SELECT count(*) FROM documents)") -> str:
    return f"ln((1.0 + {n}) / (1.0 + df)) + 1.0"


def tfidf(counts: str, vocabulary: str, id_col: str, extra: str = "") -> str:
    """Body of (id, extra, term, weight) from names of count and vocabulary tables."""
    more = f", {extra}" if extra else ""
    return f"""
      SELECT {id_col}{more}, term, x / sqrt(sum(x * x) OVER (PARTITION BY {id_col})) AS weight
      FROM (SELECT {id_col}{more}, c.term, (1.0 + ln(tf)) * idf AS x
            FROM {counts} c JOIN {vocabulary} v ON c.term = v.term)"""


LABELLED_SQL = """
  SELECT doc_id, text, CASE WHEN lang = 'es' THEN 'other' ELSE lang || ' > ' ||
    CASE WHEN substring(source, 4, 2)::INT < 10 THEN 'a' ELSE 'b' END END AS label
  FROM documents"""


def nb_ctes(high: int = 1, alpha: float = 0.001) -> str:
    """CTEs lab, cnt, voc, vec, tot, cls, nz: naive Bayes on stemmed words of documents."""
    return f"""
  lab AS ({LABELLED_SQL}),
  cnt AS ({word_counts('lab', 'doc_id', high, extra='label')}),
  voc AS (SELECT *, {idf()} AS idf FROM (SELECT term, count(*) AS df FROM cnt GROUP BY term)),
  vec AS ({tfidf('cnt', 'voc', 'doc_id', 'label')}),
  tot AS (SELECT label, term, sum(weight) AS t FROM vec GROUP BY ALL),
  cls AS (SELECT DISTINCT label FROM lab),
  nz AS (SELECT cls.label, ln(coalesce(sum(t), 0) + {alpha} * (SELECT count(*) FROM voc)) AS z
         FROM cls LEFT JOIN tot ON cls.label = tot.label GROUP BY cls.label)"""


def nb_scores(source: str, id_col: str, high: int = 1, alpha: float = 0.001,
              text_col: str = "text") -> str:
    """CTEs qc, qv, qs, qp: class probabilities of texts under the model of ``nb_ctes``.

    A class that never saw a term gives it ln(alpha) - z; seen terms add the difference.
    """
    return f"""
  qc AS ({word_counts(source, id_col, high, text_col)}),
  qv AS ({tfidf('qc', 'voc', id_col)}),
  qs AS (SELECT i.{id_col}, cls.label, ln(1.0 / (SELECT count(*) FROM cls))
           + coalesce(m.s, 0) * (ln({alpha}) - nz.z) + coalesce(k.s, 0) AS z
         FROM (SELECT {id_col} FROM {source}) i CROSS JOIN cls JOIN nz ON nz.label = cls.label
         LEFT JOIN (SELECT {id_col}, sum(weight) AS s FROM qv GROUP BY ALL) m
           ON m.{id_col} = i.{id_col}
         LEFT JOIN (SELECT {id_col}, label, sum(weight * (ln(t + {alpha}) - ln({alpha}))) AS s
                    FROM qv JOIN tot ON qv.term = tot.term GROUP BY ALL) k
           ON k.{id_col} = i.{id_col} AND k.label = cls.label),
  qp AS (SELECT {id_col}, label, split_part(label, ' > ', 1) AS general,
           nullif(split_part(label, ' > ', 2), '') AS subtopic,
           e / sum(e) OVER (PARTITION BY {id_col}) AS p
         FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY {id_col})) AS e FROM qs))"""
