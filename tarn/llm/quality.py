"""Line-first cleaning and document rejection, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import SPACES, WORD, documents, words

SYMBOLS = "#*$%&|<>"
#: What a line may end with.
ENDS = ".!?:;\"')]…。»”"
#: Stock phrases of web pages in English, German, French and Spanish, in lower case, as text to be found within a
#: line; licence notes are left alone. Fixed values; LineRules takes others.
PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "accept cookies", "enable javascript",
    "javascript is disabled", "click here", "read more", "sign in", "log in", "sign up", "subscribe to our", "share this", "back to top", "skip to content", "powered by",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "verwendung von cookies", "cookies akzeptieren", "javascript ist deaktiviert", "hier klicken",
    "weiterlesen", "jetzt anmelden", "newsletter abonnieren", "nach oben", "zum inhalt springen",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "utilisation de cookies", "accepter les cookies", "javascript est désactivé", "cliquez ici",
    "lire la suite", "se connecter", "abonnez-vous", "haut de page", "aller au contenu",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "uso de cookies", "aceptar cookies", "javascript está desactivado", "haga clic aquí",
    "leer más", "iniciar sesión", "suscríbase", "volver arriba", "saltar al contenido",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules; shares are of a line's words, loss is of a document's characters in words."""

    min_words: int = 10
    max_repeated: int = 20
    noisy_share: float = 0.3
    menu_share: float = 0.2
    menu_marks: int = 3
    short_line: int = 4
    boilerplate_words: int = 30
    max_loss: float = 0.5
    phrases: tuple[str, ...] = PHRASES


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def measured(line: Column) -> Column:
    """A line with the counts that the rules read, each counted once."""
    end = F.right(F.rtrim(F.translate(line, SPACES, " " * len(SPACES))), F.lit(1))
    return F.struct(
        line.alias("text"), _count(line, WORD).alias("n"), _count(line, r"[!?#*$%&|<>~=_]{2,}").alias("noisy"), _count(line, r"[|»›•>]").alias("marks"),
        F.position(end, F.lit(ENDS)).alias("ended"), F.lower(line).alias("low"),
    )


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a measured line breaks the punctuation, the navigation or the boilerplate rule; lines without words never do.

    Punctuation: too many words carry runs of marks (word!!, word%%%), or the line doesn't end a sentence and is
    short or has no sentence end at all. Navigation: separators stand between many of the words. Boilerplate: a short
    line has a stock phrase.
    """
    n, marks = line["n"], line["marks"]
    noisy = line["noisy"] > n * rules.noisy_share
    open_ended = (line["ended"] == 0) & ((n < rules.short_line) | ~line["text"].rlike(r"[.!?]"))
    menu = (marks >= rules.menu_marks) & (marks > n * rules.menu_share)
    stock = (n <= rules.boilerplate_words) & reduce(lambda a, b: a | b, (line["low"].contains(p) for p in rules.phrases), F.lit(False))
    return (n > 0) & (noisy | open_ended | menu | stock)


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Judge each line, drop those that fail, and reject documents that lose too much.

    Returns id, the counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), base_failed, kept,
    n_lines, n_removed_lines and cleaned (the text without the lines that failed); with `carry` also doc, the row.

    A document fails at the base if it has fewer than `min_words` words, or if more than `max_repeated` percent of
    them lie in five-word windows that occur twice. It is kept if it passes that and its remaining lines hold at
    least 1 - `max_loss` of its characters in words. Windows are compared by a 64-bit hash within one document; each
    document is one row, whatever its length, so nothing is shuffled.

    Null and empty texts have no words and fail. Repeated rows get equal results; null ids pass through; an empty
    table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = ["doc"] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *([F.struct(*docs.columns).alias("doc")] if carry else [])).withColumn("w", words(F.col("text"))).withColumn("lines", F.transform(F.split("text", "\n"), measured))
    n = F.size("w")
    # Each word is hashed once; a window's hash comes of its words' hashes, by arrays that begin one word later each.
    each, count = F.col("words"), n - 4
    window = F.slice(each, 1, count)
    for k in range(1, 5):
        window = F.zip_with(window, F.slice(each, k + 1, count), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumn("words", F.transform("w", lambda x: F.xxhash64(x)))
    rows = rows.select(
        *more, "doc_id", "text", n.cast("long").alias("n_words"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        F.transform(F.filter("lines", lambda x: x["n"] > 0), lambda x: x["text"]).alias("full"),
        F.transform(F.filter("lines", lambda x: ~line_fails(x, rules)), lambda x: x["text"]).alias("good"), F.size("lines").alias("n_lines"),
        F.when(n > 5, window).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # Only documents with a window that comes twice are sorted.
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    rows = rows.withColumn("s", pairs)
    twice = F.filter("s", lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"]))
    rows = rows.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["p"])))
    covered = F.lit(5) + F.aggregate(F.sequence(F.lit(1), F.size("at") - 1), F.lit(0), lambda acc, i: acc + F.least(F.lit(5), F.get("at", i) - F.get("at", i - 1)))
    cleaned = F.array_join("good", "\n")
    rows = rows.select(
        *more, "doc_id", "n_words", "word_chars", "n_symbols", (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("at").isNotNull(), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_lines", (F.col("n_lines") - F.size("good")).alias("n_removed_lines"), cleaned.alias("cleaned"),
    )
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeated)
    left = F.length(F.translate("cleaned", SPACES, ""))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= F.col("word_chars") * (1 - rules.max_loss)))
    # A generator of one row: a filter on the result stays above it, instead of repeating all this below.
    return rows.select(F.inline_outer(F.array(F.struct(*rows.columns))))


def op5_line_first_rules(spark, sf_dir: str) -> DataFrame:
    out = clean_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LINE = {
    "n": r"len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))",
    "noisy": r"len(regexp_extract_all(x, '[!?#*$%&|<>~=_]{2,}'))",
    "marks": r"len(regexp_extract_all(x, '[|»›•>]'))",
    "ends": r"""regexp_matches(x, '[.!?:;"'')\]…。»”][\x20\x09-\x0D]*$')""",
}


def decided_sql(table: str) -> str:
    """SQL for every column of the query over a table of documents."""
    stock = "|".join(PHRASES).replace("'", "''")
    n, noisy, marks, ends = (_LINE[k] for k in ("n", "noisy", "marks", "ends"))
    fails = f"({n} > 0 AND ({noisy} > {n} * 0.3 OR (NOT {ends} AND ({n} < 4 OR NOT regexp_matches(x, '[.!?]'))) OR ({marks} >= 3 AND {marks} > {n} * 0.2) OR ({n} <= 30 AND regexp_matches(lower(x), '{stock}'))))"
    bare = lambda x: f"length(translate({x}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))"
    return rf"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {bare('cleaned')} >= word_chars * 0.5 AS kept
FROM (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({bare('t')} AS BIGINT) AS word_chars,
           CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
           CAST(len(fl) - len(list_distinct(fl)) AS BIGINT) AS n_dup_lines,
           CAST(len(list_distinct(flatten(list_transform(list_filter(range(1, len(w) - 3), lambda i: win[i] IN (SELECT unnest(twice))), lambda i: range(i, i + 5))))) AS BIGINT) AS n_repeat_words,
           array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT {fails}), chr(10)) AS cleaned
    FROM (
      SELECT *, list_transform(list_filter(map_entries(hist), lambda e: e.value > 1), lambda e: e.key) AS twice
      FROM (
        SELECT *, list_aggregate(win, 'histogram') AS hist
        FROM (
          SELECT *, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS win
          FROM (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS fl
            FROM {table}))))))
"""


OP5_SQL = decided_sql("documents").replace("win[i] IN (SELECT unnest(twice))", "list_contains(twice, win[i])")
