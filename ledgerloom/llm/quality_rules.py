"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: a line that looks like a menu, a wall of marks or a boilerplate notice is
removed, and the document is rejected when too many of its words went with such lines. A few whole-text
measures (word counts, repeated lines, repeated three-word windows) give hard limits beside it.

The result is a narrow projection of the input: no shuffle, one pass over the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Signs that end or divide sentences in many scripts.
SENTENCE_MARKS = r"[.!?…。！？։؟।:;]"
#: Separators of menus and bread crumbs.
MENU_MARKS = "|»›•·"
#: Phrases of notices that surround texts on the web, in English, German, French and Spanish. Fixed values.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "requires javascript",
    "lorem ipsum",
    "subscribe to our newsletter",
    "click here to",
    "log in to comment",
    "skip to content",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "cookie-richtlinie",
    "zum inhalt springen",
    "newsletter abonnieren",
    "tous droits réservés",
    "politique de confidentialité",
    "conditions d'utilisation",
    "mentions légales",
    "aller au contenu",
    "todos los derechos reservados",
    "política de privacidad",
    "política de cookies",
    "términos de uso",
    "aviso legal",
)
_WORD = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _count(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``; texts without any are only looked through."""
    listed = "[" + "".join("\\" + c if c in "|$*&" else c for c in chars) + "]"
    return F.when(text.rlike(listed), F.length(text) - F.length(F.translate(text, chars, ""))).otherwise(0)


def repeated_window_words(ws: Column) -> Column:
    """How many words lie in a three-word window that the text holds twice or more.

    Windows are sorted by a 64-bit hash, so equal ones are neighbours, and neighbours are compared word by word:
    O(n log n) for a text of n words.
    """
    hashes = F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    ordered = lambda t: F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def alike(x: Column, y: Column) -> Column:
        equal = (x["h"] == y["h"]) & (F.get(ws, x["i"]) == F.get(ws, y["i"])) & (F.get(ws, x["i"] + 1) == F.get(ws, y["i"] + 1)) & (F.get(ws, x["i"] + 2) == F.get(ws, y["i"] + 2))
        return F.coalesce(equal, F.lit(False))

    def starts(s: Column) -> Column:
        marked = F.transform(s, lambda x, j: F.when(alike(x, F.get(s, j - 1)) | alike(x, F.get(s, j + 1)), x["i"]))
        return F.filter(marked, lambda i: i.isNotNull())

    covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))
    return let(hashes, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(let(ordered(t), lambda s: covered(starts(s)))))


def failing_lines(text: Column, max_symbols: float, max_shouts: float, max_menu: float, fragment_words: int, notice_words: int) -> Column:
    """Per line of ``text`` a struct: the line, and whether it fails.

    A line fails if it has too many symbols or exclamation marks a word (punctuation), too many menu marks a word or is
    a short fragment without any sentence mark (navigation), or holds a boilerplate phrase and is no longer than notices
    are (prose may speak of a privacy policy). Blank lines do not fail.
    Rules that no line of a text can break are not evaluated line by line.
    """
    marks = "[" + "".join("\\" + c if c in "|$*&" else c for c in dict.fromkeys(SYMBOLS + MENU_MARKS + "!")) + "]"
    holds = lambda x: F.reduce(F.array(*[F.contains(x, F.lit(p)) for p in BOILERPLATE]), F.lit(False), lambda a, b: a | b)

    def judged(flags: Column) -> Column:
        def judge(line: Column) -> Column:
            n = F.regexp_count(line, F.lit(_WORD + "+"))
            marked = lambda k: (_count(line, SYMBOLS) > max_symbols * k) | (_count(line, "!") > max_shouts * k + 2) | (_count(line, MENU_MARKS) > max_menu * k)
            fails = (
                F.when(flags["marks"], let(n, lambda k: (k > 0) & marked(k))).otherwise(False)
                | (~line.rlike(SENTENCE_MARKS) & n.between(1, fragment_words))
                | F.when(flags["notice"], (n <= notice_words) & holds(F.lower(line))).otherwise(False)
            )
            return F.struct(line.alias("line"), fails.alias("fails"))

        return F.transform(F.split(text, "\n"), judge)

    return let(F.struct(text.rlike(marks).alias("marks"), let(F.lower(text), holds).alias("notice")), judged)


def clean_lines(
    docs: DataFrame,
    text_col: str = "text",
    *,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_lost: float = 0.5,
    max_symbols: float = 0.5,
    max_shouts: float = 0.5,
    max_menu: float = 0.3,
    fragment_words: int = 4,
    notice_words: int = 30,
) -> DataFrame:
    """Judge every document.

    Returns one row per input row: ``row`` (a struct of all input columns, so clashing names cannot meet),
    ``clean_text`` (the lines that stay), ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``n_lost_words``, ``base_failed`` and ``kept``.

    Null texts count as empty: no words, so ``base_failed``; ``clean_text`` stays null for them. Repeated rows are judged
    each by itself. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    has_word = lambda line: line.rlike(_WORD)
    judged = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("_text")).select(
        "row",
        "_text",
        let(
            words(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_window_words(w).cast("long").alias("n_repeat_words"),
            ),
        ).alias("_w"),
        let(F.filter(F.split(text, "\n"), has_word), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(
            failing_lines(text, max_symbols, max_shouts, max_menu, fragment_words, notice_words),
            lambda v: F.struct(
                F.array_join(F.transform(F.filter(v, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("text"),
                F.aggregate(F.filter(v, lambda x: x["fails"]), F.lit(0).cast("long"), lambda a, x: a + F.regexp_count(x["line"], F.lit(_WORD + "+"))).alias("lost"),
            ),
        ).alias("_v"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
    )
    n = F.col("_w.n_words")
    failed = (n < min_words) | (100 * F.col("_w.n_repeat_words") > max_repeat_percent * n)
    return judged.select(
        "row",
        F.when(F.col("_text").isNotNull(), F.col("_v.text")).alias("clean_text"),
        n.alias("n_words"),
        F.col("_w.word_chars").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        F.col("_v.lost").alias("n_lost_words"),
        failed.alias("base_failed"),
        (~failed & (F.col("_v.lost") <= max_lost * n)).alias("kept"),
    )


def quality_digest(docs: DataFrame) -> DataFrame:
    """The query's columns, from :func:`clean_lines`."""
    return clean_lines(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words"
    )


def rejected_removed(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Documents that pass, with the text of the lines that stay; the columns are the input's."""
    good = clean_lines(docs, text_col, **options).filter("kept")
    return good.select(*[(F.col("clean_text") if f.name == text_col else F.col("row")[f.name]).alias(f.name) for f in docs.schema])


#: DuckDB SQL for the query: the same rules, written for that engine.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         string_split(text, chr(10)) AS lines
  FROM d),
j AS (
  SELECT doc_id, text, ws, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines,
    list_transform(lines, lambda l: {'n': len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')), 'l': l}) AS ls
  FROM w),
v AS (
  SELECT *, list_sum(list_transform(ls, lambda s: CASE WHEN s.n > 0 AND (
        len(s.l) - len(regexp_replace(s.l, '[#*$%&|<>]', '', 'g')) > 0.5 * s.n
     OR len(s.l) - len(replace(s.l, '!', '')) > 0.5 * s.n + 2
     OR len(s.l) - len(regexp_replace(s.l, '[|»›•·]', '', 'g')) > 0.3 * s.n
     OR (s.n <= 4 AND NOT regexp_matches(s.l, '[.!?…。！？։؟।:;]'))
     OR (s.n <= 30 AND regexp_matches(lower(s.l), 'all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|(?:enable|requires) javascript|lorem ipsum|subscribe to our newsletter|click here to|log in to comment|skip to content|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|cookie-richtlinie|zum inhalt springen|newsletter abonnieren|tous droits réservés|politique de confidentialité|conditions d''utilisation|mentions légales|aller au contenu|todos los derechos reservados|política de (?:privacidad|cookies)|términos de uso|aviso legal'))
     ) THEN s.n ELSE 0 END)) AS lost
  FROM j),
g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g) WHERE c > 1)
  GROUP BY doc_id),
m AS (
  SELECT v.doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, lost::BIGINT AS n_lost_words
  FROM v LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost_words <= 0.5 * n_words AS kept, n_lost_words
FROM m
"""
