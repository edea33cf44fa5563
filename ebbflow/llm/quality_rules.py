"""Quality rules by distribution divergence, in DataFrame functions alone.

Each text gives two histograms: its characters by class and its words over a
language's common words and "any other". Their Jensen-Shannon distances
(base 2, 0 to 1) to each language reference are compared, and the nearest
reference counts, whatever language a row is said to be in. The default
references are approximate shares typed in by hand from general knowledge of the
four languages, not measured on a corpus; ``Rules`` takes others. Short texts have noisy histograms, so either test applies
only from a minimal length on.

Everything is a function of one row: no shuffle, no Python worker. Windows of
eight words are compared by 64-bit hashes within one text, where a chance
collision has a probability below 2^-30 even at 100,000 words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.shared import WORD_PATTERN

SPACE, SYMBOL = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
#: Classes in the order in which they are taken out of the text; what is left is "other".
CHARACTER_CLASSES = (
    ("lower", r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+"),
    ("space", SPACE + "+"),
    ("upper", r"\p{Lu}+"),
    ("digit", "[0-9]+"),
    ("point", r"[.,;:!?'\x22()-]+"),
    ("symbol", SYMBOL + "+"),
)
#: Typical shares of the classes above and of "other" in edited prose.
_CHARACTERS = {
    "en": (0.7930, 0.1650, 0.0160, 0.0020, 0.0225, 0.0005, 0.0010),
    "de": (0.8055, 0.1530, 0.0160, 0.0020, 0.0220, 0.0005, 0.0010),
    "fr": (0.7925, 0.1650, 0.0160, 0.0020, 0.0230, 0.0005, 0.0010),
    "es": (0.7975, 0.1605, 0.0150, 0.0020, 0.0235, 0.0005, 0.0010),
}
#: Typical shares of common words among all words.
_WORDS = {
    "en": "the .062 of .036 and .026 to .020 a .017 in .014 is .012 that .010 it .009 for .009 was .008 on .007 with .007 as .006 by .006 be .006",
    "de": "der .062 die .037 und .026 in .020 den .016 von .014 zu .011 das .011 mit .010 sich .008 des .008 auf .007 für .007 ist .006 im .006 dem .005",
    "fr": "de .062 la .038 le .025 et .021 les .017 des .014 en .012 un .011 du .009 une .008 que .008 pour .007 est .007 dans .006 qui .006 par .005",
    "es": "de .062 la .036 que .025 el .020 en .017 y .014 los .012 se .010 las .010 del .010 un .008 por .008 con .007 no .007 una .006 su .006",
}


def _word_shares(line: str) -> dict[str, float]:
    parts = line.split()
    return {w: float(x) for w, x in zip(parts[::2], parts[1::2], strict=True)}


@dataclass(frozen=True)
class Rules:
    """References by language and limits. A reference has shares of the character classes and of common words."""

    characters: dict[str, tuple[float, ...]] = field(default_factory=lambda: dict(_CHARACTERS))
    words: dict[str, dict[str, float]] = field(default_factory=lambda: {k: _word_shares(v) for k, v in _WORDS.items()})
    max_character_distance: float = 0.25
    max_word_distance: float = 0.3
    min_characters: int = 400
    min_words: int = 100


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), use).getItem(0)


def _distance(found: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares; 0 log 0 is 0."""

    def term(p, q):
        middle = (p + q) / 2
        side = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(F.lit(0.0))
        return (side(p) + side(q)) / 2

    total = F.aggregate(F.zip_with(found, reference, term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _reals(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _repeated(words: Column) -> Column:
    """Words that lie in an 8-word window which occurs twice or more in the text."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 7), lambda i: F.xxhash64(F.slice(words, i, 8)))

    def covered(h):
        sorted_windows = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def starts(s):
            last = F.size(s) - 1
            near = lambda i, x: F.coalesce(F.get(s, i).getField("h") == x.getField("h"), F.lit(False))
            twice = F.filter(s, lambda x, i: ((i > 0) & near(i - 1, x)) | ((i < last) & near(i + 1, x)))
            return F.array_sort(F.transform(twice, lambda x: x.getField("at")))

        def total(p):
            steps = F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.least(F.lit(8), F.get(p, i + 1) - x)).otherwise(F.lit(8)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return _bind(_bind(sorted_windows, starts), total)

    found = _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) >= 9, found).otherwise(F.lit(0)).cast("long")


def quality_rules(docs: DataFrame, rules: Rules | None = None, lang: str | None = "lang") -> DataFrame:
    """Counts and verdict of every row of ``docs(doc_id, text[, lang])``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, char_distance, word_distance, kept``. Null and
    empty texts have no words and fail. A distance is null where the text is
    too short for it. A text whose declared language has no reference is not
    judged by distances. Null and repeated ids are kept, each row judged by
    itself; further columns are ignored; an empty table gives no rows.
    """
    rules = rules or Rules()
    declared = F.col(lang).cast("string") if lang and lang in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), declared.alias("declared"))
    rows = rows.withColumns(
        {
            "words": F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)),
            "lines": F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != ""),
            "chars_0": F.length("text"),
            "rest_0": F.col("text"),
        }
    )
    for k, (_, pattern) in enumerate(CHARACTER_CLASSES):
        rows = rows.withColumn(f"rest_{k + 1}", F.regexp_replace(f"rest_{k}", pattern, ""))
        rows = rows.withColumn(f"chars_{k + 1}", F.length(f"rest_{k + 1}"))
    last = len(CHARACTER_CLASSES)
    names = sorted({w for shares in rules.words.values() for w in shares})
    alpha = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    rows = rows.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": (F.col(f"chars_{last - 1}") - F.col(f"chars_{last}")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": _repeated(F.col("words")),
            "classes": F.array(*[(F.col(f"chars_{k}") - F.col(f"chars_{k + 1}")).cast("double") for k in range(last)], F.col(f"chars_{last}").cast("double")),
            "seen": _bind(alpha, lambda a: F.struct(F.size(a).alias("n"), F.concat(F.lit(" "), F.array_join(F.filter(a, lambda w: w.isin(names)), "  "), F.lit(" ")).alias("common"))),
        }
    )
    rows = rows.withColumn("common_chars", F.length("seen.common"))
    for k, word in enumerate(names):
        found = F.col("common_chars") - F.length(F.replace(F.col("seen.common"), F.lit(f" {word} "), F.lit("")))
        rows = rows.withColumn(f"w_{k}", found / (len(word) + 2))
    to_characters, to_words = [], []
    for language in sorted(rules.words):
        to_characters.append(_distance(F.transform("classes", lambda x: x / F.col("chars_0")), _reals(rules.characters[language])))
        shares = rules.words[language]
        counts = F.array(*[F.col(f"w_{names.index(w)}") for w in shares])
        found = _bind(counts, lambda c: F.concat(c, F.array(F.col("seen.n") - F.aggregate(c, F.lit(0.0), lambda a, x: a + x))))
        to_words.append(_distance(F.transform(found, lambda x: x / F.col("seen.n")), _reals([*shares.values(), 1 - sum(shares.values())])))
    judged = F.col("declared").isNull() | F.col("declared").isin(sorted(rules.words))
    rows = rows.withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "char_distance": F.when(judged & (F.col("chars_0") >= rules.min_characters), F.round(F.array_min(F.array(*to_characters)), 6)),
            "word_distance": F.when(judged & (F.col("seen.n") >= rules.min_words), F.round(F.array_min(F.array(*to_words)), 6)),
        }
    )
    near = (F.coalesce("char_distance", F.lit(0.0)) <= rules.max_character_distance) & (
        F.coalesce("word_distance", F.lit(0.0)) <= rules.max_word_distance
    )
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance",
        (~F.col("base_failed") & near).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: Rules | None = None, lang: str | None = "lang") -> DataFrame:
    """Rows of ``docs``, all columns, that ``quality_rules`` keeps; ids need not be unique."""
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text", *([lang] if lang in docs.columns else []))
    # a filter that could sink below the projections would take a copy of all their expressions along
    judged = quality_rules(inside, rules, lang).withColumn("place", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("place") >= 0)).select("doc_id.*")


def rules_sql(rules: Rules | None = None, source: str = "documents") -> str:
    """DuckDB SQL for ``quality_rules``."""
    rules = rules or Rules()
    names = sorted({w for shares in rules.words.values() for w in shares})
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rest, columns = "text", []
    for name, pattern in CHARACTER_CLASSES:
        nxt = f"regexp_replace({rest}, {quote(pattern)}, '', 'g')"
        columns.append(f"(length({rest}) - length({nxt}))::DOUBLE AS c_{name}")
        rest = nxt
    columns.append(f"length({rest})::DOUBLE AS c_other")
    classes = [f"c_{name}" for name, _ in CHARACTER_CLASSES] + ["c_other"]

    def distance(found: list[str], shares: list[float]) -> str:
        parts = []
        for p, q in zip(found, shares, strict=True):
            q = repr(float(q))
            parts.append(
                f"((CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END) + "
                f"(CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END)) / 2"
            )
        return f"sqrt(greatest({' + '.join(parts)}, 0.0))"

    by_class = [distance([f"({c} / n_chars)" for c in classes], list(rules.characters[k])) for k in sorted(rules.words)]
    by_word = []
    for k in sorted(rules.words):
        shares = rules.words[k]
        found = [f"(w_{names.index(w)} / n_alpha)" for w in shares]
        left = "((n_alpha - (" + " + ".join(f"w_{names.index(w)}" for w in shares) + ")) / n_alpha)"
        by_word.append(distance([*found, left], [*shares.values(), 1 - sum(shares.values())]))
    counts = ", ".join(f"len(list_filter(alpha, lambda w: w = {quote(w)}))::DOUBLE AS w_{k}" for k, w in enumerate(names))
    judged = f"(lang IS NULL OR lang IN ({', '.join(map(quote, sorted(rules.words)))}))"
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM {source}
), parts AS (
  SELECT *, regexp_extract_all(text, '{WORD_PATTERN}') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD_PATTERN}')) AS lines,
    regexp_extract_all(lower(text), '\\p{{L}}+') AS alpha, length(text)::DOUBLE AS n_chars, {", ".join(columns)}
  FROM base
), windows AS (
  SELECT rid, i AS pos, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM parts WHERE len(words) >= 9)
), twice AS (
  SELECT rid, pos, lead(pos) OVER (PARTITION BY rid ORDER BY pos) AS nxt
  FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT rid, sum(least(8, coalesce(nxt - pos, 8)))::BIGINT AS n FROM twice GROUP BY rid
), counted AS (
  SELECT p.doc_id, p.lang, n_chars, len(alpha)::DOUBLE AS n_alpha, {", ".join(classes)}, {counts},
    len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, c_symbol::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM parts p LEFT JOIN repeated r USING (rid)
), measured AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN {judged} AND n_chars >= {rules.min_characters} THEN round(least({", ".join(by_class)}), 6) END AS char_distance,
    CASE WHEN {judged} AND n_alpha >= {rules.min_words} THEN round(least({", ".join(by_word)}), 6) END AS word_distance
  FROM counted
)
SELECT *, NOT base_failed AND coalesce(char_distance, 0) <= {rules.max_character_distance}
  AND coalesce(word_distance, 0) <= {rules.max_word_distance} AS kept
FROM measured
"""
