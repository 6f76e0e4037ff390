"""Text expressions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that retrieval and verification ignore.
RETRIEVAL_STOPWORDS = (
    "a all an and any are as at be by for from has have he her his if in into is it its no not of on or our she such than "
    "that the their them then there these they this to us was we were when where which who whom will with you your"
).split()
GROUNDING_STOPWORDS = (
    "above all also and answer any are below both can cannot each for from had has have here however into its less may more "
    "must not one only other others over per shall such that the their them then there these they this those three two under "
    "upon very was were what when where which while whom whose will with would your"
).split()


def words_of(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokenize(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case runs of a-z and 0-9 of two or more, without stopwords, as often as they occur."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    stop = words_of(stopwords or RETRIEVAL_STOPWORDS)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def content_tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    """The set of lower-case runs of three or more, without stopwords (none
    unless given: see GroundingConfig)."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}"), 0)
    return F.array_except(found, words_of(list(stopwords))) if stopwords else F.array_distinct(found)


def numbers(text: Column) -> Column:
    """The set of numbers as written."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b\d+(?:\.\d+)?\b"), 0))


def containment(claim: Column, evidence: Column) -> Column:
    """Share of the claim's tokens in the evidence; one shared token of several counts as none."""
    both = F.size(F.array_intersect(claim, evidence))
    n = F.size(claim)
    return F.when(n == 0, 0.0).when((both <= 1) & (n > 1), 0.0).otherwise(both / F.nullif(n, F.lit(0))).cast("double")


#: What Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def normalize_text(text: Column) -> Column:
    """Tabs to spaces, control characters out, runs of spaces squeezed, line ends and the whole trimmed."""
    t = F.regexp_replace(F.translate(text, "\t", " "), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    t = F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t)
    t = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(t, r"(?U)[\s&&[^\n]]+(?=\n)", "")).otherwise(t)
    return F.btrim(t, F.lit(WHITE))


def has_unicode_issues(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"[�﷐-﷯￾￿]")


def strip(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))


def clause_number(text: Column) -> Column:
    """Up to three dotted numbers, or a capital or small Roman numeral with a dot, at the start; else null."""
    t = strip(text)
    dotted = F.regexp_extract(t, r"^(\d{1,3}(?:\.\d{1,3}){0,2})\.?(?=\s|$)", 1)
    letter = F.regexp_extract(t, r"^([A-Z]|IV|IX|V?I{0,3})\.\s", 1)
    return F.when(dotted != "", dotted).when(letter != "", letter)


def shorten(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)


def excerpt(text: Column, limit: int) -> Column:
    """At most limit characters; a cut one loses trailing space and gains an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit))), F.lit("…"))).otherwise(text)


def count_cues(text: Column, cues: list[str]) -> Column:
    """How many of the cues occur."""
    return F.size(F.filter(words_of(cues), lambda c: text.contains(c)))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def markers(text: Column) -> Column:
    """Citation numbers [n] in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,2})\]"), 1), lambda m: m.cast("int")))


def without_markers(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\[\d{1,2}\]", ""), r"(?U)^[ *]+|[ *]+\z|^\s+|\s+\z", "")


def is_refusal(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return t.contains("do not contain this information") | t.contains("does not contain this information")


def citation_label(product: Column, filename: Column, document_id: Column, page_start: Column, page_end: Column, section: Column, clause_ids: Column) -> Column:
    """Product (or file, or id), pages, section and the first four clauses."""
    named = F.coalesce(F.nullif(product, F.lit("")), F.nullif(filename, F.lit("")), document_id)
    one = (page_end.isNull()) | (page_end == page_start)
    pages = F.when(page_start > 0, F.when(one, F.concat(F.lit("p. "), page_start)).otherwise(F.concat(F.lit("pp. "), page_start, F.lit("-"), page_end)))
    first = F.slice(F.coalesce(clause_ids, F.expr("cast(array() as array<string>)")), 1, 4)
    clauses = F.when(F.size(first) > 0, F.concat(F.lit("clauses "), F.array_join(first, ", ")))
    return F.concat_ws(" — ", named, pages, F.nullif(section, F.lit("")), clauses)
