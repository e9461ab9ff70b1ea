"""Text analytics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcrawl.functions.fixed import BLOG, DOCUMENTATION, LANGUAGE_WORDS, NEWS, PRODUCT, STOP_WORDS


def words(text: Column) -> Column:
    """Runs of characters that aren't ASCII white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\r\\f\\x0B]+"), F.lit(0))


def letters(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(\\p{L}+)"), F.lit(1))


def sentence_count(text: Column) -> Column:
    """Stops followed by white space or the end; 1 at least for any text."""
    n = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[.!?]+(\\s|$)"))
    return F.when(F.length(F.trim(text)) > 0, F.greatest(n, F.lit(1))).otherwise(0)


def paragraph_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\\n\\n"), lambda p: F.length(F.trim(F.replace(p, F.lit("\n"), F.lit("")))) > 0))


def syllables(text: Column) -> Column:
    """Groups of vowels."""
    return _syllables(F.lower(F.coalesce(text, F.lit(""))))


def _syllables(lower: Column) -> Column:
    return F.regexp_count(lower, F.lit("[aeiouyáàâäéèêëíîïóôöúùûü]+"))


def unique_ratio(text: Column) -> Column:
    return _unique_ratio(words(F.lower(text)))


def _unique_ratio(w: Column) -> Column:
    return F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0)


def _per(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def readability(text: Column) -> dict[str, Column]:
    """Flesch reading ease, Flesch-Kincaid grade, automated readability index; 0 without words."""
    return readability_of(F.size(words(text)), sentence_count(text), syllables(text), characters(text))


def characters(text: Column) -> Column:
    """Letters and digits."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\p{L}\\p{N}]+", ""))


def readability_of(w: Column, s: Column, y: Column, c: Column) -> dict[str, Column]:
    """The same from counts: words, sentences, syllables, letters and digits."""
    any_word = w > 0
    ease = F.lit(206.835) - F.lit(1.015) * _per(w, s) - F.lit(84.6) * _per(y, w)
    grade = F.lit(0.39) * _per(w, s) + F.lit(11.8) * _per(y, w) - F.lit(15.59)
    ari = F.lit(4.71) * _per(c, w) + F.lit(0.5) * _per(w, s) - F.lit(21.43)
    return {"flesch_reading_ease": F.when(any_word, ease).otherwise(0.0), "flesch_kincaid_grade": F.when(any_word, grade).otherwise(0.0), "automated_readability_index": F.when(any_word, ari).otherwise(0.0)}


def reading_minutes(text: Column) -> Column:
    return F.size(words(text)) / F.lit(200.0)


def quality(n_words: Column, n_paragraphs: Column, n_sentences: Column, ease: Column, title: Column, description: Column, ratio: Column) -> Column:
    """0 to 100: length, structure, readability, metadata and variety."""
    x = F.when(n_words >= 300, 25).when(n_words >= 150, 15).when(n_words >= 50, 10).otherwise(0)
    x += F.when(n_paragraphs >= 3, 10).otherwise(0) + F.when(n_sentences >= 5, 10).otherwise(0)
    x += F.when(ease.between(60, 80), 20).when(ease.between(40, 90), 15).when(ease > 0, 10).otherwise(0)
    x += F.when(F.length(F.coalesce(title, F.lit(""))) > 10, 8).otherwise(0) + F.when(F.length(F.coalesce(description, F.lit(""))) > 20, 7).otherwise(0)
    return F.least(F.lit(100.0), x + F.least(F.lit(20.0), F.lit(25.0) * ratio))


def _has(text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return found


def content_type(text: Column, title: Column) -> Column:
    return _content_type(F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(title, F.lit(""))))


def _content_type(body: Column, head: Column) -> Column:
    return F.when(_has(body, NEWS) | _has(head, NEWS), "news").when(_has(body, BLOG) | _has(head, BLOG), "blog").when(_has(body, PRODUCT), "product").when(_has(body, DOCUMENTATION) | _has(head, DOCUMENTATION), "documentation").otherwise("article")


def language(text: Column) -> Column:
    """The language most of whose frequent words occur, alphabetical order breaks ties; unknown without any."""
    return _language(words(F.lower(text)))


def _language(w: Column) -> Column:
    among = lambda own: lambda x: x.isin(*own)
    scores = [F.named_struct(F.lit("n"), F.size(F.filter(w, among(own))), F.lit("k"), F.lit(-k), F.lit("lang"), F.lit(lang)) for k, (lang, own) in enumerate(sorted(LANGUAGE_WORDS.items()))]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["lang"]).otherwise("unknown")


def keyword_candidates(text: Column) -> Column:
    """Lower-case words of four letters or more that are no stop words, in order."""
    return F.filter(letters(text), lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS))


def measured(d: DataFrame, text: str, title: str) -> DataFrame:
    """d with the measures of a text column, each computed once, in columns of their own (MEASURES).

    Columns that are used several times aren't cheap, so the optimiser leaves the projections apart.
    """
    t, low, w = F.col(text), F.col("_lower"), F.col("_list")
    d = d.withColumns({"_lower": F.lower(F.coalesce(t, F.lit(""))), "_head": F.lower(F.coalesce(F.col(title), F.lit("")))}).withColumn("_list", words(low))
    own = (F.size(w), sentence_count(t), paragraph_count(t), _syllables(low), characters(t), _unique_ratio(w), _language(w), _content_type(low, F.col("_head")))
    return d.withColumns(dict(zip(MEASURES, own, strict=True))).drop("_lower", "_head", "_list")


MEASURES = ("_words", "_sentences", "_paragraphs", "_syllables", "_characters", "_ratio", "_language", "_type")


def measures(text: Column, title: Column) -> dict[str, Column]:
    """The same as expressions."""
    own = (F.size(words(text)), sentence_count(text), paragraph_count(text), syllables(text), characters(text), unique_ratio(text), language(text), content_type(text, title))
    return dict(zip(MEASURES, own, strict=True))
