"""The domain functions under names for SQL text: temporary SQL functions, which the optimiser inlines as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loomcrawl.functions import html, text, urls


def _quality(content: Column, title: Column) -> Column:
    ease = text.readability(content)["flesch_reading_ease"]
    return text.quality(F.size(text.words(content)), text.paragraph_count(content), text.sentence_count(content), ease, title, F.lit(""), text.unique_ratio(content))


#: name: function of string columns, the names of its parameters
FUNCTIONS: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {
    "url_normalize": (urls.normalize, ("url",)),
    "url_domain": (urls.domain, ("url",)),
    "url_priority": (urls.priority, ("url",)),
    "url_hash": (urls.url_hash, ("url",)),
    "url_fuzzy_hash": (urls.fuzzy_hash, ("url",)),
    "hash_shard": (urls.hash_shard, ("domain",)),
    "page_title": (html.title, ("html",)),
    "page_text": (html.plain_text, ("html",)),
    "extract_links": (html.hrefs, ("html",)),
    "word_count": (lambda c: F.size(text.words(c)), ("content",)),
    "detect_language": (text.language, ("content",)),
    "classify_content": (text.content_type, ("content", "title")),
    "quality_score": (_quality, ("content", "title")),
}


def _lambdas(sql: str) -> str:
    """Catalyst writes a lambda as lambdafunction(body, variable), all variables by one name; SQL text wants variable -> body."""
    while (at := sql.find("lambdafunction(")) >= 0:
        start = at + len("lambdafunction(")
        depth, quoted, parts, i, begin = 1, "", [], start, start
        while depth:
            c = sql[i]
            if quoted:
                i += c == "\\"
                quoted = "" if c == quoted else quoted
            elif c in "'`":
                quoted = c
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            if not quoted and ((c == "," and depth == 1) or not depth):
                parts.append(sql[begin:i].strip())
                begin = i + 1
            i += 1
        if len(parts) != 2 or "lambdafunction(" in parts[0]:
            raise ValueError(f"a lambda of one variable and without another in it is wanted: {sql[at:i]}")
        sql = f"{sql[:at]}v -> {parts[0].replace(parts[1], 'v')}{sql[i:]}"
    return sql


def sql_of(spark: SparkSession, function: Callable[..., Column], names: tuple[str, ...]) -> tuple[str, str]:
    """The function's body as SQL text, and its type."""
    none = spark.range(0).select(*[F.lit("").alias(n) for n in names])
    made = none.select(function(*[F.col(n) for n in names]).alias("out"))
    plan = made._jdf.queryExecution().analyzed()
    body = _lambdas(plan.expressions().head().child().sql())
    return body, made.schema[0].dataType.simpleString()


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session's SQL; their names."""
    for name, (function, names) in FUNCTIONS.items():
        body, kind = sql_of(spark, function, names)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{n} STRING' for n in names)}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
