"""Benchmark decontamination by templates, in DataFrame operations only.

Canonical form: numbers in digits or words, units behind a number, and capitalised words become typed placeholders, all
else lower case.
Every window of WINDOW canonical words of a text is hashed, and where it has a capitalised word once more with those in
lower case. An item's windows are hashed with every choice of its capitalised words as placeholders, the others in
lower case. So a text's window meets an item's whatever case the item's words have in it, and a window that differs in
nothing but case and white space always does. A hit has its place in the text and in the item; hits on one diagonal (text place
minus item place) are one alignment. Within an alignment each slot value of the item stands for one value of the text
(slot consistency): the one that meets it at most places, on a tie the same value, else the first. Windows with another
value in that slot don't count, unless they are word for word the item's; so a re-parameterised question is caught and
a chance meeting of templates isn't. Capitalised words may differ where they are names: a word is one within a sentence
or behind a title, and then at the item's sentence starts too. Where a word that only begins sentences meets another
such word, the window doesn't count. A text holds an item if what counts covers at least COVER of the item's windows.

Slot words keep their value behind a mark of their type, so types are compared without a second pass over the text.

Defined results: null or empty texts and items hold nothing and match nothing; items of fewer than WINDOW words are
one window, matched by equal windows of their own length; texts that share a doc_id are judged each on its own, and the
result has the best of them; equal rows count once; repeated items are matched each; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcrawl.llm.common import table

WINDOW, COVER = 5, 0.75
#: Benchmark windows are broadcast up to so many rows (each of some 100 bytes), else joined by shuffle.
BROADCAST_ROWS = 200_000
#: START marks a capitalised word that begins a sentence; PAST sorts behind all marks.
NUMBER, UNIT, NAME, START, PAST = "①", "②", "③", "④", "⑤"
UNITS = "mm|cm|km|m|kg|g|mg|lb|lbs|oz|ml|l|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|kilometers?|kilometres?|grams?|kilograms?|pounds?|dollars?|euros?|usd|eur|percent|mph|kmh|degrees?|feet|foot|inch|inches|liters?|litres?"
#: Numbers in words, without "one", which is a pronoun as well.
NUMBER_WORDS = tuple("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())

_WORDS = f"[^\\p{{L}}\\p{{M}}\\p{{N}}{NUMBER}{UNIT}{NAME}{START}]+"


_MARK = f"[{NUMBER}{UNIT}{NAME}{START}]"
#: What may stand between a word and the next one of its sentence, and titles that end in a full stop.
_BETWEEN = "[\\s\\p{Z}\\p{Pd}\\p{Ps}\\p{Pe}\\p{Pi}\\p{Pf}\"'/*_]{1,8}"
_TITLES = "mr|mrs|ms|mx|dr|prof|st|sr|rev|hr|fr|sra|mme|mlle|capt|col|gen|lt|sgt|gov|sen|rep|hon"


def marked(text: Column) -> Column:
    """Lower-case text whose slot words begin with the mark of their type and keep their value (null: empty).

    The rules for numbers are tried only on texts with a digit.
    """
    x = F.coalesce(text, F.lit(""))
    x = F.when(x.rlike(_MARK), F.regexp_replace(x, _MARK, " ")).otherwise(x)
    number = F.regexp_replace(x, "(?<=[0-9])[.,](?=[0-9])", "")
    number = F.regexp_replace(number, f"(?<![\\p{{L}}\\p{{N}}])([0-9]+)[ ]?((?i:{UNITS}))(?![\\p{{L}}\\p{{N}}])", f"{NUMBER}$1 {UNIT}$2")
    number = F.regexp_replace(number, f"(?<![\\p{{L}}\\p{{N}}{NUMBER}])(?=[0-9])", NUMBER)
    x = F.when(x.rlike("[0-9]"), number).otherwise(x)
    x = F.regexp_replace(x, f"(?<![\\p{{L}}\\p{{N}}])((?i:{'|'.join(NUMBER_WORDS)}))[ ]((?i:{UNITS}))(?![\\p{{L}}\\p{{N}}])", f"$1 {UNIT}$2")
    x = F.regexp_replace(x, "(\\p{Lu}\\p{Ll})(?<![\\p{L}\\p{M}\\p{N}]..)", f"{START}$1")
    within = f"{START}(?:(?<=[\\p{{L}}\\p{{M}}\\p{{N}},;]{_BETWEEN}.)|(?<=(?<![\\p{{L}}\\p{{M}}\\p{{Nd}}])(?i:{_TITLES})[.]\\s{{0,8}}.))"
    return F.lower(F.regexp_replace(x, within, NAME))


def _named(word: Column) -> Column:
    return (word >= NAME) & (word < PAST)


def _bare(word: Column) -> Column:
    """A marked name without its mark."""
    return F.substr(word, F.lit(2))


def _numbered(word: Column) -> Column:
    """A marked word; a number in words gets the mark of numbers."""
    return F.when(word.isin(*NUMBER_WORDS), F.concat(F.lit(NUMBER), word)).when(word.isin(*[m + w for m in (NAME, START) for w in NUMBER_WORDS]), F.concat(F.lit(NUMBER), _bare(word))).otherwise(word)


def _canonical(word: Column) -> Column:
    """The hash of the canonical form of a marked word, numbers in words among them."""
    slot = F.when(word < UNIT, F.xxhash64(F.lit(NUMBER))).when(word < NAME, F.xxhash64(F.lit(UNIT))).otherwise(F.xxhash64(F.lit(NAME)))
    in_words = word.isin(*NUMBER_WORDS, *[m + w for m in (NAME, START) for w in NUMBER_WORDS])
    return F.when(in_words, F.xxhash64(F.lit(NUMBER))).when((word >= NUMBER) & (word < PAST), slot).otherwise(F.xxhash64(word))


def _uncased(word: Column) -> Column:
    """The same, with names in lower case."""
    return F.when(_named(word) & ~_bare(word).isin(*NUMBER_WORDS), F.xxhash64(_bare(word))).otherwise(_canonical(word))


def _windows(h: Column, size: int = WINDOW) -> Column:
    """The hash of each run of `size` word hashes, in order; none if there are fewer."""
    return F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[h[i + k] for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, size (words in a window), n_windows, item_pos, window (hash), item_words (the window's).

    A window comes once for each choice of its capitalised words as names. One that begins a sentence and also stands
    within one is marked as a name there, too.
    """
    words = benchmark.select("item_id", F.transform(F.filter(F.split(marked(F.col("text")), _WORDS), lambda w: w != ""), _numbered).alias("w")).where(F.size("w") > 0)
    known = words.withColumn("names", F.filter("w", lambda w: (w >= NAME) & (w < START)))
    as_name = lambda w: F.concat(F.lit(NAME), _bare(w))
    decided = known.select("item_id", F.transform("w", lambda w: F.when((w >= START) & (w < PAST) & F.array_contains(F.col("names"), as_name(w)), as_name(w)).otherwise(w)).alias("w"))
    sized = decided.withColumn("size", F.least(F.size("w"), F.lit(WINDOW))).withColumn("n_windows", F.size("w") - F.col("size") + 1)
    placed = sized.select("item_id", "size", "n_windows", "w", F.explode(F.sequence(F.lit(0), F.col("n_windows") - 1)).alias("item_pos"))
    flat = placed.select("item_id", "size", "n_windows", "item_pos", F.slice("w", F.col("item_pos") + 1, F.col("size")).alias("item_words"))
    # Bit k of a choice: word k is a name.
    chosen = flat.withColumn("choice", F.explode(F.sequence(F.lit(0), F.lit((1 << WINDOW) - 1))))
    bits = [F.col("choice").bitwiseAND(F.lit(1 << k)) != 0 for k in range(WINDOW)]
    word = [F.get("item_words", F.lit(k)) for k in range(WINDOW)]
    for k in range(WINDOW):
        chosen = chosen.where(~bits[k] | F.coalesce(_named(word[k]), F.lit(False)))
    hashes = [F.when(bits[k], _canonical(word[k])).otherwise(_uncased(word[k])) for k in range(WINDOW)]
    window = F.xxhash64(*hashes)
    for size in range(1, WINDOW):
        window = F.when(F.col("size") == size, F.xxhash64(*hashes[:size])).otherwise(window)
    return chosen.select("item_id", "size", "n_windows", "item_pos", window.alias("window"), "item_words").dropDuplicates(["item_id", "item_pos", "window"])


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Equal windows: doc_id, row (a hash of the text), doc_pos, doc_words, and the columns of items.

    One pass over the texts: windows of all sizes that items have stand one after the other in one array, and behind
    them in the same order those with names in lower case (null where that changes nothing). Items are broadcast if
    they are few; else both sides are shuffled by window, of the texts no more than the window's own words, and
    adaptive execution splits a window that very many texts have.
    """
    few = items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sizes = [WINDOW, *sorted(r[0] for r in items.where(F.col("size") < WINDOW).select("size").distinct().collect())]
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), F.split(marked(F.col("text")), _WORDS).alias("w"))
    words = texts.select("doc_id", "row", "w", F.transform("w", _canonical).alias("h"), F.transform("w", _uncased).alias("u"))
    both = words.select("doc_id", "row", "w", F.concat(*[_windows(F.col("h"), size) for size in sizes]).alias("a"), F.concat(*[_windows(F.col("u"), size) for size in sizes]).alias("b"))
    # The array is a column of its own, so that the rows it becomes are joined in compiled code and don't copy w; outer,
    # as Spark else asks for the array's size first and works it out twice.
    listed = both.select("doc_id", "row", "w", F.size("a").alias("total"), F.concat("a", F.zip_with("a", "b", lambda a, b: F.nullif(b, a))).alias("all"))
    windows = listed.select("doc_id", "row", "w", "total", F.posexplode_outer("all").alias("at", "window")).where(F.col("window").isNotNull())
    n, at = F.size("w"), F.col("at") % F.col("total")

    def placed(rows: DataFrame, of_size) -> DataFrame:
        """rows with doc_pos; of_size(size, first place of its windows, first place behind them) tells a row's own size."""
        place, before = at, F.lit(0)
        for size in sizes:
            after = before + F.greatest(n - size + 1, F.lit(0))
            place = F.when(of_size(size, before, after), at - before).otherwise(place)
            before = after
        return rows.withColumn("doc_pos", place)

    if few:
        found = placed(windows.join(F.broadcast(items), "window"), lambda size, lo, hi: F.col("size") == size)
        found = found.withColumn("doc_words", F.slice("w", F.col("doc_pos") + 1, F.col("size")))
    else:
        slim = placed(windows, lambda size, lo, hi: (at >= lo) & (at < hi))
        own = F.lit(WINDOW)
        before = F.lit(0)
        for size in sizes:
            after = before + F.greatest(n - size + 1, F.lit(0))
            own = F.when((at >= before) & (at < after), F.lit(size)).otherwise(own)
            before = after
        slim = slim.select("doc_id", "row", "window", "doc_pos", own.alias("size"), F.slice("w", F.col("doc_pos") + 1, own).alias("doc_words"))
        found = slim.join(items, ["window", "size"])
    return found.select("doc_id", "row", "doc_pos", F.transform("doc_words", _numbered).alias("doc_words"), "item_id", "n_windows", "item_pos", "item_words")


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once, however often a lambda in it asks."""
    return F.transform(F.array(value), then)[0]


def _bound(slots: Column) -> Column:
    """Of distinct slots (place, own, met) the pairs (own, met) that hold: of what meets a value of the item, that at most places."""
    pairs = F.array_distinct(F.transform(slots, lambda s: F.struct(s["own"].alias("own"), s["met"].alias("met"))))

    def ranked(p: Column) -> Column:
        places = F.transform(F.filter(slots, lambda s: (s["own"] == p["own"]) & (s["met"] == p["met"])), lambda s: s["place"])
        return F.struct(p["own"].alias("own"), (-F.size(places)).alias("few"), (p["own"] != p["met"]).alias("other"), F.array_min(places).alias("first"), p["met"].alias("met"))

    # On a tie the value itself holds, else what stands first.
    return F.when(F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["own"]))), pairs).otherwise(
        _let(F.transform(pairs, ranked), lambda all_: F.transform(F.filter(all_, lambda x: ~F.exists(all_, lambda y: (y["own"] == x["own"]) & (y < x))), lambda x: F.struct(x["own"].alias("own"), x["met"].alias("met"))))
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, n_windows, matched, coverage, same_values: the texts that hold an item, and how."""
    rows = _holding(docs, benchmark, cover)
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "same_values")).alias("best"), F.first("n_windows").alias("n_windows"))
    return best.select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), "best.matched", F.round(F.col("best.matched") / F.col("n_windows"), 6).alias("coverage"), "best.same_values")


def _holding(docs: DataFrame, benchmark: DataFrame, cover: float) -> DataFrame:
    """The same for each text: doc_id, row, item_id, n_windows, matched, same_values."""
    found = hits(docs, item_windows(benchmark)).withColumn("diagonal", F.col("doc_pos") - F.col("item_pos"))
    key = ["doc_id", "row", "item_id", "diagonal"]
    # A slot word of the item, its place, and what stands in its place; both with the mark of the type, names with NAME.
    as_name = lambda w: F.concat(F.lit(NAME), F.when(_named(w), _bare(w)).otherwise(w))
    begins = lambda w: (w >= START) & (w < PAST)
    words = F.transform(F.arrays_zip("item_words", "doc_words"), lambda p, k: F.struct((F.col("item_pos") + k).alias("place"), p["item_words"].alias("own"), p["doc_words"].alias("met")))
    marks = F.filter(words, lambda p: (p["own"] >= NUMBER) & (p["own"] < PAST))
    name = lambda p: F.struct(p["place"].alias("place"), as_name(p["own"]).alias("own"), as_name(p["met"]).alias("met"))
    slots = F.transform(marks, lambda p: F.when(_named(p["own"]), name(p)).otherwise(p))
    # Words that only begin sentences aren't known to be names: two such words have to be the same. (No filter, as Spark
    # would make it a condition of the join, which then isn't compiled.)
    known = F.forall(words, lambda p: ~(begins(p["own"]) & begins(p["met"])) | (p["own"] == p["met"]))
    # One row an alignment: on a diagonal an item's window meets one place, so the lists are as long as an item at most.
    aligned = found.groupBy(*key).agg(F.first("n_windows").alias("n_windows"), F.collect_list(F.when(known, F.struct("item_pos", slots.alias("slots")))).alias("windows"))
    verbatim = lambda slots: F.forall(slots, lambda s: s["own"] == s["met"])
    holds = lambda w, bound: verbatim(w["slots"]) | F.forall(w["slots"], lambda s: F.array_contains(bound, F.struct(s["own"].alias("own"), s["met"].alias("met"))))
    left = _let(F.array_distinct(F.flatten("windows.slots")), lambda slots: _let(_bound(slots), lambda bound: F.filter("windows", lambda w: holds(w, bound))))
    per = aligned.select("doc_id", "row", "item_id", "n_windows", F.explode(left).alias("window")).groupBy("doc_id", "row", "item_id").agg(F.first("n_windows").alias("n_windows"), F.countDistinct("window.item_pos").cast("long").alias("matched"), F.min(verbatim(F.col("window.slots"))).alias("same_values"))
    return per.where(F.col("matched") >= F.lit(cover) * F.col("n_windows"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that hold no item, each row judged by its own text."""
    bad = _holding(docs, benchmark, COVER).select(F.col("doc_id").alias("bad_id"), F.col("row").alias("bad_row")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_row")), "left_anti").select(*docs.columns)


QUERIES = {"op6_decontaminate": op6_decontaminate}
SQL: dict[str, str] = {}
