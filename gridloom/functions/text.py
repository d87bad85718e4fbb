"""Text expressions: all are built-in column expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Stop words of the lexical index. Fixed values.
STOP_WORDS = (
    "a an and are as at be been by for from had has have he her his i if in is it its of on or s t that the their them they this to was were which who will with"
).split()

# Queries that ask how things are connected, and the numbers of a query. Fixed values.
CONNECTIVE = r"(?i)\b(links|connect|together|learned about)\b"
NUMBERS = r"\b(\d{1,4})(s?)\b"


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends (SQL trim knows blanks only)."""
    return F.regexp_replace(_column(x), r"(?U)^\s+|\s+$", "")


def text_of(x: Column | str) -> Column:
    """Null as empty."""
    return F.coalesce(_column(x), F.lit(""))


def page_id(x: Column | str) -> Column:
    """The id in a string of digits, blanks around it allowed; anything else, null too, raises an error."""
    s = strip(x)
    fail = F.raise_error(F.concat(F.lit("not a page id: "), F.coalesce(_column(x), F.lit("null")))).cast("bigint")
    return F.when(s.rlike("^[0-9]+$"), s.cast("bigint")).otherwise(fail)


def entry_text(title: Column | str, content: Column | str) -> Column:
    """Title, a blank line, content, without white space at both ends; content alone where there is no title."""
    name, body = text_of(title), text_of(content)
    return strip(F.when(name != "", F.concat(name, F.lit("\n\n"), body)).otherwise(body))


def sentences(x: Column | str) -> Column:
    """Pieces between white space that follows a full stop, exclamation or question mark; stripped, empty ones dropped. Null gives no piece."""
    parts = F.split(text_of(x), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def words(x: Column | str) -> Column:
    """Number of words between white space; 0 for null and blank."""
    s = strip(text_of(x))
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, r"(?U)\s+")))


def tokens(x: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits, without stop words, in order. Null gives none."""
    found = F.regexp_extract_all(F.lower(text_of(x)), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(found, lambda t: ~F.array_contains(stop, t))


def connective(x: Column | str) -> Column:
    return text_of(x).rlike(CONNECTIVE)


def number_groups(x: Column | str) -> Column:
    """The numbers of a query as arrays of alternatives: a decade such as 1820s stands for its ten years, any other number for itself."""
    low = F.lower(text_of(x))
    pattern = F.lit(NUMBERS)
    digits = F.regexp_extract_all(low, pattern, F.lit(1))
    plural = F.regexp_extract_all(low, pattern, F.lit(2))

    def group(d: Column, s: Column) -> Column:
        decade = (s == "s") & (F.length(d) == 4) & d.endswith("0")
        years = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (d.cast("int") + i).cast("string"))
        return F.when(decade, years).otherwise(F.array(d))

    return F.zip_with(digits, plural, group)


def chunk_spans(counts: Column, target: int) -> Column:
    """First and last sentence of each chunk, from the sentences' word counts.

    Sentences gather until they hold `target` words; a last sentence of at most half of that opens the next chunk
    again. What is left at the end is a chunk if it holds any word.
    """
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(0).alias("w"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        i, total = acc["i"], acc["w"] + w
        full, short = total >= target, w <= target // 2
        return F.struct(
            (i + 1).alias("i"),
            F.when(full, F.when(short, i).otherwise(i + 1)).otherwise(acc["s"]).alias("s"),
            F.when(full, F.when(short, w).otherwise(F.lit(0))).otherwise(total).alias("w"),
            F.when(full, F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), i.alias("e"))))).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["w"] > 0, F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), (acc["i"] - 1).alias("e"))))).otherwise(acc["out"])

    return F.aggregate(counts, start, step, finish)
