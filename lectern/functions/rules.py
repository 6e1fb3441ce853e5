"""Column rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space as text cleaning sees it: Unicode's, and the separators U+001C to U+001F.
SPACE = r"[\p{IsWhite_Space}\x{1C}-\x{1F}]"


def nocase(c: Column | str) -> Column:
    """Key that ignores the case of A-Z only, as the catalog's name columns do."""
    return F.translate(c, _UPPER, _LOWER)


def clean_text(c: Column | str) -> Column:
    """Runs of white space become one space, ends are stripped; null becomes empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE + "+", " "))


def clock(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds: not below 0, half to even, hours of any length."""
    s = F.greatest(F.lit(0), F.bround(seconds, 0)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600).cast("string")
    return F.concat_ws(":", F.lpad(hours, F.greatest(F.lit(2), F.length(hours)), F.lit("0")), two(F.floor(s % 3600 / 60)), two(s % 60))


def byte_size(n: Column, largest: str = "TB") -> Column:
    """Size for readers: whole bytes, else one decimal in KB, MB, GB or TB, up to the `largest` of them."""
    out, units = F.format_string("%d B", n), ("KB", "MB", "GB", "TB")
    for i, unit in enumerate(units[: units.index(largest) + 1], start=1):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {unit}", F.bround(n / 1024**i, 1))).otherwise(out)
    return out


def suffix(name: Column) -> Column:
    """Lower-case suffix with its dot, or empty."""
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def _parts(word: Column) -> Column:
    """All parts of two and of three characters of a word, and none twice."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))
    return F.array_distinct(F.concat(of(2), of(3)))


def words_with_terms(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, term) for every distinct word that contains a term of two characters or more.

    A term is filed under its first three characters, a word looks up all of its parts, so neither meets all of the other.
    """
    filed = terms.select("term", F.substring("term", 1, 3).alias("part")).distinct()
    return words.select("word").distinct().select("word", F.explode(_parts(F.col("word"))).alias("part")).join(filed, "part").filter(F.contains("word", F.col("term"))).select("word", "term").distinct()


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double, by one square root and within -1 to 1; 0 where a vector has no length.

    Equal sums of cosines decide between paths, so the SQL twin's last bits count.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    def ratio(x: Column) -> Column:
        product = x["aa"] * x["bb"]
        # Beyond what a double holds, the roots are taken one by one.
        size = F.when((product > 0) & (product < float("inf")), F.sqrt(product)).otherwise(F.sqrt(x["aa"]) * F.sqrt(x["bb"]))
        return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x["ab"] / size)))

    return F.element_at(F.transform(F.array(F.struct(dot(a, b).alias("ab"), dot(a, a).alias("aa"), dot(b, b).alias("bb"))), ratio), 1)


def words_within(text: Column, most: int) -> Column:
    """At most so many words; a cut text loses ` ,;:` at its end and gets an ellipsis."""
    parts = F.split(text, " ")
    cut = F.regexp_replace(F.array_join(F.slice(parts, 1, most), " "), "[ ,;:]+$", "")
    return F.when(F.size(parts) > most, F.concat(cut, F.lit("…"))).otherwise(text)
