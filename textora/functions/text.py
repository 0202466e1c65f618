"""Text functions as Column expressions; the two that need Python are Arrow UDFs at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from textora import fixed

INVISIBLE = r"[\x{E0000}-\x{E007F}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
SEPARATORS = r"[\s\-_.·/]"
SENTENCE_END = r"[.!?:;)\]\"'»”…]\s*$"
TABLE_LINE = r"(\|.*\|)|(\t.*\t)"
ABSOLUTE_PATH = r"^(?:/[^/\s]+){2,}|^[A-Za-z]:[\\/]|^~[/\\]"
NAMESPACE = "textora"
MASK = "•"


def empty_as(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def squeezed(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_invisible(text: Column) -> Column:
    """Without tag characters, zero-width characters and direction overrides."""
    return F.regexp_replace(text, INVISIBLE, "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+\s*"), 0)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def tidy(text: Column) -> Column:
    """For matching facts: no invisible characters or soft hyphens, hyphenated line breaks joined, blanks squeezed, lower case."""
    t = F.replace(strip_invisible(text), F.lit("\u00ad"), F.lit(""))
    return F.lower(squeezed(F.regexp_replace(t, r"(\p{L})-[ \t]*\n[ \t]*(\p{Ll})", "$1$2")))


def compact(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def line_key(line: Column) -> Column:
    """A line as it repeats from page to page: digits as #."""
    return F.lower(F.regexp_replace(squeezed(line), r"\d", "#"))


def run_together(text: Column) -> Column:
    """Tokens that look like several words without their spaces."""
    long = F.filter(F.split(text, r"\s+"), lambda w: (F.length(w) >= 15) & w.rlike(r"\p{L}"))
    return F.size(F.filter(long, lambda w: (F.regexp_count(w, F.lit(r"\p{Ll}\p{Lu}")) >= 2) | ((F.length(w) >= 25) & w.rlike(r"^\p{L}+$")))).cast("long")


def rate(count: Column, total: Column, per: float = 1000.0) -> Column:
    return F.bround(count / total * per, 2)


def mask_value(value: Column, tail: int = fixed.REVEAL_TAIL) -> Column:
    """All letters and digits but the last `tail` as dots; a value of no more than that many is masked whole."""
    plain = F.regexp_replace(value, r"[\p{Cc}\p{Cf}\x{2028}\x{2029}]", " ")
    some = F.regexp_count(value, F.lit(r"[\p{L}\p{N}]")) > tail
    return F.when(some, F.regexp_replace(plain, rf"[\p{{L}}\p{{N}}](?=(?:[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]){{{tail}}})", MASK)).otherwise(F.regexp_replace(plain, r"[\p{L}\p{N}]", MASK))


def render(value: Column, category: Column, reveal: bool = False) -> Column:
    """The masked value, or with reveal the value itself unless its category is never shown."""
    return F.when(F.lit(reveal) & ~category.isin(*fixed.NEVER_REVEAL), value).otherwise(mask_value(value))


def _digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x00", F.lit(NAMESPACE), *parts), 256), 1, 16)


def identifier_fingerprint(category: Column, value: Column) -> Column:
    """The same for one value however it is spaced, dashed or cased."""
    return F.concat(F.lit("id-"), _digest(F.lit("identifier"), category, F.lower(F.regexp_replace(value, SEPARATORS, ""))))


def passage_fingerprint(text: Column) -> Column:
    return F.concat(F.lit("ct-"), _digest(F.lit("passage"), F.lower(squeezed(text))))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def line_of(text: Column, offset: Column) -> Column:
    """Line (from 1) of a character offset (from 0)."""
    return (F.length(F.regexp_replace(F.substring(text, F.lit(1), offset), r"[^\n]", "")) + 1).cast("int")


def column_of(text: Column, offset: Column) -> Column:
    """Column (from 0) of a character offset."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1))


def excerpt(text: Column, most: int = 240) -> Column:
    t = squeezed(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def paragraphs(text: Column, most: int = 2000) -> Column:
    """Blank-line separated pieces, long ones cut into windows."""
    pieces = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")
    windows = lambda p: F.transform(F.sequence(F.lit(0), ((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
    return F.flatten(F.transform(pieces, windows))


def numbered_heading(span: Column) -> Column:
    """Capitals that end in a number by itself, as a heading with the clause after it."""
    return span.rlike(r"^\s*\S+(?:\s+\S+)*\s+\d+\.*\s*$") & span.rlike(r"\p{L}") & ~span.rlike(r"\p{Ll}")


def control_share(text: Column) -> Column:
    return count_of(text, r"[\p{Cc}\p{Co}\p{Cn}\x{FFFD}&&[^\r\n\t]]") / F.greatest(F.lit(1), F.length(text))


def sensible_share(text: Column) -> Column:
    """Share of tokens that are numbers or mostly letters, marks and digits; tokens of punctuation alone do not count."""
    strip = lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]\"']+|[.,;:!?()\[\]\"']+$", "")
    kept = F.filter(F.transform(F.split(text, r"\s+"), strip), lambda w: w != "")
    good = lambda w: w.rlike(r"^\d[\d.,:/%\-]*$") | ((F.length(w) >= 2) & (F.regexp_count(w, F.lit(r"[\p{L}\p{M}\p{N}]")) / F.length(w) >= 0.8))
    return F.size(F.filter(kept, good)) / F.greatest(F.lit(1), F.size(kept))


def estimated_tokens(text: Column) -> Column:
    return F.bround(F.length(text) / F.lit(4.0)).cast("long")


def smuggled(text: Column) -> Column:
    """array<struct<kind, payload>>: runs of tag characters (decoded), of eight or more zero-width characters, and overrides."""
    tag = F.transform(F.regexp_extract_all(text, F.lit(r"[\x{E0000}-\x{E007F}]+"), 0), lambda r: F.struct(F.lit("tags").alias("kind"), F.translate(r, "".join(chr(0xE0000 + i) for i in range(32, 127)), "".join(map(chr, range(32, 127)))).alias("payload")))
    zero = F.transform(F.regexp_extract_all(text, F.lit(r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]{8,}"), 0), lambda r: F.struct(F.lit("zero_width").alias("kind"), F.length(r).cast("string").alias("payload")))
    bidi = F.transform(F.regexp_extract_all(text, F.lit(r"[\x{202D}\x{202E}][^\n]*?[\p{L}\p{N}]"), 0), lambda r: F.struct(F.lit("override").alias("kind"), F.lit("").alias("payload")))
    return F.concat(tag, zero, bidi)


@F.pandas_udf(DoubleType())
def reading_similarity(a, b):
    """How closely two readings agree word by word, in order: 2 * matched / all, of all their words (align.py)."""
    import pandas as pd

    from textora.functions.align import similarity

    return pd.Series([similarity((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(StructType().add("similarity", DoubleType()).add("same_words", BooleanType()))
def readings_compared(a, b):
    """reading_similarity() of two readings, and whether they hold the same words in any order."""
    import pandas as pd

    from textora.functions.align import same_words, similarity

    pairs = [(x or "", y or "") for x, y in zip(a, b, strict=True)]
    return pd.DataFrame({"similarity": [similarity(x.split(), y.split()) for x, y in pairs], "same_words": [same_words(x, y) for x, y in pairs]}).astype({"similarity": "float64", "same_words": "bool"})


@F.pandas_udf(StringType())
def nfkc(text):
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """NFKC form; only texts beyond ASCII leave the JVM."""
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
