"""Column helpers for text, flags, numbers and time."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as browsers see it: ASCII blanks, no-break and ideographic spaces, line separators, BOM.
SPACES = (
    "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_RUN = "[\\s\u00a0\u2000-\u200a\u2028\u2029\u3000\ufeff\u1680\u202f\u205f]+"  # the same as a regular expression
TRUE_WORDS = ("1", "true", "yes", "y", "是")  # fixed values
WORD = "[0-9A-Za-z_]"
BOUNDARY = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_regex(pattern: str) -> str:
    """The pattern with word boundaries that only ASCII letters, digits and _ make."""
    return pattern.replace(r"\b", BOUNDARY)


def trimmed(c: ColumnLike) -> Column:
    return F.btrim(col(c).cast("string"), F.lit(SPACES))


def text(c: ColumnLike, limit: int | None = None) -> Column:
    """Trimmed text of at most `limit` characters, null when blank."""
    out = trimmed(c)
    if limit:
        out = F.substring(out, 1, limit)
    return F.nullif(out, F.lit(""))


def squeezed(c: ColumnLike, limit: int | None = None) -> Column:
    """Runs of white space become one blank; trimmed, cut, null when blank."""
    value = col(c).cast("string")
    # Plain ASCII without double blanks, tabs or line breaks has nothing to collapse.
    collapsed = F.when(value.rlike("  |[^ -\u009f]"), F.regexp_replace(value, SPACE_RUN, " "))
    return text(collapsed.otherwise(value), limit)


def ellipsis(c: ColumnLike, limit: int) -> Column:
    """Trimmed text; longer than `limit` becomes limit-1 characters and an ellipsis; null when blank."""
    value = trimmed(c)
    cut = F.concat(F.substring(value, 1, limit - 1), F.lit("…"))
    return F.nullif(F.when(F.length(value) > limit, cut).otherwise(value), F.lit(""))


def first_text(*cs: ColumnLike) -> Column:
    """First value that is not blank."""
    return F.coalesce(*[text(c) for c in cs])


def comparable(c: ColumnLike) -> Column:
    """Lower-case trimmed text, "" for null."""
    return F.coalesce(F.lower(trimmed(c)), F.lit(""))


def flag(c: ColumnLike, *more_words: str) -> Column:
    words = F.lower(trimmed(c)).isin(*TRUE_WORDS, *more_words)
    return F.coalesce(words, F.lit(False))


def number(c: ColumnLike) -> Column:
    return col(c).try_cast("double")


def clamped(c: ColumnLike, low: float, high: float, fallback: Column | float) -> Column:
    """Number held between low and high; the fallback when it is missing or no finite number."""
    n = number(c)
    usable = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    fallback = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    return F.when(usable, F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), n))).otherwise(fallback)


def half_up(c: Column) -> Column:
    """Nearest whole number, halves upward."""
    return F.floor(c + F.lit(0.5))


def percent(part: Column, total: Column) -> Column:
    """Percentage with one decimal, halves upward; null when the total is 0."""
    return F.when(total != 0, half_up(part.cast("double") * 1000 / total) / 10)


def moment(c: ColumnLike) -> Column:
    """Timestamp from the usual date notations, null when none fits."""
    formats = ("M/d/yyyy[ H:mm[:ss]]", "yyyy/M/d[ H:mm[:ss]]", "MMM d, yyyy", "d MMM yyyy")

    def parsed(value: Column) -> Column:
        return F.coalesce(value.try_cast("timestamp"), *[F.try_to_timestamp(value, F.lit(f)) for f in formats])

    return let(text(c), parsed)


def moment_of(df: DataFrame, name: str) -> Column:
    """The column as timestamp; read from text only when it is not one already."""
    return F.col(name) if dict(df.dtypes).get(name) == "timestamp" else moment(name)


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def one_of(c: Column, allowed: tuple[str, ...]) -> Column:
    """The value when it is allowed, else null."""
    return F.when(c.isin(*allowed), c)


def currency(c: ColumnLike) -> Column:
    code = F.upper(trimmed(c))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def split_list(c: ColumnLike) -> Column:
    """Parts of a list written with | or ; (also full width), blank parts dropped."""
    parts = F.transform(F.split(trimmed(c), "[|;；]"), lambda x: text(x))
    return F.array_compact(F.coalesce(parts, F.array().cast("array<string>")))


def distinct_first(values: Column, keep: int | None = None) -> Column:
    """Distinct members that are not null in first-seen order; the first `keep`, if given."""
    found = F.array_distinct(F.array_compact(values))
    return found if keep is None else F.slice(found, 1, keep)


def _normal_form(form: str):
    @F.pandas_udf(T.StringType())
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize(form, v), na_action="ignore")
    return normal


def _unicode_form(c: Column, form: str) -> Column:
    """Unicode normal form. Spark has no such function; only values with non-ASCII text go to Python."""
    foreign = c.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_normal_form(form)(F.when(foreign, c)), c)


def name_key(c: ColumnLike) -> Column:
    """Comparison key of a name: lower case, compatibility form, letters and digits of any script."""
    folded = _unicode_form(F.lower(col(c)), "NFKC")
    return F.nullif(F.regexp_replace(folded, r"[^\p{L}\p{N}]", ""), F.lit(""))


def ascii_name_parts(c: ColumnLike) -> Column:
    """Lower-case ASCII words of a person's name, accents removed."""
    value = trimmed(c)
    plain = F.regexp_replace(_unicode_form(value, "NFKD"), r"\p{M}", "")
    parts = F.split(F.lower(plain), "[^a-z0-9]+")
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def content_id(prefix: str, *parts: Column, width: int = 32) -> Column:
    """Stable id from content. 128 bits, so ids stay distinct for billions of rows."""
    seed = F.concat_ws("|", *[F.coalesce(trimmed(p), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(seed, 256), 1, width))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters, eight hex digits. Only for interchange with old ids."""
    mixed = F.aggregate(
        F.filter(F.split(c, ""), lambda x: x != ""),
        F.lit(2166136261).cast("bigint"),
        lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("bigint")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)),
    )
    return F.lower(F.lpad(F.hex(mixed), 8, "0"))


def text_digest(c: Column) -> Column:
    """FNV-1a of the text followed by FNV-1a of its reverse."""
    return F.concat(fnv1a(c), fnv1a(F.reverse(c)))


def uri_component(c: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) alone."""
    plain_text = c.rlike(r"^[A-Za-z0-9\-_.!~*'()]*$")
    out = F.url_encode(c)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return F.when(plain_text, c).otherwise(out)


def pair_id(left: Column, right: Column) -> Column:
    """Id of an unordered pair; null for blank or equal members."""
    a, b = text(left), text(right)
    joined = F.concat(F.lit("duplicate:"), uri_component(F.least(a, b)), F.lit(":"), uri_component(F.greatest(a, b)))
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), joined)


def packed(major: Column, minor: Column, code: Column) -> Column:
    """One decimal that orders by major, then minor, and carries a one-digit code.

    Its maximum needs no sort: Spark keeps decimals, unlike text or structs, in the hash aggregate's buffer.
    Major may use 17 digits, minor 19.
    """
    wide = "decimal(38,0)"
    return (major.cast("decimal(18,0)") * F.lit("100000000000000000000").cast("decimal(21,0)")).cast(wide) + (
        minor.cast("decimal(19,0)") * 10 + code.cast("decimal(1,0)")).cast(wide)


def packed_code(value: Column) -> Column:
    return F.when(value.isNotNull(), F.pmod(value, F.lit(10)).cast("int"))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days, at least 0, null when a side is missing."""
    days = (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400e6)
    return F.when(days.isNotNull(), F.greatest(F.lit(0.0), days))  # greatest alone would skip a null
