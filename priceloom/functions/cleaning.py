"""Column expressions that turn messy listing text into numbers.

Every function takes the name of a string column and gives one SQL expression, so that a wide
cleaning step is a handful of expressions rather than hundreds of calls.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from priceloom.schema import NULL_TOKENS

# Every character that counts as white space at the edge of a text.
_SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                            0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Decimal text: optional sign, digits with single underscores between them, exponent.
_DIGITS = "[0-9]+(?:_[0-9]+)*"
_FLOAT = (
    f"^[+-]?(?:(?:{_DIGITS}(?:[.](?:{_DIGITS})?)?|[.]{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    "|(?i:inf|infinity|nan))$"
)


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def strip_space(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(_SPACES))


def missing_to_null(name: str) -> Column:
    """Null for text that stands for a missing value."""
    tokens = ", ".join(f"'{t}'" for t in NULL_TOKENS)
    return F.expr(f"if({_quoted(name)} in ({tokens}), null, {_quoted(name)})")


def price_to_double(name: str, strict: bool = False) -> Column:
    """Rupee price text as a double: drop the sign and the thousands commas, then parse.

    The cast also takes a type suffix (``1.0d``) and hexadecimal digits, which are no prices, and
    does not take single underscores between digits, which are allowed. Text that is not a
    decimal number becomes null; with ``strict`` it fails the query.
    """
    bare = f"btrim(translate({_quoted(name)}, '₹,', ''), '{_SPACES}')"
    suffix = f"(right({bare}, 1) in ('d', 'D', 'f', 'F') and lower(right({bare}, 3)) <> 'inf')"
    number = f"""case
        when contains({bare}, '_') then
            case when {bare} rlike '{_FLOAT}' then try_cast(translate({bare}, '_', '') as double) end
        when not ({suffix} or contains({bare}, 'x') or contains({bare}, 'X')) then try_cast({bare} as double)
    end"""
    if not strict:
        return F.expr(number)
    return F.expr(f"""if({_quoted(name)} is not null and ({number}) is null,
                         cast(raise_error(concat('not a price: ', {_quoted(name)})) as double), {number})""")


def digits_to_double(name: str, strict: bool = False) -> Column:
    """Keep only ASCII digits and points, glued together, and parse what is left.

    ``"4.2 out of 5"`` gives 4.25: the digits are joined, not just the first run taken.
    """
    kept = f"regexp_replace({_quoted(name)}, '[^0-9.]', '')"
    number = f"try_cast({kept} as double)"
    if not strict:
        return F.expr(number)
    return F.expr(f"""if({kept} <> '' and {number} is null,
                         cast(raise_error(concat('not a number: ', {_quoted(name)})) as double), {number})""")


def top_level(name: str) -> Column:
    """First segment of a pipe-separated category path; a missing path is ``Unknown``."""
    return F.expr(f"split_part(coalesce({_quoted(name)}, 'Unknown'), '|', 1)")
