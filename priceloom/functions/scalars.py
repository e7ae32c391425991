"""Row-level arithmetic, flags and wording."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from priceloom.functions.templates import filled

# The sentences about correlations.
FEATURE_SENTENCE = (
    "**{label}** is {strength} {polarity} correlated with discount (r = {r}) — "
    "higher {label} tends to mean a **{direction} discount**. {context}"
)
PAIR_WARNING = (
    "⚠️ **{first}** and **{second}** are highly correlated (r = {r}). "
    "They carry overlapping information — but both contribute to computing the price ratio, so both are kept."
)
PAIR_SENTENCE = "**{first}** and **{second}**: r = {r}."
NEGATIVE_SENTENCE = "The most negative is **{label}** (r = {r}) — higher {lower} → smaller discount."
NO_NEGATIVE_SENTENCE = (
    "No strong negative relationships exist in this view — "
    "all features correlate positively or near-zero with discount %."
)

def bounded(x: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Clip to [low, high]; null and NaN stay as they are, which ``least`` alone would not do."""
    clipped = x if high is None else F.least(x, high)
    clipped = clipped if low is None else F.greatest(clipped, low)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(clipped)


def clamp_percent(prediction: Column) -> Column:
    """A predicted percentage kept within 0 and 100."""
    return bounded(prediction, F.lit(0.0), F.lit(100.0))


def implied_discount(actual_price: Column, discounted_price: Column) -> Column:
    """Percentage off that two prices imply; 0 when there is no positive list price."""
    return F.when(actual_price > 0, (1 - F.try_divide(discounted_price, actual_price)) * 100).otherwise(F.lit(0.0))


def formula_price(actual_price: Column, percent: Column) -> Column:
    """List price less a percentage."""
    return actual_price * (1 - percent / 100)


def not_discounted(actual_price: Column, discounted_price: Column) -> Column:
    """True when the selling price is not below the list price."""
    return discounted_price >= actual_price


def _number(r: Column) -> Column:
    """``r`` with NaN and null as 0, for thresholds that both must fail."""
    return F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))


# Thresholds on |r| are 0.6 and 0.3 for wording, 0.7 for overlap, r < -0.1 for a negative link.
def strength(r: Column) -> Column:
    size = F.abs(_number(r))
    return F.when(size > 0.6, "strongly").when(size > 0.3, "moderately").otherwise("weakly")


def direction(r: Column) -> Column:
    return F.when(_number(r) > 0, "higher").otherwise("lower")


def polarity(r: Column) -> Column:
    return F.when(_number(r) > 0, "positively").otherwise("negatively")


def highly_correlated(r: Column) -> Column:
    return F.abs(_number(r)) > 0.7


def signed(r: Column) -> Column:
    """``r`` with a sign and two decimals."""
    return F.format_string("%+.2f", r)


def lookup_label(key: Column, labels: dict[str, str], default: Column | None = None) -> Column:
    """Readable text for a key; an unknown key gives itself, or ``default``."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in labels.items()))
    return F.coalesce(F.try_element_at(table, key), key if default is None else default)


def correlation_sentence(feature_label: Column, r: Column, context: Column) -> Column:
    """One sentence on how a feature goes with the discount."""
    return filled(FEATURE_SENTENCE, label=feature_label, strength=strength(r), polarity=polarity(r), r=signed(r),
                  direction=direction(r), context=context)


def pair_sentence(first_label: Column, second_label: Column, r: Column) -> Column:
    """One sentence on how two features go together, with a warning above the overlap threshold."""
    values = {"first": first_label, "second": second_label, "r": signed(r)}
    return F.when(highly_correlated(r), filled(PAIR_WARNING, **values)).otherwise(filled(PAIR_SENTENCE, **values))


def negative_sentence(feature_label: Column, r: Column) -> Column:
    """The most negative link, named only when it is below -0.1."""
    named = filled(NEGATIVE_SENTENCE, label=feature_label, r=signed(r), lower=F.lower(feature_label))
    return F.when(_number(r) < -0.1, named).otherwise(F.lit(NO_NEGATIVE_SENTENCE))
