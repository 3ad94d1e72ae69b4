"""Column expressions (built-in Spark functions only, so they stay in codegen)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that must equal the reference's behaviour:
# the year given to a customer whose activation date is missing, and its marker.
MISSING_DATE_MARKER = "#N/A"
MISSING_DATE_YEAR = 1946.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def comma_number(x) -> Column:
    """F1: ``"1,234"`` -> 1234.0; unparsable text -> null (never an error)."""
    return F.replace(_c(x).cast("string"), F.lit(","), F.lit("")).try_cast("double")


def iso_year(x) -> Column:
    """year of an ISO ``yyyy-mm-dd`` string, as double."""
    return F.split_part(_c(x).cast("string"), F.lit("-"), F.lit(1)).try_cast("double")


def slash_year(x) -> Column:
    """year of an ``m/d/yyyy`` string; the missing marker gives 1946."""
    s = _c(x).cast("string")
    return (F.when(s == MISSING_DATE_MARKER, F.lit(MISSING_DATE_YEAR))
            .otherwise(F.split_part(s, F.lit("/"), F.lit(3)).try_cast("double")))


def str_or_empty(x) -> Column:
    """any value as text, null as the empty string."""
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def item_key(style, ref) -> Column:
    """composite product key ``style,ref``."""
    return F.concat_ws(",", _c(style).cast("string"), _c(ref).cast("string"))


def item_key_style(key) -> Column:
    """style part of a composite key."""
    return F.split_part(_c(key), F.lit(","), F.lit(1))


def line_amount(quantity, unit_price) -> Column:
    """quantity x unit price."""
    return _c(quantity) * _c(unit_price)


def margin_pct(net_amount, cost) -> Column:
    """(net - cost) / net; null when net is 0."""
    return F.try_divide(_c(net_amount) - _c(cost), _c(net_amount))


def months_before(as_of, months: int) -> Column:
    """the date ``months`` months before ``as_of``."""
    return F.add_months(F.to_date(_c(as_of) if not isinstance(as_of, str) else F.lit(as_of)), -int(months))


def sq_distance(a, b) -> Column:
    """squared Euclidean distance of two equal-length double arrays."""
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    """Dot product of two equal-length numeric arrays."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def tag_string(tags) -> Column:
    """distinct tags, sorted, comma-joined; empty list -> ''."""
    return F.array_join(F.array_sort(F.array_distinct(_c(tags))), ",")


def money(x) -> Column:
    """``$1234.50``."""
    return F.format_string("$%.2f", _c(x))


def score_text(x) -> Column:
    """four decimals."""
    return F.format_string("%.4f", _c(x))


def percent_text(x) -> Column:
    """up to five decimals without trailing zeros, then ``%``."""
    s = F.format_string("%.5f", F.round(_c(x), 5))
    s = F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")
    return F.concat(s, F.lit("%"))


def array_add(a, b) -> Column:
    """element-wise sum of two arrays."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def array_scale(a, divisor) -> Column:
    """element-wise division by a scalar."""
    d = _c(divisor) if not isinstance(divisor, (int, float)) else F.lit(float(divisor))
    return F.transform(_c(a), lambda x: x / d)
