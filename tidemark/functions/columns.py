from pyspark.sql import Column, functions as F

# Date patterns for reading and for writing.
DATE_IN = "d/M/yyyy"
DATE_OUT = "dd/MM/yyyy"


def weight_of(flag: Column) -> Column:
    """``+`` is +1, ``-`` is -1, anything else NULL."""
    return F.when(flag == "+", 1).when(flag == "-", -1)


def flag_of(w: Column) -> Column:
    return F.when(w > 0, "+").otherwise("-")


def parse_day(text: Column) -> Column:
    """Day/month/year text to a date; NULL where there is no such day."""
    return F.try_to_date(text, DATE_IN)


def format_day(day: Column) -> Column:
    return F.date_format(day, DATE_OUT)


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def weighted(value: Column, w: Column | None = None) -> Column:
    """`value` times the row's weight, exact for decimals."""
    return value * (F.col("w") if w is None else w)


def result_text(*columns: str, amounts: tuple[str, ...] = ()) -> Column:
    """``(a, b, 1.500000)``: a result row as text, `amounts` with six decimals."""
    pattern = ", ".join("%.6f" if c in amounts else "%s" for c in columns)
    args = [
        F.col(c).cast("double") if c in amounts else F.col(c).cast("string")
        for c in columns
    ]
    return F.format_string(f"({pattern})", *args)
