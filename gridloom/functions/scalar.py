"""Column expressions on messy cells: everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: currency signs (with the letter R), placeholders, boolean tokens and months
CURRENCY = "$€£¥₹₽₩₪R"
PLACEHOLDERS = ["-", "--", "–", "—", ".", "..", "…", "?", "*", "n/a", "n.a.", "na", "n/k", "nil", "null", "none", "nan", "tbd", "tba", "unknown", "pending", "empty", "no data", "not available"]
TRUE = ["true", "yes", "y", "✓", "✔", "1", "on", "enabled"]
FALSE = ["false", "no", "n", "✗", "✘", "×", "0", "off", "disabled"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# fixed values: white space of any script, and the byte-order mark; signs for minus
SPACES = "\t\n\x0b\x0c\r                  　﻿"
MINUS = "−–—"
_S = f"[{SPACES}]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def trimmed(c: Column) -> Column:
    """Without white space of any script, or byte-order marks, at both ends."""
    return F.btrim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    return F.length(trimmed(c)) == 0


#: What is a number as it stands; most cells of most tables are.
_PLAIN = r"^-?[0-9]+(?:\.[0-9]+)?$"
#: A sign, then digits, points and commas with a digit among them.
_WRITTEN = r"^-?\+?[.,]*[0-9][0-9.,]*$"
#: Commas that only part thousands: before groups of three alone, or before the last point.
_PARTING = r"^(?:[0-9]{0,3},[0-9]{3}|[0-9]*(?:,[0-9]{3}){2,})$|\.[^,]*$"
_PARTING_POINTS = r"^[0-9]*(?:\.[0-9]{3}){2,}$"


def parse_number(raw: Column, decimal_comma: bool = False) -> Column:
    """A double out of a written number, or null: signs, currency, percent, brackets for negatives, either decimal sign.

    One pattern tells what is a number; two more, tried on what passes, tell what its commas and points mean.
    """
    s = trimmed(raw)
    bracketed = s.startswith("(") & s.endswith(")") & ~s.contains("\n")
    inner = F.when(bracketed, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)
    body = F.translate(inner, MINUS + CURRENCY + "%" + SPACES, "---")
    parting = _PARTING[_PARTING.index("|\\.") + 1 :] if decimal_comma else _PARTING

    def value(body: Column) -> Column:
        digits = F.translate(body, "-+", "")
        whole = F.when(digits.rlike(_PARTING_POINTS), F.translate(digits, ".", "")).otherwise(digits)
        number = F.when(~digits.contains(","), whole).when(digits.rlike(parting), F.translate(digits, ",", "")).otherwise(F.translate(digits, ",.", "."))  # the comma is the decimal sign
        return F.when(body.rlike(_WRITTEN), F.concat(F.when(bracketed | body.startswith("-"), "-").otherwise(""), number)).try_cast("double")

    return F.nullif(F.when(raw.rlike(_PLAIN), raw.try_cast("double")).otherwise(let(body, value)), F.lit(float("inf")))


def without_zeros(decimal: Column) -> Column:
    return F.regexp_replace(decimal.cast("string"), r"\.?0+$", "")


def number_text(n: Column) -> Column:
    """A double as its shortest usual text: no trailing zeros, an exponent below 1e-6 and from 1e21 on."""

    def text(x: Column) -> Column:
        s, size = x.cast("string"), F.abs(x)
        far = F.regexp_replace(F.regexp_replace(s, r"\.0E|E", "e"), r"e(?=\d)", "e+")
        return (
            F.when(x == 0, F.lit("0")).when(~s.contains("E"), F.regexp_replace(s, r"\.0$", "")).when((size >= 1e21) | (size < 1e-6), far)
            .when(size >= 1, without_zeros(x.try_cast("decimal(38,12)"))).otherwise(without_zeros(x.try_cast("decimal(38,30)")))
        )

    return let(n, text)


_DATE = rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|^[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}}$|^[0-9]{{1,2}}{_S}+[A-Za-z]{{3,9}}\.?{_S}+[0-9]{{2,4}}$|^[A-Za-z]{{3,9}}\.?{_S}+[0-9]{{1,2}},?{_S}+[0-9]{{2,4}}$"


def looks_date(c: Column) -> Column:
    return trimmed(c).rlike(_DATE)


def looks_url(c: Column) -> Column:
    return trimmed(c).rlike(rf"(?i)^(?:https?://|www\.)[^{SPACES}]+$|^mailto:")


def placeholder(c: Column) -> Column:
    return F.lower(trimmed(c)).isin(PLACEHOLDERS)


def looks_boolean(c: Column) -> Column:
    return F.lower(trimmed(c)).isin(TRUE + FALSE)


def iso_date(c: Column) -> Column:
    """yyyy-mm-dd where the order of the parts is certain, else null; an ISO prefix is taken as it is, valid or not."""
    s = trimmed(c)
    day_first, month_first = rf"^([0-9]{{1,2}}){_S}+([A-Za-z]{{3}})[A-Za-z]{{0,6}}\.?{_S}+([0-9]{{4}})$", rf"^([A-Za-z]{{3}})[A-Za-z]{{0,6}}\.?{_S}+([0-9]{{1,2}}),?{_S}+([0-9]{{4}})$"
    # year, month (a name or a number), day
    parts = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(s, 1, 10)).otherwise(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(s, day_first, "$3-$2-$1"), month_first, "$3-$1-$2"), r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})$", "$3-$2-$1!")
    )

    def dated(p: Column) -> Column:
        cut = F.split(F.rtrim(p, F.lit("!")), "-")
        y, m, d = F.get(cut, F.lit(0)), F.get(cut, F.lit(1)), F.get(cut, F.lit(2))
        named = F.array_position(F.lit(MONTHS), F.lower(m))
        join = lambda m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        a, b = d.try_cast("int"), m.try_cast("int")
        return (
            F.when(p.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), p).when(p.rlike("^[0-9]{4}-[A-Za-z]{3}-[0-9]{1,2}$") & (named > 0), join(named.cast("string"), d))
            .when(p.endswith("!") & (a > 12) & (b <= 12), join(m, d)).when(p.endswith("!") & (b > 12) & (a <= 12), join(d, m))
        )

    return let(parts, dated)


def date_key(c: Column) -> Column:
    """What dates are sorted by: the ISO form; month first where both orders are possible, years of two digits from 1950 to 2049; else the text."""
    s = trimmed(c)
    both = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-](?:([0-9]{4})|([0-9]{2}))$"
    part = lambda i: F.regexp_extract(s, both, i)
    year = F.when(part(3) != "", part(3)).when(part(4) < "50", F.concat(F.lit("20"), part(4))).otherwise(F.concat(F.lit("19"), part(4)))
    guess = F.when(s.rlike(both), F.concat_ws("-", year, F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")))
    return F.coalesce(iso_date(c), guess, F.lower(s))


def clean_value(raw: Column, kind: str, normalise_dates: bool = False, percent_as_fraction: bool = False) -> Column:
    """A cell tidied by the type of its column; what does not parse stays, trimmed."""
    s = trimmed(raw)
    if kind in ("number", "currency", "percent"):
        n = parse_number(raw)
        if kind == "percent" and percent_as_fraction:
            n = n / 100
        return F.coalesce(number_text(n), s)
    if kind == "boolean":
        return F.when(F.lower(s).isin(TRUE), "true").when(F.lower(s).isin(FALSE), "false").otherwise(s)
    if kind == "date" and normalise_dates:
        return F.coalesce(iso_date(raw), s)
    return s


def natural_key(c: Column) -> Column:
    """A sort key by which item 2 comes before Item 9 before item 10: digit runs are padded, case and accents do not count."""
    padded = F.array_join(F.transform(F.regexp_extract_all(F.concat(trimmed(c), F.lit("")), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 20, "0")).otherwise(p)), "")
    return F.collate(padded, "UNICODE_CI_AI")


def coverage(inner: dict[str, Column], outer: dict[str, Column]) -> Column:
    """The share of the inner box that the outer one covers."""
    over = lambda lo, hi: F.greatest(F.lit(0.0), F.least(inner[hi], outer[hi]) - F.greatest(inner[lo], outer[lo]))
    area = (inner["right"] - inner["left"]) * (inner["bottom"] - inner["top"])
    return over("left", "right") * over("top", "bottom") / F.greatest(F.lit(1.0), area)


def intersects(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["left"] < b["right"]) & (a["right"] > b["left"]) & (a["top"] < b["bottom"]) & (a["bottom"] > b["top"])
