"""Column functions with the exact semantics the configurator's texts and numbers need.

All are expressions of built-in functions, so they stay inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between a German amount and its currency.
NBSP = "\u00a0"
DASH = "—"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(x: Column | str) -> Column:
    """The nearest integer; halves go towards plus infinity (-2.5 gives -2)."""
    return F.floor(col(x) + F.lit(0.5)).cast("long")


def holds(condition: Column) -> Column:
    """A rule's outcome: null counts as not holding."""
    return F.coalesce(condition, F.lit(False))


def given(x: Column | str) -> Column:
    """Whether a number is neither null, zero nor NaN."""
    return holds((col(x) != 0) & ~F.isnan(col(x).cast("double")))


def filled(x: Column | str) -> Column:
    """Whether a text is neither null nor empty."""
    return holds(col(x) != "")


def trimmed(x: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def add_months(ts: Column | str, months: Column | int) -> Column:
    """Moves the month and keeps the day; days the month lacks run over (Jan 31 + 1 month is Mar 3 or 2)."""
    ts = col(ts)
    months = F.lit(months) if isinstance(months, int) else months
    day = F.to_date(ts)
    moved = F.date_add(F.add_months(F.trunc(day, "MM"), months), F.dayofmonth(day) - 1)
    return F.timestamp_micros(F.unix_micros(ts) - F.unix_micros(day.cast("timestamp")) + F.unix_micros(moved.cast("timestamp")))


def date_label(ts: Column | str) -> Column:
    """``Jan 5, 2024``; a dash for null."""
    return F.coalesce(F.date_format(col(ts), "MMM d, yyyy"), F.lit(DASH))


def iso(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _cents(x: Column | str) -> Column:
    return F.round(col(x).cast("decimal(20,6)"), 2).cast("decimal(18,2)")


def euro_german(x: Column | str) -> Column:
    """``1.234,50 €``"""
    return F.concat(F.translate(F.format_number(_cents(x), 2), ",.", ".,"), F.lit(f"{NBSP}€"))


def euro_irish(x: Column | str) -> Column:
    """``€1,234.50``; the sign precedes the currency."""
    amount = _cents(x)
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("€"), F.format_number(F.abs(amount), 2))


def dollars(x: Column | str) -> Column:
    """``$1,234``"""
    return F.concat(F.lit("$"), F.format_number(col(x), 0))


def capitalised(x: Column | str) -> Column:
    """Only the first letter in upper case; the rest as it is."""
    return F.concat(F.upper(F.substring(col(x), 1, 1)), F.substring(col(x), 2, 2**30))


def padded(n: Column | str, width: int = 4) -> Column:
    """A number with leading zeros; longer numbers stay whole."""
    return F.format_string(f"%0{width}d", col(n))


def is_email(x: Column | str) -> Column:
    return holds(trimmed(x).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"))


def acceptable_password(password: Column | str, again: Column | str) -> Column:
    return holds((F.length(col(password)) >= 8) & (col(password) == col(again)))


def acceptable_name(name: Column | str) -> Column:
    """At most 100 characters without the white space at either end."""
    return holds(F.length(trimmed(name)) <= 100)


def display_name(name: Column | str, email: Column | str, default: str = "Pilot") -> Column:
    """The name if it isn't blank, else what stands before the @, else the default."""
    return F.coalesce(F.nullif(trimmed(name), F.lit("")), F.nullif(F.split_part(col(email), F.lit("@"), F.lit(1)), F.lit("")), F.lit(default))


def initial(name: Column | str, email: Column | str) -> Column:
    return F.upper(F.substring(F.coalesce(F.nullif(col(name), F.lit("")), F.nullif(col(email), F.lit("")), F.lit("?")), 1, 1))


def sign_in_error(code: Column | str, message: Column | str) -> Column:
    """A code first, then words of the message, else the default."""
    # The texts.
    return (
        F.when(holds(col(code) == "email_not_confirmed"), "Please confirm your email first. Check your inbox.")
        .when(holds(col(message).rlike("(?i)fetch|network")), "Could not reach the sign-in service. Check your connection and try again.")
        .otherwise("Email or password is incorrect.")
    )


def one_of(x: Column | str, allowed: list[str]) -> Column:
    """The value if it is allowed, else null."""
    return F.when(col(x).isin(allowed), col(x))


def unlimited(limit: Column | str) -> Column:
    return holds((col(limit) == float("inf")) | F.isnan(col(limit).cast("double")))


def usage_label(value: Column | str, limit: Column | str) -> Column:
    """``4 / 10`` or ``4 / Unlimited``"""
    return F.concat(col(value).cast("long").cast("string"), F.lit(" / "), F.when(unlimited(limit), "Unlimited").otherwise(col(limit).cast("decimal(18,0)").cast("string")))


def usage_percent(value: Column | str, limit: Column | str) -> Column:
    """At most 100; without a limit 100, with a limit of zero 0; NaN for a value that is none."""
    used = col(value).cast("double")
    return F.when(unlimited(limit), 100.0).when(col(limit) == 0, 0.0).when(F.isnan(used), float("nan")).otherwise(F.least(F.lit(100.0), F.try_divide(col(value).cast("double"), col(limit).cast("double")) * 100))


def progress(step: Column | str, index: Column | str) -> Column:
    """Whether the mark at ``index`` is lit at ``step`` of four questions."""
    return holds(col(index) <= F.least(col(step), F.lit(3)))


def month_label(ts: Column | str) -> Column:
    """``Jan``"""
    return F.date_format(col(ts), "MMM")


def day_label(ts: Column | str) -> Column:
    """``1/31/2024``"""
    return F.date_format(col(ts), "M/d/yyyy")


def chart_id(x: Column | str) -> Column:
    """An identifier without colons."""
    return F.translate(col(x), ":", "")


def number(x: Column | str) -> Column:
    """A number in a text; null if it is none."""
    return col(x).try_cast("double")


def form_errors(email: Column | str, password: Column | str, name: Column | str) -> Column:
    """A sign-up form's errors as a map from field to text."""
    # The texts.
    found = [
        F.when(~is_email(email), F.struct(F.lit("email"), F.lit("Enter a valid email address."))),
        F.when(~acceptable_name(name), F.struct(F.lit("name"), F.lit("Use 100 characters or fewer."))),
        F.when(~filled(password), F.struct(F.lit("password"), F.lit("Enter your password."))).when(F.length(col(password)) < 8, F.struct(F.lit("password"), F.lit("Use at least 8 characters."))),
    ]
    return F.map_from_entries(F.array_compact(F.array(*found)))


def sign_up_outcome(reached: Column | str, error: Column | str, identities: Column | str, session: Column | str) -> Column:
    """What a sign-up came to: ``ok``, ``error_text``, ``needs_confirmation``.

    An answer without identities names an account that exists already; one
    without a session waits for the e-mail to be confirmed.
    """
    # The texts.
    text = (
        F.when(~holds(col(reached)), "Could not create your account. Check your connection and try again.")
        .when(col(error).isNotNull(), col(error))
        .when(holds(col(identities) == 0), "An account with this email already exists. Try signing in.")
    )
    return F.struct(text.isNull().alias("ok"), text.alias("error_text"), (text.isNull() & ~holds(col(session))).alias("needs_confirmation"))


def shown_series(item: Column | str) -> Column:
    """Whether a chart item (a variant) belongs to a series: its type isn't ``none``."""
    return ~holds(F.try_variant_get(col(item), "$.type", "string") == "none")


def payload_config(config: Column, item: Column, key: Column) -> Column:
    """The entry of ``config`` for a chart item (a variant): by the text that the item has at ``key``, else the one its payload has there, else by ``key``.

    A text that is no key of ``config`` gives the entry of ``key`` itself.
    """

    def text(v: Column) -> Column:
        at = F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), key)
        return F.when(holds(F.schema_of_variant(at) == "STRING"), F.try_variant_get(at, "$", "string"))

    payload = F.try_element_at(F.try_variant_get(item, "$", "map<string,variant>"), F.lit("payload"))
    label = F.coalesce(text(item), text(payload), key)
    return F.coalesce(F.try_element_at(config, label), F.try_element_at(config, key))
