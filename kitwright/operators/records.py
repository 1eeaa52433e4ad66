"""Stored billing records: whole JSON records read, changed field by field, and written back by key.

A record is a map from field names to variants, ``record``, so what an update
doesn't touch is written back with its meaning, fields that nobody declared and
dates or amounts that cannot be read included (:func:`fields` gives those as
null). A missing text, a broken one, one that is no object and one without a
plan give the record of a new user. Times are written in UTC with milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitwright.functions.scalars import holds
from kitwright.operators.billing import CARD_BRAND, CARD_LAST4, INVOICE, seed
from kitwright.sources import manifest

# What a new user has used.
USED_AI_BUILDS, USED_SAVED_BUILDS, USED_EXPORTS = 4, 15, 6

CARD = "struct<brand:string,last4:string,addedAt:timestamp>"
USAGE = "struct<aiBuilds:long,savedBuilds:long,exports:long>"
#: The declared fields.
RECORD = f"struct<plan:string,interval:string,cancelAtPeriodEnd:boolean,periodEndAt:timestamp,card:{CARD},billingEmail:string,usage:{USAGE},invoices:array<{INVOICE}>,nextInvoiceNumber:int>"
AS_STORED = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "timeZone": "UTC"}


def _object(text: Column) -> Column:
    """The fields of a JSON object; null for any other text."""
    return F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")


def field(record: Column, name: str, kind: str) -> Column:
    """A field as ``kind``; null if it is missing or cannot be read as that."""
    return F.try_variant_get(F.try_element_at(record, F.lit(name)), "$", kind)


def fields(record: Column) -> Column:
    """The declared fields, as a struct."""
    return F.from_json(text(record), RECORD, {"timeZone": "UTC"})


def put(record: Column, **values: Column) -> Column:
    """The record with these fields in place of what they were; a null value is stored as null."""
    names = list(values)
    stored = [x for n, v in values.items() for x in (F.lit(n), F.coalesce(v.cast("variant"), F.parse_json(F.lit("null"))))]
    return F.map_concat(F.map_filter(record, lambda k, _: ~k.isin(names)), F.create_map(*stored))


def _stored_card(now: Column) -> Column:
    card = F.struct(F.lit(CARD_BRAND).alias("brand"), F.lit(CARD_LAST4).alias("last4"), now.alias("addedAt"))
    return F.parse_json(F.to_json(card, AS_STORED))


def opening(as_of: Column, email: Column) -> Column:
    """The record of a user without one."""
    state = seed(as_of)
    card = F.struct(F.lit(CARD_BRAND), F.lit(CARD_LAST4), as_of)
    usage = F.struct(F.lit(USED_AI_BUILDS), F.lit(USED_SAVED_BUILDS), F.lit(USED_EXPORTS))
    whole = F.struct(state["plan"], state["interval"], state["cancel_at_period_end"], state["period_end_at"], card, email, usage, state["invoices"], state["next_invoice_number"]).cast(RECORD)
    return _object(F.to_json(whole, AS_STORED))


def expired(record: Column, now: Column) -> Column:
    """A cancelled plan whose period has ended is the free plan; all else stays."""
    over = field(record, "cancelAtPeriodEnd", "boolean") & (F.try_to_timestamp(field(record, "periodEndAt", "string")) <= now)
    free = put(record, plan=F.lit("free"), interval=F.lit("monthly"), cancelAtPeriodEnd=F.lit(False), periodEndAt=F.lit(None))
    return F.when(holds(over), free).otherwise(record)


def read(records: DataFrame, raw: str, as_of: Column, email: Column) -> DataFrame:
    """``records`` with ``record`` and ``was_seeded`` in place of the stored text ``raw``."""
    stored = records.withColumn("record", _object(F.col(raw))).withColumn("was_seeded", field(F.col("record"), "plan", "string").isNull())
    record = F.when(F.col("was_seeded"), opening(as_of, email)).otherwise(F.col("record"))
    return stored.withColumn("record", record).withColumn("record", expired(F.col("record"), as_of)).drop(raw)


def with_email(record: Column, email: Column) -> Column:
    """The billing e-mail becomes ``email``; where that is null the record stays."""
    return F.when(email.isNull(), record).otherwise(put(record, billingEmail=email))


def with_card(record: Column, now: Column) -> Column:
    """The demo card is added, unless there is a card already."""
    has_card = holds(~F.is_variant_null(F.try_element_at(record, F.lit("card"))))
    return F.when(has_card, record).otherwise(put(record, card=_stored_card(now)))


def without_card(record: Column) -> Column:
    """The card is removed on the free plan; other plans keep it."""
    return F.when(field(record, "plan", "string") == "free", put(record, card=F.lit(None))).otherwise(record)


def text(record: Column) -> Column:
    """The record as the JSON text to store."""
    return F.to_json(F.to_variant_object(record))


def save(records: DataFrame, root: str, commit: str, user: str = "user_id", table: str = "billing") -> None:
    """Overwrites the stored record (``user``, ``raw``) of each user in ``records``, as the commit of that name to the store at ``root``.

    ``records`` has a row for each user at most.
    """
    rows = records.select(user, text(F.col("record")).alias("raw"))
    manifest.commit(rows.sparkSession, root, commit, lambda now: {table: manifest.Replace(manifest.by_key(now.get(table), rows, user))})
