"""The literal catalogues: products, presets, starter parts, templates, plans and the dimensions around them.

Every table is given once, as rows, and is available as a DataFrame with an
explicit schema and as a SQL ``VALUES`` list for the oracles.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Category order and labels.
CATEGORIES = [
    ("frame", "Frame"),
    ("motors", "Motors"),
    ("flightController", "Flight Controller"),
    ("esc", "ESC"),
    ("propellers", "Propellers"),
    ("battery", "Battery"),
    ("camera", "Camera"),
    ("receiver", "Receiver"),
]
SLOTS = [c for c, _ in CATEGORIES]

# The product catalogue. Attributes that a product lacks are null.
PRODUCTS = [
    {"id": "frame5", "category": "frame", "name": "iFlight Nazgul Evoque F5", "spec": "5” freestyle frame · 16×16 mm motor mount", "price": "59.90", "weight": 180, "frame_inches": 5, "mount": "16x16"},
    {"id": "frame7", "category": "frame", "name": "Explorer 7", "spec": "7” long-range frame · 16×16 mm motor mount", "price": "89.90", "weight": 230, "frame_inches": 7, "mount": "16x16"},
    {"id": "frame3", "category": "frame", "name": "Guarded Cine 3", "spec": "3” guarded frame · 9×9 mm motor mount", "price": "68.90", "weight": 95, "frame_inches": 3, "mount": "9x9"},
    {"id": "motors5", "category": "motors", "name": "T-Motor F60 Pro V 2020", "spec": "1950 KV · 2207 · set of 4", "price": "89.90", "weight": 136, "mount": "16x16", "motor_size": 2207, "min_voltage": 4, "max_voltage": 6, "thrust": 1500, "current": 38},
    {"id": "motors7", "category": "motors", "name": "Eco Cruiser 2806.5", "spec": "1300 KV · 2806.5 · set of 4", "price": "109.90", "weight": 200, "mount": "16x16", "motor_size": 2806, "min_voltage": 4, "max_voltage": 6, "thrust": 1650, "current": 35},
    {"id": "motors3", "category": "motors", "name": "Cine Compact 1404", "spec": "3800 KV · 1404 · set of 4", "price": "69.90", "weight": 60, "mount": "9x9", "motor_size": 1404, "min_voltage": 3, "max_voltage": 4, "thrust": 550, "current": 15},
    {"id": "fcF7", "category": "flightController", "name": "iFlight BLITZ F7", "spec": "F7 flight controller · 8-pin ESC connector", "price": "119.90", "weight": 18, "connector": "8pin", "min_voltage": 3, "max_voltage": 6},
    {"id": "fcF4", "category": "flightController", "name": "Compact F4 Controller", "spec": "F4 flight controller · 6-pin ESC connector", "price": "64.90", "weight": 10, "connector": "6pin", "min_voltage": 3, "max_voltage": 4},
    {"id": "esc55", "category": "esc", "name": "T-Motor F55A PRO II", "spec": "55 A · 4-in-1 ESC · 8-pin", "price": "99.90", "weight": 22, "esc_amps": 55, "min_voltage": 4, "max_voltage": 6, "esc_input": "8pin"},
    {"id": "esc20", "category": "esc", "name": "Compact 20A ESC", "spec": "20 A · 4-in-1 ESC · 6-pin", "price": "54.90", "weight": 12, "esc_amps": 20, "min_voltage": 3, "max_voltage": 4, "esc_input": "6pin"},
    {"id": "props5", "category": "propellers", "name": "HQProp T5x3.5x3", "spec": "5” tri-blade · 2 CW + 2 CCW", "price": "12.90", "weight": 18, "prop_inches": 5},
    {"id": "props7", "category": "propellers", "name": "Explorer 7x3.5", "spec": "7” bi-blade · 2 CW + 2 CCW", "price": "16.90", "weight": 26, "prop_inches": 7},
    {"id": "props3", "category": "propellers", "name": "Guarded 3x3x3", "spec": "3” tri-blade · 2 CW + 2 CCW", "price": "10.90", "weight": 12, "prop_inches": 3},
    {"id": "battery6", "category": "battery", "name": "CNHL Black Series 1500mAh", "spec": "6S · 1500 mAh · 150C", "price": "49.90", "weight": 240, "voltage": 6, "battery_mah": 1500},
    {"id": "battery6long", "category": "battery", "name": "Explorer 3000mAh", "spec": "6S · 3000 mAh · 60C", "price": "79.90", "weight": 390, "voltage": 6, "battery_mah": 3000},
    {"id": "battery4", "category": "battery", "name": "Compact 850mAh", "spec": "4S · 850 mAh · 100C", "price": "29.90", "weight": 110, "voltage": 4, "battery_mah": 850},
    {"id": "cameraFpv", "category": "camera", "name": "RunCam Phoenix 2", "spec": "Analog FPV camera", "price": "39.90", "weight": 9, "video": "analog"},
    {"id": "camera4k", "category": "camera", "name": "Demo 4K Action Camera", "spec": "4K recording · action camera mount required", "price": "159.90", "weight": 75, "video": "4k"},
    {"id": "receiver", "category": "receiver", "name": "TBS Crossfire Nano RX", "spec": "2.4 g · radio receiver", "price": "49.90", "weight": 3},
    {"id": "receiver2", "category": "receiver", "name": "Demo ELRS Receiver", "spec": "2.4 GHz · radio receiver", "price": "24.90", "weight": 2},
]
PRODUCT_SCHEMA = (
    "no int, id string, category string, name string, price decimal(10,2), weight int, frame_inches int, mount string, "
    "prop_inches int, motor_size int, voltage int, min_voltage int, max_voltage int, connector string, esc_input string, "
    "thrust int, current int, esc_amps int, battery_mah int, video string, spec string"
)

# The presets, one product for each slot in category order.
PRESETS = [
    ("cinematic", "Cinematic 4K Cruiser", ["frame7", "motors7", "fcF7", "esc55", "props7", "battery6long", "camera4k", "receiver"]),
    ("racer", "Backyard Racer", ["frame5", "motors5", "fcF7", "esc55", "props5", "battery6", "cameraFpv", "receiver"]),
    ("freestyle", "FPV Freestyle Rig", ["frame5", "motors5", "fcF7", "esc55", "props5", "battery6", "cameraFpv", "receiver2"]),
    ("longrange", "Long-Range Explorer", ["frame7", "motors7", "fcF7", "esc55", "props7", "battery6long", "cameraFpv", "receiver"]),
]

# The starter parts (id, name, price, essential, role).
PARTS = [
    ("frame", "5-inch carbon frame kit", 45, True, "The skeleton everything else mounts to"),
    ("motors", "2306 brushless motors (×4)", 80, True, "Spin the propellers — more power means faster flight"),
    ("esc", "4-in-1 ESC board", 55, True, "Controls how fast each motor spins"),
    ("fc", "Flight controller + GPS", 95, True, "The brain — keeps the drone stable in the air"),
    ("radio", "Radio transmitter + receiver", 130, True, "Your handheld controller"),
    ("camera", "4K camera + gimbal", 220, False, "Records smooth, steady video"),
    ("battery", "6S 1500 mAh batteries (×2)", 90, False, "About 12 minutes of flight per pack"),
    ("goggles", "FPV goggles", 180, False, "See live video from the drone as it flies"),
]

# The templates.
TEMPLATES = [
    ("cinematic", "Cinematic 4K Cruiser", "Beginner", "22 min", "54 km/h", "4K/60 stabilized", 620, "Smooth, stable and quiet — the easy way to get beautiful travel and landscape footage."),
    ("racer", "Backyard Racer", "Intermediate", "6 min", "160 km/h", "Analog FPV", 480, "Small, light and seriously quick. Built for tight turns and friendly competition."),
    ("freestyle", "FPV Freestyle Rig", "Intermediate", "8 min", "130 km/h", "HD FPV + recorder", 560, "Balanced power for flips, dives and gap shots. The classic freestyle setup."),
    ("longrange", "Long-Range Explorer", "Advanced", "35 min", "90 km/h", "4K + GPS mapping", 840, "Big battery, efficient motors and GPS — built for flying far and mapping wide areas."),
]

# The ready-made items.
READY_MADE = [
    ("DJI Mini 4 Pro", "DJI", 759, "249 g", "4K/60 HDR", "Beginners and travel"),
    ("DJI Air 3S", "DJI", 1099, "724 g", "Dual 4K/60", "Long flights and sunsets"),
    ("DJI Avata 2", "DJI", 999, "377 g", "4K/60 FPV", "Immersive FPV flying"),
    ("Autel EVO Lite+", "Autel", 1149, "835 g", "6K/30", "Low-light video"),
    ("Skydio 2+", "Skydio", 1099, "775 g", "4K/60", "Hands-free subject tracking"),
    ("HOVERAir X1", "HOVERAir", 349, "192 g", "2.7K selfie", "Pocket selfies"),
]

# The plans (limits, where infinity is unlimited; prices; name).
PLANS = [
    ("free", "Free", 10.0, 3.0, 0.0, "0", "0", "0", "Community support"),
    ("pro", "Pro", 100.0, 50.0, 20.0, "19", "15.2", "182.4", "Email support"),
    ("team", "Team", 500.0, float("inf"), float("inf"), "49", "39.2", "470.4", "Priority support"),
]

# The questionnaire's colors, styles and budgets.
COLORS = ["Sky Blue", "Midnight Black", "Arctic White", "Racing Red", "Sunset Orange", "Forest Green"]
STYLES = ["FPV", "Cinematic", "Racing", "Long Range"]
BUDGET_MIN, BUDGET_MAX, BUDGET_STEP, BUDGET_DEFAULT = 300, 3000, 50, 1000

_PRODUCT_COLUMNS = [c.split()[0] for c in PRODUCT_SCHEMA.split(", ")]
PRODUCT_ROWS = [tuple({"no": no, **p, "price": Decimal(p["price"])}.get(c) for c in _PRODUCT_COLUMNS) for no, p in enumerate(PRODUCTS)]


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """``rows`` as a local relation: its size is known to the optimizer, which then broadcasts it by itself."""
    fields = to_arrow_schema(StructType.fromDDL(schema))
    columns = [pa.array(list(values), f.type) for values, f in zip(zip(*rows, strict=True), fields, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields))


def products(spark: SparkSession) -> DataFrame:
    return literal(spark, PRODUCT_ROWS, PRODUCT_SCHEMA)


def product_index(products: DataFrame) -> DataFrame:
    """One row for each id; of repeated ids the last row (by ``no``) counts."""
    from pyspark.sql import functions as F

    others = [c for c in products.columns if c != "id"]
    return products.groupBy("id").agg(F.max_by(F.struct(*others), "no").alias("p")).select("id", "p.*")


def categories(spark: SparkSession) -> DataFrame:
    return literal(spark, [(i, c, label) for i, (c, label) in enumerate(CATEGORIES)], "ord int, category string, label string")


def presets(spark: SparkSession) -> DataFrame:
    """The presets with their selection as a map from slot to product id."""
    rows = [(key, name, list(zip(SLOTS, ids, strict=True))) for key, name, ids in PRESETS]
    return literal(spark, rows, "key string, name string, selection map<string,string>")


def parts(spark: SparkSession) -> DataFrame:
    return literal(spark, [(i, *p) for i, p in enumerate(PARTS)], "no int, id string, name string, price int, essential boolean, role string")


def templates(spark: SparkSession) -> DataFrame:
    return literal(spark, TEMPLATES, "id string, name string, level string, flight_time string, top_speed string, camera string, price int, blurb string")


def ready_made(spark: SparkSession) -> DataFrame:
    return literal(spark, READY_MADE, "name string, brand string, price int, weight string, camera string, best_for string")


def plans(spark: SparkSession) -> DataFrame:
    rows = [(*p[:5], *map(Decimal, p[5:8]), p[8]) for p in PLANS]
    return literal(
        spark, rows, "plan string, plan_name string, ai_builds double, saved_builds double, exports double, monthly decimal(10,2), yearly_monthly decimal(10,2), yearly_total decimal(10,2), support string"
    )


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float) and value == float("inf"):
        return "'Infinity'::DOUBLE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """``name(columns) AS (VALUES ...)`` for a WITH clause."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


PRODUCTS_SQL = values_sql("products", ", ".join(_PRODUCT_COLUMNS).replace("current", '"current"'), PRODUCT_ROWS)
CATEGORIES_SQL = values_sql("categories", "ord, category, label", [(i, *c) for i, c in enumerate(CATEGORIES)])
PARTS_SQL = values_sql("parts", "no, id, name, price, essential, role", [(i, *p) for i, p in enumerate(PARTS)])
PLANS_SQL = values_sql("plans", "plan, plan_name, ai_builds, saved_builds, exports, monthly, yearly_monthly, yearly_total, support", [(*p[:5], *map(Decimal, p[5:8]), p[8]) for p in PLANS])
TEMPLATES_SQL = values_sql("templates", "id, name, level, flight_time, top_speed, camera, price, blurb", TEMPLATES)
READY_MADE_SQL = values_sql("ready_made", "name, brand, price, weight, camera, best_for", READY_MADE)
PRESETS_SQL = values_sql("presets", "key, name, " + ", ".join(f"s{i}" for i in range(8)), [(k, n, *ids) for k, n, ids in PRESETS])
