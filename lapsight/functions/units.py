"""Conversion of values with units to SI."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symbol, dimension, factor to SI, SI symbol.
UNITS = (
    ("1", "dimensionless", 1.0, "1"),
    ("%", "dimensionless", 0.01, "1"),
    ("kg", "mass", 1.0, "kg"),
    ("kg*m^2", "rotational_inertia", 1.0, "kg*m^2"),
    ("kg/m^3", "density", 1.0, "kg/m^3"),
    ("g", "mass", 1e-3, "kg"),
    ("m", "length", 1.0, "m"),
    ("cm", "length", 1e-2, "m"),
    ("mm", "length", 1e-3, "m"),
    ("in", "length", 0.0254, "m"),
    ("ft", "length", 0.3048, "m"),
    ("s", "time", 1.0, "s"),
    ("ms", "time", 1e-3, "s"),
    ("m/s", "speed", 1.0, "m/s"),
    ("m/s^2", "acceleration", 1.0, "m/s^2"),
    ("km/h", "speed", 1.0 / 3.6, "m/s"),
    ("mph", "speed", 0.44704, "m/s"),
    ("m^2", "area", 1.0, "m^2"),
    ("cm^2", "area", 1e-4, "m^2"),
    ("N", "force", 1.0, "N"),
    ("N*s/m", "slip_stiffness", 1.0, "N*s/m"),
    ("N*m", "torque", 1.0, "N*m"),
    ("J", "energy", 1.0, "J"),
    ("J/kg", "specific_energy", 1.0, "J/kg"),
    ("J/(kg*m)", "specific_energy_per_distance", 1.0, "J/(kg*m)"),
    ("kJ", "energy", 1e3, "J"),
    ("W", "power", 1.0, "W"),
    ("kW", "power", 1e3, "W"),
    ("hp", "power", 745.6998715822702, "W"),
    ("rad/s", "angular_speed", 1.0, "rad/s"),
    ("rpm", "angular_speed", 2.0 * math.pi / 60.0, "rad/s"),
    ("deg", "angle", math.pi / 180.0, "rad"),
    ("rad", "angle", 1.0, "rad"),
)

#: Other spellings, in lower case.
ALIASES = {
    "": "1",
    "dimensionless": "1",
    "ratio": "1",
    "m2": "m^2",
    "m²": "m^2",
    "nm": "N*m",
    "kg m^2": "kg*m^2",
    "kg·m^2": "kg*m^2",
    "n/(m/s)": "N*s/m",
    "n s/m": "N*s/m",
    "j/kg/m": "J/(kg*m)",
    "n·m": "N*m",
    "n*m": "N*m",
    "kph": "km/h",
    "kmh": "km/h",
    "horsepower": "hp",
}


def unit_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(UNITS), "unit string, dimension string, to_si double, si_unit string")


def normal_unit(unit: Column) -> Column:
    plain = F.trim(unit)
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(plain)), plain)


def with_si(rows: DataFrame, value: str, unit: str) -> DataFrame:
    """``rows`` with si_value, si_unit and dimension; null where the unit is unknown.

    The unit table has a fixed, small number of rows, so it is broadcast.
    """
    table = F.broadcast(unit_table(rows.sparkSession).withColumnRenamed("unit", "__unit"))
    return (
        rows.withColumn("__key", normal_unit(F.col(unit)))
        .join(table, F.col("__key") == F.col("__unit"), "left")
        .withColumn("si_value", F.col(value) * F.col("to_si"))
        .drop("__key", "__unit", "to_si")
    )


def wrong_dimension(rows: DataFrame, unit: str, expected: str) -> DataFrame:
    """Rows whose unit is unknown or of another dimension than the column ``expected`` says."""
    found = with_si(rows.withColumn("__one", F.lit(1.0)), "__one", unit)
    return found.where(F.col("dimension").isNull() | (F.col("dimension") != F.col(expected))).drop("__one", "si_value", "si_unit")
