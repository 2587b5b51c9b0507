"""Standard tables of an observation: their columns, a check of tables against them, and a synthetic set.

Column types: b boolean, i integer, d double, f float, c complex, s string; a number behind gives the rank.
"""

from __future__ import annotations

from pyspark.sql import types as T

from ..plans.lower import ROW
from ..table import Table
from .catalog import Catalog, ObservationSet

#: Columns of the standard tables as "NAME type [unit]".
STANDARD = {
    "MAIN": "TIME d s, ANTENNA1 i, ANTENNA2 i, FEED1 i, FEED2 i, DATA_DESC_ID i, PROCESSOR_ID i, FIELD_ID i, INTERVAL d s, EXPOSURE d s, TIME_CENTROID d s, SCAN_NUMBER i, ARRAY_ID i, OBSERVATION_ID i, STATE_ID i, UVW d1 m, SIGMA f1, WEIGHT f1, FLAG b2, FLAG_ROW b",
    "ANTENNA": "NAME s, STATION s, TYPE s, MOUNT s, POSITION d1 m, OFFSET d1 m, DISH_DIAMETER d m, FLAG_ROW b",
    "DATA_DESCRIPTION": "SPECTRAL_WINDOW_ID i, POLARIZATION_ID i, FLAG_ROW b",
    "FIELD": "NAME s, CODE s, TIME d s, NUM_POLY i, DELAY_DIR d2 rad, PHASE_DIR d2 rad, REFERENCE_DIR d2 rad, SOURCE_ID i, FLAG_ROW b",
    "OBSERVATION": "TELESCOPE_NAME s, TIME_RANGE d1 s, OBSERVER s, LOG s1, SCHEDULE_TYPE s, SCHEDULE s1, PROJECT s, RELEASE_DATE d s, FLAG_ROW b",
    "POLARIZATION": "NUM_CORR i, CORR_TYPE i1, CORR_PRODUCT i2, FLAG_ROW b",
    "SPECTRAL_WINDOW": "NUM_CHAN i, NAME s, REF_FREQUENCY d Hz, CHAN_FREQ d1 Hz, CHAN_WIDTH d1 Hz, MEAS_FREQ_REF i, EFFECTIVE_BW d1 Hz, RESOLUTION d1 Hz, TOTAL_BANDWIDTH d Hz, NET_SIDEBAND i, IF_CONV_CHAIN i, FREQ_GROUP i, FREQ_GROUP_NAME s, FLAG_ROW b",
    "STATE": "SIG b, REF b, CAL d K, LOAD d K, SUB_SCAN i, OBS_MODE s, FLAG_ROW b",
}
_KINDS = {"b": T.BooleanType(), "i": T.IntegerType(), "d": T.DoubleType(), "f": T.FloatType(), "s": T.StringType(), "c": T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])}


def standard_schema(name: str) -> T.StructType:
    """The columns that a standard table needs."""
    out = []
    for item in STANDARD[name].split(", "):
        column, kind, *unit = item.split(" ")
        e = _KINDS[kind[0]]
        rank = int(kind[1:] or 0)
        whole = e if not rank else T.ArrayType(e) if rank == 1 else T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(e))])
        out.append(T.StructField(column, whole, True, {"unit": unit[0]} if unit else {}))
    return T.StructType(out)


def validate(o: ObservationSet) -> list[str]:
    """What differs from the standard: missing tables and columns, other types.  Nothing is raised."""
    out, there = [], set(o.catalog.names())
    for name in STANDARD:
        stored = o.main_name if name == "MAIN" else name
        if stored not in there:
            out.append(f"no table {name}")
            continue
        schema = o.catalog.table(stored).data().schema
        for f in standard_schema(name).fields:
            if f.name not in schema.names:
                out.append(f"{name}: no column {f.name}")
            elif schema[f.name].dataType.simpleString() != f.dataType.simpleString():
                out.append(f"{name}: {f.name} is {schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return out


def create(catalog: Catalog, *, rows: int = 10, channels: int = 4, correlations: int = 2, antennas: int = 3) -> ObservationSet:
    """A synthetic observation: baselines in turn, all data zero, dimension tables of the given sizes."""
    from pyspark.sql import functions as F

    spark = catalog.spark

    def cell(f: T.StructField):
        from ..operators.dml import _default

        return _default(f.dataType).alias(f.name, metadata=f.metadata)

    def save(name: str, n: int, **values) -> None:
        base = spark.range(n)
        columns = [values[f.name].cast(f.dataType).alias(f.name, metadata=f.metadata) if f.name in values else cell(f) for f in standard_schema("MAIN" if name == "MAIN" else name).fields]
        extra = [v.alias(k) for k, v in values.items() if k not in standard_schema(name).names]
        catalog.save(name, Table(base.select(*columns, *extra, F.col("id").alias(ROW))), new=True)

    i = F.col("id")
    pairs = [(a, b) for a in range(antennas) for b in range(a + 1, antennas)] or [(0, 0)]
    pick = lambda k: F.element_at(F.array(*(F.lit(p[k]) for p in pairs)), (i % len(pairs) + 1).cast("int"))
    size = channels * correlations
    shape = F.array(F.lit(correlations), F.lit(channels)).alias("shape")
    zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    save("MAIN", rows, TIME=F.lit(5e9) + F.floor(i / len(pairs)) * 10.0, ANTENNA1=pick(0), ANTENNA2=pick(1), INTERVAL=F.lit(10.0), EXPOSURE=F.lit(10.0), UVW=F.array(*(F.lit(0.0),) * 3),
         WEIGHT=F.array_repeat(F.lit(1.0), correlations), SIGMA=F.array_repeat(F.lit(1.0), correlations), FLAG=F.struct(shape, F.array_repeat(F.lit(False), size).alias("data")),
         DATA=F.struct(shape, F.array_repeat(zero, size).alias("data")))
    save("ANTENNA", antennas, NAME=F.concat(F.lit("ANT"), i), MOUNT=F.lit("ALT-AZ"), POSITION=F.array(i * 100.0, F.lit(0.0), F.lit(0.0)), DISH_DIAMETER=F.lit(25.0))
    save("DATA_DESCRIPTION", 1)
    save("FIELD", 1, NAME=F.lit("FIELD0"))
    save("OBSERVATION", 1, TELESCOPE_NAME=F.lit("VLA"))
    save("POLARIZATION", 1, NUM_CORR=F.lit(correlations), CORR_TYPE=F.array(*(F.lit(5 + k) for k in range(correlations))))
    freq = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda k: F.lit(1.4e9) + k * 1e6)
    save("SPECTRAL_WINDOW", 1, NUM_CHAN=F.lit(channels), REF_FREQUENCY=F.lit(1.4e9), CHAN_FREQ=freq, CHAN_WIDTH=F.array_repeat(F.lit(1e6), channels), TOTAL_BANDWIDTH=F.lit(1e6 * channels))
    save("STATE", 1, OBS_MODE=F.lit("OBSERVE_TARGET"))
    return ObservationSet(catalog)
