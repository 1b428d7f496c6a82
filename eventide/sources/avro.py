"""Avro schemas of event tables, and tables' schemas from Avro ones; no Avro library is needed."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructField, StructType, TimestampNTZType, TimestampType

#: Spark type, Avro type, logical type.
SIMPLE = (
    (BooleanType(), "boolean", None),
    (IntegerType(), "int", None),
    (LongType(), "long", None),
    (FloatType(), "float", None),
    (DoubleType(), "double", None),
    (StringType(), "string", None),
    (BinaryType(), "bytes", None),
    (DateType(), "int", "date"),
    (TimestampType(), "long", "timestamp-micros"),
    (TimestampNTZType(), "long", "local-timestamp-micros"),
)


def to_avro(schema: StructType, name: str = "event", namespace: str = "") -> dict[str, Any]:
    """The Avro record schema of rows; what may be null is a union with null, null first and the default."""

    def record(kind: StructType, own: str) -> dict[str, Any]:
        fields = []
        for f in kind:
            if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", f.name):
                raise ValueError(f"{f.name!r} is no name in Avro")
            made = of(f.dataType, f"{own}_{f.name}")
            fields.append({"name": f.name, "type": ["null", made], "default": None} if f.nullable else {"name": f.name, "type": made})
        return {"type": "record", "name": own, "fields": fields}

    def of(kind: DataType, own: str) -> Any:
        for spark, avro, logical in SIMPLE:
            if kind == spark:
                return {"type": avro, "logicalType": logical} if logical else avro
        if isinstance(kind, (ByteType, ShortType)):
            return "int"
        if isinstance(kind, DecimalType):
            return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
        if isinstance(kind, StructType):
            return record(kind, own)
        if isinstance(kind, ArrayType):
            inner = of(kind.elementType, own)
            return {"type": "array", "items": ["null", inner] if kind.containsNull else inner}
        if isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
            inner = of(kind.valueType, own)
            return {"type": "map", "values": ["null", inner] if kind.valueContainsNull else inner}
        raise TypeError(f"{kind.simpleString()} has no Avro type")

    found = record(schema, name)
    return found | {"namespace": namespace} if namespace else found


def from_avro(schema: dict[str, Any]) -> StructType:
    """The schema of rows for an Avro record schema; unions of null and one type are nullable."""

    def of(avro: Any) -> tuple[DataType, bool]:
        if isinstance(avro, list):
            kinds = [x for x in avro if x != "null"]
            if len(kinds) != 1:
                raise TypeError(f"a union of {len(kinds)} types has no column type")
            return of(kinds[0])[0], len(kinds) < len(avro)
        name, logical = (avro["type"], avro.get("logicalType")) if isinstance(avro, dict) else (avro, None)
        if name == "record":
            return StructType([StructField(f["name"], *of(f["type"])) for f in avro["fields"]]), False
        if name == "array":
            return ArrayType(*of(avro["items"])), False
        if name == "map":
            return MapType(StringType(), *of(avro["values"])), False
        if name == "enum":
            return StringType(), False
        if name == "fixed":
            name = "bytes"
        if logical == "decimal":
            return DecimalType(avro["precision"], avro.get("scale", 0)), False
        if logical in ("timestamp-millis", "timestamp-micros"):
            return TimestampType(), False
        for spark, kind, own in SIMPLE:
            if kind == name and own == (logical if logical in ("date", "local-timestamp-micros") else None):
                return spark, False
        raise TypeError(f"{avro} has no column type")

    found, _ = of(schema)
    if not isinstance(found, StructType):
        raise TypeError("a table needs a record")
    return found
