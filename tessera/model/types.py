"""Names of column types: Python builtins, dataframe-style names and Spark DDL, all resolved to Spark types."""

from __future__ import annotations

import ast
import datetime as dt

from pyspark.sql import types as T

_SIMPLE: dict[str, T.DataType] = {
    "int": T.LongType(),
    "float": T.DoubleType(),
    "str": T.StringType(),
    "string": T.StringType(),
    "utf8": T.StringType(),
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "bytes": T.BinaryType(),
    "binary": T.BinaryType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "duration": T.DayTimeIntervalType(),
    "categorical": T.StringType(),
    "enum": T.StringType(),
    "decimal": T.DecimalType(38, 18),
}
# Spark's own names, as far as they do not mean something else above ("float" is a double here, "int" a long).
_DDL: dict[str, T.DataType] = {
    "tinyint": T.ByteType(),
    "smallint": T.ShortType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "interval day to second": T.DayTimeIntervalType(),
}
_BUILTIN = {int: "int", float: "float", str: "str", bool: "bool", bytes: "bytes", dt.datetime: "datetime", dt.date: "date", dt.timedelta: "duration"}
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (*INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def resolve(name: object) -> T.DataType:
    """The Spark type of a name such as ``int``, ``Float32``, ``Datetime(time_unit='us', time_zone='UTC')`` or DDL.

    Unsigned types become the next wider signed one; units of time other than microseconds become microseconds. Calls are
    parsed as syntax and never evaluated.
    """
    if isinstance(name, T.DataType):
        return name
    if isinstance(name, type):
        if issubclass(name, T.DataType):
            return name()
        name = _BUILTIN.get(name, name.__name__)
    text = str(name).strip()
    if text.startswith("<class '"):
        text = text.removeprefix("<class '").removesuffix("'>").rpartition(".")[2]
    if found := _SIMPLE.get(text.lower()):
        return found
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError:
        tree = None
    if isinstance(tree, ast.Call) and isinstance(tree.func, ast.Name):
        kind = tree.func.id.lower()
        if kind == "datetime":
            zones = [k.value for k in tree.keywords if k.arg == "time_zone"] + tree.args[1:2]
            zoned = any(not (isinstance(z, ast.Constant) and z.value is None) for z in zones)
            return T.TimestampType() if zoned else T.TimestampNTZType()
        if kind in ("list", "array") and tree.args:
            return T.ArrayType(resolve(ast.unparse(tree.args[0])))
        if kind == "duration":
            return T.DayTimeIntervalType()
        if kind in ("decimal", "enum", "categorical"):
            sizes = [a.value for a in [*tree.args, *(k.value for k in tree.keywords)] if isinstance(a, ast.Constant)]
            return T.DecimalType(*sizes[:2]) if kind == "decimal" and sizes and all(isinstance(x, int) for x in sizes[:2]) else _SIMPLE[kind]
    if text.startswith("array<") and text.endswith(">"):
        return T.ArrayType(resolve(text[6:-1]))
    if text in _DDL:
        return _DDL[text]
    try:
        return T.DataType.fromDDL(text)
    except Exception as e:
        raise ValueError(f"Type: '{text}' is not known") from e


_SHOWN = {
    "LongType": "int",
    "DoubleType": "float",
    "StringType": "str",
    "BooleanType": "bool",
    "ByteType": "Int8",
    "ShortType": "Int16",
    "IntegerType": "Int32",
    "FloatType": "Float32",
    "BinaryType": "Binary",
    "DateType": "Date",
    "TimestampNTZType": "Datetime(time_unit='us')",
    "TimestampType": "Datetime(time_unit='us', time_zone='UTC')",
    "DayTimeIntervalType": "Duration(time_unit='us')",
}


def show(kind: T.DataType) -> str:
    """The name under which a type is written to spec files; ``resolve`` reads it back."""
    if isinstance(kind, T.DecimalType):
        return f"Decimal({kind.precision}, {kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"List({show(kind.elementType)})"
    return _SHOWN.get(type(kind).__name__, kind.simpleString())


def is_string(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def matches(kind: T.DataType, wanted: T.DataType, strict: bool = True) -> bool:
    """Whether a column of ``kind`` meets a declared type; lenient: any width of the same family will do."""
    if kind == wanted or not strict and any(isinstance(kind, f) and isinstance(wanted, f) for f in (INTEGRAL, (T.FloatType, T.DoubleType), TEMPORAL)):
        return True
    return is_string(kind) and is_string(wanted)


def to_python(kind: T.DataType, value: object) -> object:
    """A value from a spec file as the Python value of a type."""
    if value is None:
        return None
    if isinstance(kind, INTEGRAL):
        return int(value)
    if is_floating(kind):
        return float(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and isinstance(value, str):
        return dt.datetime.fromisoformat(value)
    if isinstance(kind, T.DateType) and isinstance(value, str):
        return dt.date.fromisoformat(value)
    return str(value) if is_string(kind) else value
