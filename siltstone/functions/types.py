"""Spark types as objects: a type string would need a session when the module is imported."""

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

LONG, INT, STRING, BINARY, DOUBLE, BOOL = LongType(), IntegerType(), StringType(), BinaryType(), DoubleType(), BooleanType()


def array(t):
    return ArrayType(t)


def struct(**fields):
    return StructType([StructField(k, v) for k, v in fields.items()])
