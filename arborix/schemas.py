"""Schemas of the tables that the operators read and write."""

from pyspark.sql import types as T

SWC_NODE = T.StructType([
    T.StructField("skel", T.StringType()), T.StructField("node_id", T.IntegerType()), T.StructField("node_type", T.IntegerType()),
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("z", T.DoubleType()),
    T.StructField("diameter", T.DoubleType()), T.StructField("parent_id", T.IntegerType()),
])
FRAG_COLOR = T.StructType([T.StructField("lm_vol", T.StringType()), T.StructField("frag_id", T.IntegerType()), *(T.StructField(c, T.IntegerType()) for c in "rgb")])
#: em -> "<volume>_<fragment>" -> scores
SCORES = T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))
#: volume -> fragment -> "[r, g, b]"
COLORS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
REPORT_ROW = T.StructType([T.StructField("em", T.StringType()), T.StructField("line_name", T.StringType()), T.StructField("slide_code", T.StringType()), T.StructField("rank", T.IntegerType())])
