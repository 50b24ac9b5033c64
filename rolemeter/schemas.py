"""Schemas of the inputs and of the flat result tables."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

RESUMES = T.StructType([
    T.StructField("resume_id", T.LongType()),
    T.StructField("target_role", T.StringType()),
    T.StructField("text", T.StringType()),
])

PAGES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("page_text", T.StringType()),
])

# Weight is read as text so that 0.3 and "0.3" both arrive; the source casts it to DOUBLE.
PROFILE_JSON = T.MapType(
    T.StringType(),
    T.StructType([
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("skills", T.MapType(
            T.StringType(),
            T.StructType([
                T.StructField("weight", T.StringType()),
                T.StructField("description", T.StringType()),
                T.StructField("keywords", T.ArrayType(T.StringType())),
            ]),
        )),
    ]),
)

ROLE_SKILLS = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("role_ord", T.IntegerType()),
    T.StructField("skill", T.StringType()),
    T.StructField("skill_ord", T.IntegerType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("description", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
])

CURRICULUM = T.StructType([
    T.StructField("skill", T.StringType()),
    T.StructField("fundamentals", T.StringType()),
    T.StructField("applied", T.StringType()),
    T.StructField("project", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
])

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])
