"""The engine's tables as explicit Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

CODE_CHUNKS = T.StructType(
    [
        T.StructField("qualified_name", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("summary", T.StringType()),
        T.StructField("filepath", T.StringType(), False),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("language", T.StringType(), False),
        T.StructField("module_path", T.StringType()),
        T.StructField("docstring", T.StringType()),
        T.StructField("calls", T.ArrayType(T.StringType())),
        T.StructField("called_by", T.ArrayType(T.StringType())),
        T.StructField("imports", T.MapType(T.StringType(), T.StringType())),
        T.StructField("includes", T.ArrayType(T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
CALL_EDGES = T.StructType([T.StructField("caller_qn", T.StringType(), False), T.StructField("callee_qn", T.StringType(), False)])
FILE_STATE = T.StructType([T.StructField("rel_path", T.StringType(), False), T.StructField("md5", T.StringType(), False)])
FRAME = "struct<filepath:string,line_number:int,function_name:string,code_snippet:string,error_type:string,error_message:string,language:string>"
FRAMES = f"array<{FRAME}>"
#: What a parser returns for one file.
PARSED = (
    "qualified_name string, name string, type string, content string, filepath string, start_line int, language string, "
    "module_path string, calls array<string>, imports map<string,string>, includes array<string>, status string"
)
