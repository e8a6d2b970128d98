"""Table functions for SQL: the chunks of a text, and the rules of robots files given as lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from weftline.operators.robots import parse_body


class SplitChunks:
    """``split_chunks(content, size)``: (chunk_index, chunk), one empty chunk of an empty text, none of a null. With a third
    argument, the name of a unit (``chars`` or ``words``), sizes are in that, and words come as an array."""

    @staticmethod
    def analyze(content: AnalyzeArgument, size: AnalyzeArgument, unit: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(content.dataType, StringType):
            raise ValueError("split_chunks needs a text")
        if unit is not None and unit.value not in ("chars", "words"):
            raise ValueError("the unit of split_chunks is 'chars' or 'words'")
        chunk = ArrayType(StringType()) if unit is not None and unit.value == "words" else StringType()
        return AnalyzeResult(StructType().add("chunk_index", IntegerType()).add("chunk", chunk))

    def eval(self, content: str | None, size: int | None, unit: str = "chars") -> Iterator[tuple]:
        if content is None or size is None:
            return
        if size < 1:
            raise ValueError("the size of chunks must be positive")
        parts = content.split() if unit == "words" else content
        for i in range(max(1, -(-len(parts) // size))):
            yield i, parts[i * size : (i + 1) * size]


class RobotsRules:
    """``robots_rules(TABLE(lines))`` of a table (host, line_no, line): (host, agent, agent_seq, crawl_delay, rule_seq, path,
    allow). The function itself asks for a partition by host, in the order of lines; a file is folded line by line."""

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable or not {"host", "line_no", "line"} <= {f.name for f in lines.dataType.fields}:
            raise ValueError("robots_rules needs a table with host, line_no and line")
        columns = {"host": StringType(), "agent": StringType(), "agent_seq": IntegerType(), "crawl_delay": DoubleType(), "rule_seq": IntegerType(), "path": StringType(), "allow": BooleanType()}
        return AnalyzeResult(StructType([StructField(*c) for c in columns.items()]), partitionBy=[PartitioningColumn("host")], orderBy=[OrderingColumn("line_no")])

    def __init__(self):
        self.host, self.lines = None, []

    def eval(self, row: Row) -> None:
        self.host = row["host"]
        self.lines.append(row["line"] or "")

    def terminate(self) -> Iterator[tuple]:
        for g in parse_body("\n".join(self.lines))["groups"]:
            for r in g["rules"]:
                yield self.host, g["agent"], g["agent_seq"], g["crawl_delay"], r["rule_seq"], r["path"], r["allow"]


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    spark.udtf.register("split_chunks", udtf(SplitChunks))
    spark.udtf.register("robots_rules", udtf(RobotsRules))
