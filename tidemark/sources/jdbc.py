"""Tables and queries of a database, read and written through JDBC."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Split:
    """How to read in parallel: ranges of a numeric, date or timestamp column."""

    column: str
    lower: str
    upper: str
    parts: int


@dataclass(frozen=True)
class Database:
    url: str
    properties: dict[str, str] = field(default_factory=dict)

    def query(self, spark: SparkSession, sql: str, split: Split | None = None) -> DataFrame:
        """The result of a SQL query.

        Without a split one task reads everything, which suits results that
        the database has made small.
        """
        return spark.read.format("jdbc").options(**self.query_options(sql, split)).load()

    def query_options(self, sql: str, split: Split | None = None) -> dict[str, str]:
        options = {"url": self.url, **self.properties}
        if split is None:
            return {**options, "query": sql}
        return {
            **options,
            "dbtable": f"({sql}) q",
            "partitionColumn": split.column,
            "lowerBound": split.lower,
            "upperBound": split.upper,
            "numPartitions": str(split.parts),
        }

    def append(self, rows: DataFrame, table: str) -> None:
        rows.write.jdbc(self.url, table, mode="append", properties=self.properties)

    def replace(self, rows: DataFrame, table: str) -> None:
        """Empty the table and fill it anew; its definition stays."""
        writer = rows.write.option("truncate", True)
        writer.jdbc(self.url, table, mode="overwrite", properties=self.properties)

    def truncate(self, spark: SparkSession, table: str) -> None:
        """Empty the table."""
        nothing = spark.read.jdbc(self.url, table, properties=self.properties).limit(0)
        self.replace(nothing, table)
