"""Tables and queries over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# JDBC address and driver class of each supported database.
DATABASES = {
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306, "com.mysql.cj.jdbc.Driver"),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", 1521, "oracle.jdbc.OracleDriver"),
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", 5432, "org.postgresql.Driver"),
    "sqlserver": (
        "jdbc:sqlserver://{host}:{port};databaseName={database}",
        1433,
        "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    ),
}


def jdbc_options(
    kind: str, host: str, database: str, user: str, password: str, port: int | None = None
) -> dict[str, str]:
    """Connection options for one of the supported databases."""
    if kind not in DATABASES:
        raise ValueError(f"unknown database {kind!r}, use one of {sorted(DATABASES)}")
    address, default_port, driver = DATABASES[kind]
    url = address.format(host=host, port=port or default_port, database=database)
    return {"url": url, "driver": driver, "user": user, "password": password}


def read_options(
    query: str | None = None,
    table: str | None = None,
    partition_column: str | None = None,
    lower_bound=None,
    upper_bound=None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options for a query or a table, read in parallel when a column is given.

    Spark partitions only tables, so a partitioned query becomes a derived table.
    """
    if (query is None) == (table is None):
        raise ValueError("give either query or table")
    options = {"fetchsize": str(fetch_size)}
    split = [partition_column, lower_bound, upper_bound, partitions]
    if all(v is None for v in split):
        return options | ({"query": query} if query else {"dbtable": table})
    if any(v is None for v in split):
        raise ValueError("a parallel read needs partition_column, lower_bound, upper_bound and partitions")
    source = table or f"({query.strip().rstrip(';')}) q"
    return options | {
        "dbtable": source,
        "partitionColumn": partition_column,
        "lowerBound": str(lower_bound),
        "upperBound": str(upper_bound),
        "numPartitions": str(partitions),
    }


def read_database(spark: SparkSession, connection: dict[str, str], **what) -> DataFrame:
    """Read a query or table; ``what`` is passed to :func:`read_options`."""
    return spark.read.format("jdbc").options(**connection, **read_options(**what)).load()
