"""Statistics in a database over JDBC, each batch once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


class JdbcSink:
    """A table of a database that takes batches by the sink's column order, each exactly once.

    Tasks write a batch to a staging table of its own; then one transaction copies it to the table and notes the batch in a
    ledger, whose key refuses a second note. A batch that is noted writes nothing. What dies before the transaction leaves a
    staging table, which the batch overwrites when it runs again.
    """

    LEDGER = "batch_ledger"

    def __init__(self, spark: SparkSession, url: str, table: str, columns: Sequence[str], writer: str = "", **options: str):
        self.spark, self.url, self.table, self.columns, self.writer, self.options = spark, url, table, list(columns), writer or table, options

    def _run(self, *statements: str) -> None:
        """Statements in one transaction."""
        connection = self._connect()
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            for x in statements:
                statement.executeUpdate(x)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def _connect(self):
        found = self.spark._jvm.java.util.Properties()
        for k, v in self.options.items():
            found.setProperty(k, v)
        return self.spark._jvm.java.sql.DriverManager.getConnection(self.url, found)

    def _tables(self) -> tuple[set[str], str]:
        """The database's tables in lower case, and what quotes names."""
        connection = self._connect()
        try:
            meta, found = connection.getMetaData(), set()
            rows = meta.getTables(None, None, None, None)
            while rows.next():
                found.add(rows.getString("TABLE_NAME").lower())
            return found, meta.getIdentifierQuoteString().strip()
        finally:
            connection.close()

    def noted(self, batch: int) -> bool:
        if self.LEDGER not in self._tables()[0]:
            return False
        connection = self._connect()
        try:
            asked = connection.prepareStatement(f"SELECT batch FROM {self.LEDGER} WHERE writer = ? AND batch = ?")
            asked.setString(1, self.writer)
            asked.setLong(2, batch)
            return bool(asked.executeQuery().next())
        finally:
            connection.close()

    def write(self, rows: DataFrame, batch: int) -> None:
        """Adds a batch's rows; other columns than the sink's are transient and left out. A batch that is there is computed, since
        a stream's state is to be committed, and not written."""
        if self.noted(batch):
            rows.write.format("noop").mode("overwrite").save()
            return
        staging, columns = f"{self.table}_staging", rows.select(*self.columns)
        columns.write.format("jdbc").options(url=self.url, dbtable=staging, **self.options).mode("overwrite").save()
        found, quote = self._tables()
        if self.LEDGER not in found:
            self._run(f"CREATE TABLE {self.LEDGER} (writer VARCHAR(200) NOT NULL, batch BIGINT NOT NULL, PRIMARY KEY (writer, batch))")
        if self.table.lower() not in found:
            columns.limit(0).write.format("jdbc").options(url=self.url, dbtable=self.table, **self.options).mode("append").save()
        names = ", ".join(f"{quote}{c}{quote}" for c in self.columns)
        writer = self.writer.replace("'", "''")
        self._run(f"INSERT INTO {self.table} ({names}) SELECT {names} FROM {staging}", f"INSERT INTO {self.LEDGER} VALUES ('{writer}', {batch})")
        self._run(f"DROP TABLE {staging}")
