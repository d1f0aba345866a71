"""Tables: replicated (read-only Parquet) and local ones, and what SHOW and information_schema say of them."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import shared_dir

_MYSQL_TYPES = {"long": "bigint", "integer": "int", "short": "smallint", "byte": "tinyint", "double": "double", "float": "float", "string": "varchar", "boolean": "tinyint", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "date", "binary": "varbinary"}


@dataclass
class Table:
    """A table's name, frame and keys; columns that rows of older files lack have defaults."""

    name: str
    frame: DataFrame
    primary: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    local: bool = False
    defaults: dict[str, object] = field(default_factory=dict)
    #: Folders of a local table's rows, one for each INSERT, below the folder shared by the cluster.
    parts: list[str] = field(default_factory=list)
    #: The declared schema of a local table: files don't keep NOT NULL.
    schema: T.StructType | None = None


def mysql_type(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision},{kind.scale})"
    return _MYSQL_TYPES.get(kind.typeName(), "json")


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.folder = f"{shared_dir(spark)}/quern-local/{uuid.uuid4().hex}"

    def add(self, table: Table) -> Table:
        missing = {c: v for c, v in table.defaults.items() if c not in table.frame.columns}
        if missing:
            table.frame = table.frame.withColumns({c: F.lit(v) for c, v in missing.items()})
        self.tables[table.name] = table
        table.frame.createOrReplaceTempView(table.name)
        return table

    def close(self) -> None:
        """Deletes the rows of local tables, which end with the session."""
        for name in [t.name for t in self.tables.values() if t.local]:
            self.spark.catalog.dropTempView(name)
            del self.tables[name]
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def databases(self) -> list[str]:
        return ["main", "information_schema"]

    def add_parquet(self, name: str, path: str, primary: tuple[str, ...] = (), defaults: dict[str, object] | None = None) -> Table:
        return self.add(Table(name, self.spark.read.parquet(path), primary, defaults=defaults or {}))

    def write(self, sql: str) -> DataFrame:
        """CREATE TABLE and INSERT of local tables, with MySQL's errors for keys and NOT NULL."""
        if m := re.match(r"\s*CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?`?(\w+)`?\s*\((.*)\)[^)]*$", sql, re.I | re.S):
            if m[2] in self.tables:
                if m[1]:
                    return self._ok()
                raise ValueError(f"1050: table {m[2]} exists")
            columns, primary = [], ()
            for part in re.split(r",(?![^(]*\))", m[3]):
                if key := re.match(r"\s*PRIMARY\s+KEY\s*\(([^)]*)\)", part, re.I):
                    primary = tuple(c.strip(" `") for c in key[1].split(","))
                    continue
                c = re.match(r"\s*`?(\w+)`?\s+(\w+)\s*(\(\s*[\d\s,]+\))?(.*)$", part, re.S)
                if not c:
                    raise ValueError(f"1064: {part}")
                kind = self._type(c[2].upper(), c[3], "UNSIGNED" in c[4].upper())
                null = not re.search(r"NOT\s+NULL|PRIMARY\s+KEY", c[4], re.I)
                if re.search(r"PRIMARY\s+KEY", c[4], re.I):
                    primary = (c[1],)
                columns.append(T.StructField(c[1], kind, null))
            schema = T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name not in primary) for f in columns])
            self.add(Table(m[2], self.spark.createDataFrame([], schema), primary, local=True, schema=schema))
            return self._ok()
        if m := re.match(r"\s*INSERT\s+INTO\s+`?(\w+)`?\s*(\(([^)]*)\))?\s*((VALUES|SELECT|WITH).*)$", sql, re.I | re.S):
            table = self.tables.get(m[1])
            if table is None or not table.local:
                raise ValueError(f"1146: {m[1]} is no local table")
            names = [c.strip(" `") for c in m[3].split(",")] if m[3] else table.frame.columns
            rows = self.spark.sql(m[4]).toDF(*names)
            schema = table.schema
            rows = rows.select(*[(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
            # written before it is checked, so that random values are those that are kept
            part = f"{self.folder}/{table.name}/{len(table.parts)}"
            rows.write.mode("overwrite").parquet(part)
            rows = self.spark.read.schema(schema).parquet(part)
            for f in schema:
                if not f.nullable and not rows.filter(F.col(f"`{f.name}`").isNull()).isEmpty():
                    raise ValueError(f"1048: column {f.name} cannot be null")
            if table.primary:
                # keys twice in the new rows, or there already: the old rows aren't grouped
                own = rows.select(*table.primary)
                if not own.groupBy(*table.primary).count().filter("count > 1").isEmpty() or not own.join(table.frame.select(*table.primary), list(table.primary), "left_semi").isEmpty():
                    raise ValueError("1062: duplicate entry for key PRIMARY")
            parts = [*table.parts, part]
            self.add(Table(table.name, self.spark.read.schema(schema).parquet(*parts), table.primary, local=True, parts=parts, schema=schema))
            return self._ok()
        raise ValueError("1064: statement not supported")

    @staticmethod
    def _type(name: str, size: str | None, unsigned: bool) -> T.DataType:
        if name in ("DECIMAL", "NUMERIC"):
            p, s = ([int(x) for x in re.findall(r"\d+", size or "")] + [10, 0])[:2] if size and "," in size else (int(re.findall(r"\d+", size)[0]) if size else 10, 0)
            return T.DecimalType(min(p, 38), s)
        if name == "BIGINT" and unsigned:
            return T.DecimalType(20, 0)
        kinds = {"BIGINT": T.LongType(), "INT": T.LongType() if unsigned else T.IntegerType(), "INTEGER": T.IntegerType(), "SMALLINT": T.IntegerType(), "TINYINT": T.IntegerType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampType(), "BOOLEAN": T.BooleanType(), "BLOB": T.BinaryType(), "VARBINARY": T.BinaryType(), "YEAR": T.ShortType()}
        return kinds.get(name, T.StringType())

    def _ok(self) -> DataFrame:
        return self.spark.sql("SELECT 'OK' AS status")

    # --- metadata

    def relations(self) -> dict[str, DataFrame]:
        """The information_schema relations."""
        make = lambda rows, schema: self.spark.createDataFrame(rows, schema)
        tables = list(self.tables.values())
        columns = [("def", "main", t.name, f.name, i + 1, "YES" if f.nullable else "NO", mysql_type(f.dataType).split("(")[0], mysql_type(f.dataType), "PRI" if f.name in t.primary else "") for t in tables for i, f in enumerate(t.schema or t.frame.schema)]
        keys = [("main", t.name, "PRIMARY", c, i + 1) for t in tables for i, c in enumerate(t.primary)] + [("main", t.name, f"unique_{k}", c, i + 1) for t in tables for k, u in enumerate(t.unique) for i, c in enumerate(u)]
        constraints = sorted({(a, b, c, "PRIMARY KEY" if c == "PRIMARY" else "UNIQUE") for a, b, c, _, _ in keys})
        return {
            "schemata": make([("def", "main", "utf8mb4", "utf8mb4_0900_ai_ci"), ("def", "information_schema", "utf8mb4", "utf8mb4_0900_ai_ci")], "CATALOG_NAME string, SCHEMA_NAME string, DEFAULT_CHARACTER_SET_NAME string, DEFAULT_COLLATION_NAME string"),
            "tables": make([("def", "main", t.name, "BASE TABLE") for t in tables], "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, TABLE_TYPE string"),
            "columns": make(columns, "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION long, IS_NULLABLE string, DATA_TYPE string, COLUMN_TYPE string, COLUMN_KEY string"),
            "statistics": make([(a, b, 0, c, e, d) for a, b, c, d, e in keys], "TABLE_SCHEMA string, TABLE_NAME string, NON_UNIQUE int, INDEX_NAME string, SEQ_IN_INDEX int, COLUMN_NAME string"),
            "key_column_usage": make([(a, b, c, d, e) for a, b, c, d, e in keys], "TABLE_SCHEMA string, TABLE_NAME string, CONSTRAINT_NAME string, COLUMN_NAME string, ORDINAL_POSITION int"),
            "table_constraints": make(constraints, "TABLE_SCHEMA string, TABLE_NAME string, CONSTRAINT_NAME string, CONSTRAINT_TYPE string"),
            "referential_constraints": make([], "CONSTRAINT_SCHEMA string, CONSTRAINT_NAME string, REFERENCED_TABLE_NAME string"),
            "check_constraints": make([], "CONSTRAINT_SCHEMA string, CONSTRAINT_NAME string, CHECK_CLAUSE string"),
            "routines": make([], "ROUTINE_SCHEMA string, ROUTINE_NAME string, ROUTINE_TYPE string"),
            "views": make([], "TABLE_SCHEMA string, TABLE_NAME string, VIEW_DEFINITION string"),
        }

    def publish(self) -> None:
        for name, frame in self.relations().items():
            frame.createOrReplaceTempView(f"information_schema_{name}")

    def show(self, sql: str) -> DataFrame:
        words = re.sub(r"\s+", " ", sql.strip("; \n")).split(" ")
        up = [w.upper() for w in words]
        rel = self.relations()
        like = re.search(r"LIKE\s+'([^']*)'", sql, re.I)

        def named(df: DataFrame, column: str) -> DataFrame:
            return df.filter(F.col(column).like(like[1])) if like else df

        if up[0] in ("DESC", "DESCRIBE") or "COLUMNS" in up or "FIELDS" in up:
            name = words[1] if up[0] in ("DESC", "DESCRIBE") else words[up.index("FROM") + 1]
            c = rel["columns"].filter(F.col("TABLE_NAME") == name.strip("`")).orderBy("ORDINAL_POSITION")
            return named(c.select(F.col("COLUMN_NAME").alias("Field"), F.col("COLUMN_TYPE").alias("Type"), F.col("IS_NULLABLE").alias("Null"), F.col("COLUMN_KEY").alias("Key")), "Field")
        if "DATABASES" in up or "SCHEMAS" in up:
            return named(rel["schemata"].select(F.col("SCHEMA_NAME").alias("Database")), "Database")
        if "TABLES" in up:
            full = [F.col("TABLE_TYPE").alias("Table_type")] if "FULL" in up else []
            return named(rel["tables"].select(F.col("TABLE_NAME").alias("Tables_in_main"), *full).orderBy("Tables_in_main"), "Tables_in_main")
        if up[1] in ("INDEX", "INDEXES", "KEYS"):
            return rel["statistics"].filter(F.col("TABLE_NAME") == words[3].strip("`")).select(F.col("TABLE_NAME").alias("Table"), F.col("NON_UNIQUE").alias("Non_unique"), F.col("INDEX_NAME").alias("Key_name"), F.col("SEQ_IN_INDEX").alias("Seq_in_index"), F.col("COLUMN_NAME").alias("Column_name"))
        if up[1:3] == ["CREATE", "TABLE"]:
            t = self.tables[words[3].strip("`")]
            lines = [f"  `{f.name}` {mysql_type(f.dataType)}{'' if f.nullable else ' NOT NULL'}" for f in (t.schema or t.frame.schema)] + ([f"  PRIMARY KEY ({', '.join(f'`{c}`' for c in t.primary)})"] if t.primary else [])
            return self.spark.createDataFrame([(t.name, f"CREATE TABLE `{t.name}` (\n" + ",\n".join(lines) + "\n)")], "Table string, `Create Table` string")
        if "VARIABLES" in up:
            from quern.plans.dialect import SYSTEM_VARIABLES

            return named(self.spark.createDataFrame([(k, v.strip("'")) for k, v in sorted(SYSTEM_VARIABLES.items())], "Variable_name string, Value string"), "Variable_name")
        if up[1] == "WARNINGS":
            return self.spark.createDataFrame([], "Level string, Code int, Message string")
        if up[1] == "GRANTS":
            return self.spark.createDataFrame([("GRANT SELECT ON *.* TO CURRENT_USER",)], "Grants string")
        raise ValueError(f"1064: {sql}")
