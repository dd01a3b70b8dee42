"""Reading and writing tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, StringType, StructField, StructType

from lanewright.functions.risk import delay_status
from lanewright.operators.ordered import running_totals

# Target column: (source names in order of preference, default, type).  Fixed values.
WAREHOUSE_SEED = {
    "warehouse_id": (("Warehouse_ID", "Ware_house_ID"), None, "string"),
    "location_type": (("Location_type",), "Urban", "string"),
    "capacity_size": (("WH_capacity_size", "Capacity"), "Medium", "string"),
    "zone": (("zone",), "North", "string"),
    "workers_num": (("workers_num",), 45.0, "double"),
    "dist_from_hub": (("dist_from_hub",), 12.5, "double"),
    "transport_issue_l1y": (("transport_issue_l1y", "Delivery_Time_Days"), 0, "int"),
    "wh_breakdown_l3m": (("wh_breakdown_l3m",), 0, "int"),
    "product_wg_ton": (("product_wg_ton", "Demand"), 100.0, "double"),
}
REFERENCE_TABLES = (
    "suppliers", "supplier_capacity", "transportation_cost", "shipping_options", "inventory", "warehouse",
    "production_schedule", "customer_orders", "active_shipments",
)  # fixed values


def scan_csv(spark: SparkSession, path: str, schema: StructType | str, **options: str) -> DataFrame:
    """A CSV with header: the declared columns, found by their names in the header line.

    The types are declared, because inference would read the data twice.  Other columns are left out, a column that the
    file lacks is an error before any job runs, and so is a cell that is not of its type when it is read.  NaN becomes null.
    """
    declared = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    types = {f.name: f.dataType for f in declared.fields}
    header = csv_header(spark, path)
    missing = [name for name in types if name not in header]
    if missing:
        raise ValueError(f"{path} has no column {missing}")
    ordered = StructType([StructField(name, types.get(name, StringType()), True) for name in header])
    rows = spark.read.schema(ordered).options(header=True, enforceSchema=False, mode="FAILFAST", **options).csv(path)
    return nan_to_null(rows.select(*[f"`{name}`" for name in types]))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating columns with null in place of NaN; all other columns as they are."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floating}) if floating else df


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV's header line."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def scan_csv_dates(spark: SparkSession, path: str, schema: StructType, date_columns: list[str], fmt: str = "yyyy-MM-dd") -> DataFrame:
    """As ``scan_csv``, with the date columns that the file has read as dates; a date column it lacks is left out."""
    header = csv_header(spark, path)
    fields = [f for f in schema.fields if f.name in header or f.name not in date_columns]
    typed = StructType([StructField(f.name, DateType() if f.name in date_columns else f.dataType, True) for f in fields])
    return scan_csv(spark, path, typed, dateFormat=fmt)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def load_tables(spark: SparkSession, folder: str, names=REFERENCE_TABLES) -> dict[str, DataFrame]:
    """All named Parquet tables, or one error naming every missing one before any job runs."""
    paths = {n: f"{folder}/{n}.parquet" for n in names}
    missing = sorted(n for n, p in paths.items() if not _exists(spark, p))
    if missing:
        raise FileNotFoundError(f"missing tables: {missing}")
    return {n: spark.read.parquet(p) for n, p in paths.items()}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, each from the file footers."""
    counts = [df.agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows")) for n, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One file per task; nothing is gathered."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def as_json(df: DataFrame, name: str = "report") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def seed_if_empty(df: DataFrame, path: str) -> bool:
    """Write only when the target has no rows yet; tells whether it did."""
    spark = df.sparkSession
    if _exists(spark, path) and not spark.read.schema(df.schema).parquet(path).isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def map_columns(df: DataFrame, spec: dict) -> DataFrame:
    """Pick for every target the first source column that exists, else the default.

    The choice depends on the columns present, not on nulls.  Values that do not
    cast become null.  Warehouses without any id column are numbered from ``WH_100000`` on, equal rows too, so that an id is
    never given twice; the running number is not made in one task.
    """
    picked = []
    columns = df.columns
    if "warehouse_id" in spec and not any(s in columns for s in spec["warehouse_id"][0]):
        marked = df.select("*", F.to_json(F.struct(*columns)).alias("_body"), F.monotonically_increasing_id().alias("_place"), F.lit(1).alias("_one"))
        df = running_totals(marked, ["_body", "_place"], ["_one"])
    for target, (sources, default, kind) in spec.items():
        source = next((s for s in sources if s in columns), None)
        if source is not None:
            value = F.col(source).try_cast(kind)
        elif target == "warehouse_id":
            value = F.concat(F.lit("WH_"), (F.col("_one_before") + 100_000).cast("string"))
        else:
            value = F.lit(default).cast(kind)
        picked.append(value.alias(target))
    return df.select(*picked).withColumn("status", delay_status(F.col("transport_issue_l1y")))
