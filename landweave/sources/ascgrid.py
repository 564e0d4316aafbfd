"""ASCII grids: six header lines, then one line of values for each row of the raster.

Reading is distributed over the lines of the body. A value equal to the no-data code is missing.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The header's keys in the order in which they are written.
KEYS = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")


@dataclass(frozen=True)
class RasterMeta:
    ncols: int
    nrows: int
    xllcorner: float = 0.0
    yllcorner: float = 0.0
    cellsize: float | None = None
    nodata_value: int = -9999

    def same_place(self, other: RasterMeta) -> bool:
        """Equal but for the no-data code."""
        return {**asdict(self), "nodata_value": 0} == {**asdict(other), "nodata_value": 0}


def parse_header(lines: list[str]) -> RasterMeta:
    if len(lines) < len(KEYS):
        raise ValueError("the header has six lines")
    found = {}
    for line, kind in zip(lines, (int, int, float, float, float, int), strict=False):
        parts = line.split()
        if len(parts) != 2:
            raise ValueError(f"bad header line {line!r}")
        found[parts[0].lower()] = kind(parts[1])
    if set(found) != set(KEYS):
        raise ValueError(f"the header must have the keys {', '.join(KEYS)}")
    return RasterMeta(**found)


def read_ascgrid(spark: SparkSession, path: str, check: bool = True) -> tuple[DataFrame, RasterMeta]:
    """(raster, header). ``check`` compares the body's shape with the header (one pass)."""
    # A split of the file begins at its block's start, and its lines follow in order: together they give a line's place.
    # Blocks are numbered through over the small table of their sizes, lines only within their block.
    at = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select("value", at.alias("block"), F.monotonically_increasing_id().alias("place"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    starts = lines.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("block").orderBy("place")) - 1
    numbered = lines.withColumn("within", within).join(starts, "block").select((F.col("start") + F.col("within")).alias("line"), "value")
    meta = parse_header([r.value for r in numbered.where(F.col("line") < len(KEYS)).orderBy("line").collect()])
    body = numbered.where((F.col("line") >= len(KEYS)) & (F.trim("value") != "")).select(
        (F.col("line") - len(KEYS) + 1).cast("int").alias("row"), F.split(F.trim("value"), r"\s+").alias("cells")
    )
    if check:
        n, short, long_, last = body.agg(F.count(F.lit(1)), F.min(F.size("cells")), F.max(F.size("cells")), F.max("row")).first()
        if n != meta.nrows or last != meta.nrows:
            raise ValueError(f"the header tells {meta.nrows} rows, the body has {n}")
        if (short, long_) != (meta.ncols, meta.ncols):
            raise ValueError(f"the header tells {meta.ncols} columns, the body has {short} to {long_}")
    raster = body.select("row", F.posexplode("cells").alias("k", "v")).select("row", (F.col("k") + 1).alias("col"), F.col("v").cast("double").alias("value"))
    return raster.where((F.col("value") != meta.nodata_value) & ~F.isnan("value")), meta


def ascgrid_lines(raster: DataFrame, meta: RasterMeta) -> DataFrame:
    """line (from 1), value: the file's lines. Missing cells get the no-data code."""
    if meta.cellsize is None:
        raise ValueError("cellsize is needed")
    spark = raster.sparkSession
    code = str(meta.nodata_value)
    rows = spark.range(1, meta.nrows + 1).select(F.col("id").cast("int").alias("row"))
    filled = (
        raster.where("value is not null and not isnan(value)").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.col("value").cast("string")))).alias("m"))
    )
    body = rows.join(filled, "row", "left").select(
        (F.col("row") + len(KEYS)).alias("line"),
        F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(meta.ncols)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(code)))).alias("value"),
    )
    values = asdict(meta)
    head = spark.createDataFrame([(k + 1, f"{name.upper() if name == 'nodata_value' else name} {values[name]}") for k, name in enumerate(KEYS)], "line int, value string")
    return head.unionByName(body)


def write_ascgrid(raster: DataFrame, path: str, meta: RasterMeta) -> None:
    """Write a folder with one text file, the format being one ordered file."""
    ascgrid_lines(raster, meta).repartitionByRange(1, "line").sortWithinPartitions("line").select("value").write.mode("overwrite").text(path)


class AscGridSource(DataSource):
    """``spark.read.format("ascgrid").load(path)``: rows (row, col, value) of a local or mounted file."""

    @classmethod
    def name(cls) -> str:
        return "ascgrid"

    def schema(self) -> str:
        return "row int, col int, value double"

    def reader(self, schema) -> DataSourceReader:
        return AscGridReader(self.options["path"], int(self.options.get("partitions", 4)))


class AscGridReader(DataSourceReader):
    def __init__(self, path: str, parts: int):
        self.path, self.parts = path.removeprefix("file://").removeprefix("file:"), parts

    def partitions(self):
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition):
        with open(self.path) as f:
            meta = parse_header([f.readline() for _ in KEYS])
            for row, line in enumerate(f, 1):
                if row % self.parts == partition.value:
                    for col, v in enumerate(map(float, line.split()), 1):
                        if v != meta.nodata_value and v == v:
                            yield row, col, v


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AscGridSource)
