"""A database from CSV files whose rows carry relative dates instead of timestamps.

The layout is declared, not coded: each :class:`CsvTable` names its file, schema, keys and how its
dates follow from the entity's date. :data:`CREDIT` is the seven-table credit layout.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date
from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedview.model import DatabaseSpec, TableSpec, TaskSpec, metric_for
from seedview.operators.dates import DAYS_PER_MONTH, SPREAD_END, SPREAD_START, relative_dates, spread_dates
from seedview.operators.keys import scan_row_ids
from seedview.operators.lookup import lookup
from seedview.operators.splits import fractional_split
from seedview.session import pin


@dataclass(frozen=True)
class CsvTable:
    """``offset`` is (offset column, new date column, days per unit); ``row_id`` names a new key.

    ``schema`` declares the columns in file order. ``infer`` asks for types from one more pass over the
    file instead, with ``schema`` for the columns whose type must not depend on the data.
    """

    file: str
    schema: Optional[str] = None
    infer: bool = False
    primary_key: Optional[str] = None
    row_id: Optional[str] = None
    offset: Optional[tuple[str, str, int]] = None
    foreign_keys: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class CsvProblem:
    """The entity table comes first in ``tables``; its dates are spread over ``start .. end``."""

    name: str
    tables: Mapping[str, CsvTable]
    entity_key: str
    target_col: str
    date_col: str
    start: date = SPREAD_START
    end: date = SPREAD_END
    task_type: str = "classification"

    @property
    def entity_table(self) -> str:
        return next(iter(self.tables))


def missing_files(spark: SparkSession, root: str, files: list[str]) -> list[str]:
    """Files that do not exist, asked of the file system the path belongs to."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f for f in files if not fs.exists(path(root, f))]


CORRUPT = "_corrupt_record"
"""Column of the text of a line that does not fit its table's schema."""


def load_csv_problem(
    spark: SparkSession, root: str, problem: CsvProblem, bad_rows: Optional[dict[str, DataFrame]] = None
) -> tuple[DatabaseSpec, TaskSpec]:
    """Read, date and link all tables; labelled entities only; split 70/15/15 by date.

    A line that does not fit the declared schema (a word where a number belongs, too many or too few
    values) makes the load fail when its table is read. With ``bad_rows``, a dict to be filled with one frame of
    such lines per table (row number, text), the tables go on without them. Row ids count all lines.
    """
    absent = missing_files(spark, root, [t.file for t in problem.tables.values()])
    if absent:
        raise FileNotFoundError(f"missing in {root}: {', '.join(absent)}")
    key, entity_name = problem.entity_key, problem.entity_table

    def read(name: str) -> DataFrame:
        layout = problem.tables[name]
        good, bad = read_csv(spark, f"{root}/{layout.file}", layout, bad_rows is not None)
        if bad is not None:
            bad_rows[name] = bad
        return good

    raw = read(entity_name).where(F.col(problem.target_col).isNotNull())
    dates = pin(spread_dates(raw, key, problem.date_col, problem.start, problem.end), "dates")
    entity = lookup(raw, dates, [key])
    labels = entity.select(key, problem.date_col, F.col(problem.target_col).cast("int").alias(problem.target_col))
    tables = {
        entity_name: TableSpec(entity_name, entity.drop(problem.target_col), key, problem.date_col, {}, True)
    }
    for name, layout in list(problem.tables.items())[1:]:
        df, time_col = read(name), None
        if layout.offset:
            offset_col, time_col, days = layout.offset
            df = relative_dates(df, key, offset_col, time_col, dates, days)
        tables[name] = TableSpec(name, df, layout.row_id or layout.primary_key, time_col, dict(layout.foreign_keys))
    task = TaskSpec(
        problem.name,
        problem.task_type,
        problem.target_col,
        metric_for(problem.task_type),
        entity_name,
        key,
        problem.date_col,
        fractional_split(labels, problem.date_col),
    )
    return DatabaseSpec(tables), task


def read_csv(spark: SparkSession, path: str, layout: CsvTable, keep_bad: bool = False) -> tuple[DataFrame, Optional[DataFrame]]:
    """The table of one file (or folder of files) with a header, and the lines that do not fit it.

    The header's names must be those of the schema. Without ``keep_bad`` a bad line is an error. With it,
    lines are written once with their numbers in file order, and both results are read from there.
    """
    if not layout.schema and not layout.infer:
        raise ValueError(f"{layout.file}: declare a schema or ask for inference")
    schema = _inferred(spark, path, layout.schema) if layout.infer else T.StructType.fromDDL(layout.schema)
    names = [f.name for f in schema.fields]
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if not keep_bad:
        table = reader.option("mode", "FAILFAST").schema(schema).csv(path)
        return (scan_row_ids(table, layout.row_id) if layout.row_id else table), None
    marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    scan = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(marked).csv(path)
    numbered = pin(scan_row_ids(scan, layout.row_id or "__line"), "csv")
    good = numbered.where(F.col(CORRUPT).isNull()).select(*names, *([layout.row_id] if layout.row_id else []))
    bad = numbered.where(F.col(CORRUPT).isNotNull()).select(F.col(layout.row_id or "__line").alias("line"), F.col(CORRUPT).alias("text"))
    return good, bad


def _inferred(spark: SparkSession, path: str, declared: Optional[str]) -> T.StructType:
    """Types from a pass over the file, whole numbers as bigint; declared columns as declared."""
    own = {f.name: f.dataType for f in T.StructType.fromDDL(declared).fields} if declared else {}
    found = spark.read.option("header", True).option("inferSchema", True).csv(path).schema.fields
    wide = lambda f: T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType
    return T.StructType([T.StructField(f.name, own.get(f.name, wide(f))) for f in found])


# Files, keys and date rules of the public credit-default data set. Keys, offsets and label are
# declared; the types of the many features are inferred.
_CURR = {"SK_ID_CURR": "application"}
_CURR_PREV = {"SK_ID_CURR": "application", "SK_ID_PREV": "previous_application"}
CREDIT = CsvProblem(
    name="credit_default",
    entity_key="SK_ID_CURR",
    target_col="TARGET",
    date_col="APPLICATION_DATE",
    tables={
        "application": CsvTable(
            "application_train.csv", "SK_ID_CURR bigint, TARGET int", infer=True, primary_key="SK_ID_CURR"
        ),
        "bureau": CsvTable(
            "bureau.csv",
            "SK_ID_CURR bigint, SK_ID_BUREAU bigint, DAYS_CREDIT bigint",
            infer=True,
            primary_key="SK_ID_BUREAU",
            offset=("DAYS_CREDIT", "BUREAU_DATE", 1),
            foreign_keys=_CURR,
        ),
        "bureau_balance": CsvTable(
            "bureau_balance.csv",
            "SK_ID_BUREAU bigint, MONTHS_BALANCE bigint, STATUS string",
            row_id="_bb_row_id",
            foreign_keys={"SK_ID_BUREAU": "bureau"},
        ),
        "previous_application": CsvTable(
            "previous_application.csv",
            "SK_ID_PREV bigint, SK_ID_CURR bigint, DAYS_DECISION bigint",
            infer=True,
            primary_key="SK_ID_PREV",
            offset=("DAYS_DECISION", "PREV_APP_DATE", 1),
            foreign_keys=_CURR,
        ),
        "pos_cash_balance": CsvTable(
            "POS_CASH_balance.csv",
            "SK_ID_PREV bigint, SK_ID_CURR bigint, MONTHS_BALANCE bigint",
            infer=True,
            row_id="_pos_row_id",
            offset=("MONTHS_BALANCE", "POS_CASH_DATE", DAYS_PER_MONTH),
            foreign_keys=_CURR_PREV,
        ),
        "credit_card_balance": CsvTable(
            "credit_card_balance.csv",
            "SK_ID_PREV bigint, SK_ID_CURR bigint, MONTHS_BALANCE bigint",
            infer=True,
            row_id="_cc_row_id",
            offset=("MONTHS_BALANCE", "CC_DATE", DAYS_PER_MONTH),
            foreign_keys=_CURR_PREV,
        ),
        "installments_payments": CsvTable(
            "installments_payments.csv",
            "SK_ID_PREV bigint, SK_ID_CURR bigint, DAYS_INSTALMENT double",
            infer=True,
            row_id="_inst_row_id",
            offset=("DAYS_INSTALMENT", "INSTALL_DATE", 1),
            foreign_keys=_CURR_PREV,
        ),
    },
)
