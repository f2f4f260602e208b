"""Loading the seven star-schema tables (S1, S2) and the source check (Q17).

Tables come either from a directory of parquet files (``<dir>/<name>.parquet``)
or from a catalog namespace (``spark.table("<ns>.<name>")``). Nothing is
pruned here: Catalyst pushes the columns a query really uses down to the
scan (``ReadSchema`` in ``explain``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.functions.money import DEFAULT_SCALE, Amount, amount

# The tables and the columns the summaries read from each.
REQUIRED_COLUMNS: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey"),
    "part": ("p_partkey", "p_name", "p_type", "p_brand"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
               "o_orderdate", "o_totalprice"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                 "l_extendedprice", "l_discount", "l_shipdate"),
}

TABLE_NAMES: tuple[str, ...] = tuple(REQUIRED_COLUMNS)

# The most rows, and bytes of the columns taken, that a dimension
# may have to be broadcast on our own check (nation and region have 25 and 5
# rows), and what a cell counts for besides its text.
SMALL_DIMENSION_ROWS = 10_000
SMALL_DIMENSION_BYTES = 8 * 1024 * 1024
CELL_BYTES = 16


class MissingColumnsError(ValueError):
    """A table lacks columns the summaries need."""


class Tables:
    """The seven input tables as lazy DataFrames, each opened on first use.

    A query that reads only ``orders`` opens only ``orders``: opening a
    parquet table lists its files and reads a footer, which is cheap but
    not free, and there is no reason to pay it for tables a query never
    touches. Column checks run when a table is first opened.
    """

    def __init__(self, spark: SparkSession, open_table: Callable[[str], DataFrame],
                 check: bool = True, source: str | None = None, money_scale: int = DEFAULT_SCALE):
        self._spark = spark
        self._open = open_table
        self._check = check
        #: Where the rows come from; snapshots are kept apart by it.
        self.source = source
        #: Decimal places of amounts that arrive as doubles.
        self.money_scale = money_scale
        self._frames: dict[str, DataFrame] = {}
        self._known: dict[object, bool] = {}

    @classmethod
    def of(cls, spark: SparkSession, check: bool = True, source: str | None = None,
           money_scale: int = DEFAULT_SCALE, **frames: DataFrame) -> "Tables":
        """Tables from DataFrames in hand (tests, fixtures, upstream jobs).
        A table not given raises ``KeyError`` when a query asks for it. Only
        tables with a ``source`` id can be kept in a snapshot store."""
        return cls(spark, lambda name: frames[name], check, source, money_scale)

    def table(self, name: str) -> DataFrame:
        if name not in REQUIRED_COLUMNS:
            raise KeyError(name)
        if name not in self._frames:
            df = self._open(name)
            self._frames[name] = _check_columns(name, df) if self._check else df
        return self._frames[name]

    def amount(self, name: str, column: str) -> Amount:
        """A money or quantity column of a table in exact units."""
        return amount(self.table(name), column, self.money_scale)

    @property
    def spark(self) -> SparkSession:
        return self._spark

    def once(self, question: object, ask: Callable[[], bool]) -> bool:
        """The answer to a question about the tables that takes a job: asked
        when a plan first needs it, then kept for the bundle."""
        if question not in self._known:
            self._known[question] = ask()
        return self._known[question]

    def is_small(self, name: str, *columns: str, max_rows: int = SMALL_DIMENSION_ROWS,
                 max_bytes: int = SMALL_DIMENSION_BYTES) -> bool:
        """Whether ``columns`` (default: all) of the table have at most
        ``max_rows`` rows and ``max_bytes`` bytes, proven by one bounded pass over
        ``max_rows`` + 1 rows. Eager: one small job, once per bundle and columns,
        when a plan that joins the table is first built."""
        def ask() -> bool:
            df = self.table(name)
            df = df.select(*columns) if columns else df
            size = sum((F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)).cast("long") + CELL_BYTES
                        for f in df.schema.fields), F.lit(0).cast("long"))
            seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).first()
            return seen["rows"] <= max_rows and (seen["bytes"] or 0) <= max_bytes
        return self.once((name, columns, max_rows, max_bytes), ask)

    def dimension(self, name: str, *columns: str) -> DataFrame:
        """``columns`` of a lookup table, marked for broadcast when
        :meth:`is_small` proves their size; otherwise left to Spark's own
        size-based choice (sort-merge beyond the threshold)."""
        df = self.table(name).select(*columns)
        return F.broadcast(df) if self.is_small(name, *columns) else df

    @property
    def region(self) -> DataFrame:
        return self.table("region")

    @property
    def nation(self) -> DataFrame:
        return self.table("nation")

    @property
    def customer(self) -> DataFrame:
        return self.table("customer")

    @property
    def supplier(self) -> DataFrame:
        return self.table("supplier")

    @property
    def part(self) -> DataFrame:
        return self.table("part")

    @property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    def items(self):
        return ((name, self.table(name)) for name in TABLE_NAMES)


def _check_columns(name: str, df: DataFrame) -> DataFrame:
    present = set(df.columns)
    missing = [c for c in REQUIRED_COLUMNS[name] if c not in present]
    if missing:
        raise MissingColumnsError(f"table {name!r} lacks column(s) {missing}")
    return df


def load_tables(spark: SparkSession, source: str, *, catalog: bool = False,
                check: bool = True, register: bool = False,
                money_scale: int = DEFAULT_SCALE) -> Tables:
    """The seven tables, opened lazily.

    ``source`` is a directory holding ``<name>.parquet`` for each table, or,
    with ``catalog=True``, a namespace such as ``"sales.tpch"`` read through
    ``spark.table``. ``check`` verifies the needed columns from the schema
    alone (parquet footers; no data is read). ``money_scale`` is the number of
    decimal places of amounts stored as doubles. ``register`` also creates temp
    views under the bare table names, for ad-hoc SQL (this opens all seven).
    """
    if catalog:
        def open_table(name: str) -> DataFrame:
            return spark.table(f"{source}.{name}")
    else:
        root = source.rstrip("/")

        def open_table(name: str) -> DataFrame:
            return spark.read.parquet(f"{root}/{name}.parquet")
    where = f"catalog:{source}" if catalog else f"path:{source.rstrip('/')}"
    tables = Tables(spark, open_table, check, where, money_scale)
    if register:
        register_views(tables)
    return tables


def register_views(tables: Tables) -> None:
    """Register each table as a temp view under its bare name.

    Three-part names such as ``cat.db.orders`` need a catalog; bare view
    names work in any session and in the DuckDB oracle alike. A temp view of
    one of these names that is there already is not replaced: it is an error,
    and none of the tables is registered.
    """
    done: list[str] = []
    try:
        for name, df in tables.items():
            df.createTempView(name)
            done.append(name)
    except AnalysisException as error:
        for name in done:
            tables.spark.catalog.dropTempView(name)
        raise ValueError(f"the session already has a temp view {TABLE_NAMES[len(done)]!r}") from error


@contextmanager
def table_views(tables: Tables) -> Iterator[None]:
    """The tables as temp views for a while."""
    register_views(tables)
    try:
        yield
    finally:
        for name in TABLE_NAMES:
            tables.spark.catalog.dropTempView(name)


def source_check(tables: Tables) -> DataFrame:
    """Q17: one row per table — ``table_name``, ``row_count``.

    Replaces a bare connectivity ping: it proves every table is present and
    readable. Each count is a distributed aggregate that reads no columns;
    the seven one-row results are unioned.
    """
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
