"""Session set-up and the shared scratch area of iterative operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Open scopes, the innermost last; each lists the workspaces made in it.
_SCOPES: list[list["Workspace"]] = []


def build_session(app: str = "lodestrata", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the test-suite and the bench use."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is read from ``spark.checkpoint.dir``, else from the context's
    checkpoint directory.  Only a local master without either gets a new
    temporary folder; on a cluster the missing setting is an error, as a
    machine-local folder would not be seen by the other machines.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context_dir = spark.sparkContext._jsc.getCheckpointDir()
    if context_dir.isPresent():
        return context_dir.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="lodestrata-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.getCheckpointDir().get()


class Workspace:
    """Named Parquet tables in the shared folder: cut lineage, keep statistics.

    A table written here survives the loss of an executor, and its size is
    known to the planner, so that joins with a small step of an iteration are
    broadcast by Spark's own size check and larger ones are not.  Tables go when
    they are freed, when the scope they were made in ends (:func:`scratch`,
    :func:`settled`), and with the session at the latest.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._serial = 0
        if _SCOPES:
            _SCOPES[-1].append(self)
        where, files = self._files(self.root)
        files.deleteOnExit(where)

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, tag: str) -> str:
        """A new path of this workspace."""
        self._serial += 1
        return f"{self.root}/{self._serial:03d}-{tag}"

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` and return the table read back."""
        path = self.path(tag)
        df.write.option("compression", "zstd").parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._scratch_path = path
        return saved

    def free(self, *tables: DataFrame) -> None:
        """Delete tables of earlier rounds that no later plan reads."""
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path:
                where, files = self._files(path)
                files.delete(where, True)

    def clear(self) -> None:
        """Delete all tables of this workspace."""
        where, files = self._files(self.root)
        files.delete(where, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Delete what the operators called inside have written, when it is left.

    Results that are read afterwards have to be collected or written inside.
    """
    opened: list[Workspace] = []
    _SCOPES.append(opened)
    try:
        yield
    finally:
        _SCOPES.remove(opened)
        for ws in opened:
            ws.clear()


def settled(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query whose result is written, and whose other tables are gone when it returns.

    Queries that write nothing on their way stay lazy.
    """

    @functools.wraps(query)
    def run(*args, **options) -> DataFrame:
        opened: list[Workspace] = []
        _SCOPES.append(opened)
        try:
            out = query(*args, **options)
        except BaseException:
            _SCOPES.remove(opened)
            for ws in opened:
                ws.clear()
            raise
        _SCOPES.remove(opened)
        if opened:
            out = Workspace(out.sparkSession, query.__name__).save(out, "result")
            for ws in opened:
                ws.clear()
        return out

    return run


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
