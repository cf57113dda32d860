"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_dir, shared_dir  # noqa: F401

#: ASCII bytes that end a word, by the contract's pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over lower-cased text.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 bytes: runs of 0-9, a-z and every non-ASCII character."""
    return data.translate(WORD_TABLE).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing is read from them any more."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t._written_at
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a narrow table up to which it is sent to every executor rather than the texts to it.
FEW_ROWS = 200_000


def small(table: DataFrame) -> DataFrame:
    """A written, narrow table, with a hint to broadcast it if it has few rows; a larger one is joined by shuffling."""
    return F.broadcast(table) if table.limit(FEW_ROWS + 1).count() <= FEW_ROWS else table


def unused(name: str, taken: list[str]) -> str:
    """A column name that none of the ``taken`` ones equals in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def crc_fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(folds)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as --py-files would."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    # texts are long: fewer rows a batch bound the memory on both sides of the pipe
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    _shipped.add(sc.applicationId)


def map_arrow(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` with this package at hand on every executor."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(
    batches: Iterable[pa.RecordBatch], column: int, max_bytes: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a string or binary column holds about ``max_bytes`` per slice."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
