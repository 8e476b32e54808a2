"""What the operators of this package share: shared folders, Arrow row streams, words."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are turned into Python objects at once.
SLICE_ROWS = 512
#: Bytes of text that are turned into Python objects at once, unless one row has more.
SLICE_BYTES = 4_000_000

ASCII_SPACE = r"[\x20\x09-\x0D]"

#: Bytes of a word (letters lower-cased, digits, all non-ASCII bytes); others become a space.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32
    for c in range(256)
)
#: Only lower-cases A-Z.
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split()


def space_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; bytes.split() has just these separators."""
    return data.split()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none, a new one, but for local masters only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def quoted(name: str) -> str:
    """The name as an expression, whatever marks it holds."""
    return "`" + name.replace("`", "``") + "`"


def ddl_of(df: DataFrame) -> str:
    """The frame's columns as DDL."""
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of the frame is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


#: Tables of up to so many rows and characters are broadcast by join_back.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 4_000_000
#: Keys with more than this share of the rows are heavy; there are no more of them than its reciprocal.
HEAVY_SHARE = 1 / 1000


def join_back(rows: DataFrame, small: tuple[DataFrame, dict], key: str, weight: str, value: str) -> DataFrame:
    """Adds to each row its key's ``value`` (null where there is none); keys may hold any share of the rows, null is a key too.

    small: a written table with one row a key and its size, as ``Stages.keyed`` gives them: key, weight (the rows of that
    key) and value. It is broadcast if its size allows it. If not, heavy keys, which are few by definition, are broadcast, and their rows are spread in the shuffle
    that joins the others.
    """
    k, h, hv, s, sv, spread = unused(rows.select(*map(quoted, rows.columns), F.lit(0).alias(value)), "_key", "_heavy", "_heavy_value", "_small", "_small_value", "_spread")
    known, size = small[0].select(F.col(key).alias(s), F.col(weight).alias(k), F.col(value).alias(sv)), small[1]
    own = [F.col(quoted(c)) for c in rows.columns]
    mine = F.col(quoted(key))
    if size["n"] <= BROADCAST_ROWS and size["chars"] <= BROADCAST_CHARS:
        return rows.join(F.broadcast(known), mine.eqNullSafe(F.col(s)), "left").select(*own, F.col(sv).alias(value))
    heavy = F.col(k) > HEAVY_SHARE * size["rows"]
    first = rows.join(F.broadcast(known.filter(heavy).select(F.col(s).alias(h), F.struct(sv).alias(hv))), mine.eqNullSafe(F.col(h)), "left")
    first = first.withColumn(spread, F.when(F.col(hv).isNotNull(), 1 + F.monotonically_increasing_id() % 4096).otherwise(0))
    rest = known.filter(~heavy).select(s, sv, F.lit(0).cast("long").alias(k))
    joined = first.join(rest, mine.eqNullSafe(F.col(s)) & (F.col(spread) == F.col(k)), "left")
    return joined.select(*own, F.coalesce(F.col(hv)[sv], F.col(sv)).alias(value))


#: Stages whose tables results may still read; they go when the driver ends.
_LEFT: list[Stages] = []


@atexit.register
def _clear() -> None:
    for stages in _LEFT:
        if stages.spark.sparkContext._jsc is not None:  # else the session has been stopped, and the folder is the cluster's
            with contextlib.suppress(Exception):
                stages.drop()


class Stages:
    """Tables that cut lineage, written to the shared folder; a lost executor loses none of them.

    What is not dropped before is dropped when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        _LEFT.append(self)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def measured(self, df: DataFrame, name: str, **metrics) -> tuple[DataFrame, dict]:
        """Writes the table and gives these aggregates of it from the same job, besides its number of rows ``n``."""
        from pyspark.sql import Observation

        seen = Observation()
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("n"), *[e.alias(k) for k, e in metrics.items()]), name)
        return out, seen.get

    def keyed(self, df: DataFrame, name: str, key: str, weight: str) -> tuple[DataFrame, dict]:
        """Writes the table and gives the size of it that join_back asks for."""
        chars = F.coalesce(F.sum(F.length(F.col(key).cast("string"))), F.lit(0))
        return self.measured(df, name, chars=chars, rows=F.coalesce(F.sum(weight), F.lit(0)))

    def free(self) -> None:
        """Lets Spark remove the shuffle files of what has been written; it does so when the driver's garbage is collected."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names, or all."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in [f"{self.folder}/*-{n}" for n in names] or [self.folder]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            fs = p.getFileSystem(conf)
            for status in fs.globStatus(p) or []:
                with contextlib.suppress(Exception):
                    fs.delete(status.getPath(), True)


#: Bits of a filter of values: as many a value, and at most so many in all.
BITS_A_KEY, MAX_BITS = 16, 1 << 28


#: Bits of a block of a bitmap, as a power of two.
BLOCK_BITS = 19


def bits_for(n: int) -> int:
    """Bits of a bitmap of n values, a power of two."""
    return min(MAX_BITS, 1 << max(20, (n * BITS_A_KEY).bit_length()))


def mark(block: np.ndarray | None, at: np.ndarray) -> np.ndarray:
    """A block of a bitmap, a new one if None, with these places marked too."""
    block = np.zeros((1 << BLOCK_BITS) // 32, np.uint32) if block is None else block
    np.bitwise_or.at(block, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
    return block


def broadcast_blocks(rows: DataFrame, bits: int, *names: str):
    """Broadcasts a bitmap from each of these columns of blocks. The driver takes bits/8 bytes a column at most."""
    out = [np.zeros(bits // 32, np.uint32) for _ in names]
    for r in rows.collect():
        at = r.block << (BLOCK_BITS - 5)
        for words, name in zip(out, names, strict=True):
            words[at : at + (1 << (BLOCK_BITS - 5))] = np.frombuffer(r[name], np.uint32)
    return rows.sparkSession.sparkContext.broadcast(out if len(out) > 1 else out[0])


def filter_of(ids: DataFrame, key: str, n: int):
    """A broadcast filter of a column's n values (by their xxhash64) and its number of bits.

    It lets through all of them, and few others unless they are more than the bits allow for; an exact step must follow.
    Executors make its blocks.
    """
    bits = bits_for(n)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("bit").to_numpy(zero_copy_only=False)
            for block in np.unique(at >> BLOCK_BITS).tolist():
                held[block] = mark(held.get(block), at[at >> BLOCK_BITS == block] & ((1 << BLOCK_BITS) - 1))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([m.tobytes() for m in held.values()], pa.binary())], names=["block", "marks"])

    rows = ids.select(F.pmod(F.xxhash64(key), F.lit(bits)).alias("bit")).repartition(F.expr(f"shiftright(bit, {BLOCK_BITS})"))
    return broadcast_blocks(rows.mapInArrow(run, "block long, marks binary"), bits, "marks"), bits


def is_set(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Whether the bits are set in a filter's words."""
    return ((words[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)


def slices(batch: pa.RecordBatch, sized: str | None = None, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded rows and, by the column ``sized``, bounded bytes."""
    if sized is None or batch.num_rows <= 1:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(sized)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))
        to = max(at + 1, min(to, at + rows, batch.num_rows))
        yield batch.slice(at, to - at)
        at = to


#: Rows and bytes that the JVM hands to a Python worker at once, where the session does not say otherwise.
ARROW_ROWS, ARROW_BYTES = 2048, 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, which a task holds in the JVM and in its worker; settings of the user's own stay."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if spark.conf.get(key, None) in (None, "10000", "64MB", "67108864b", str(64 << 20)):
            with contextlib.suppress(Exception):  # not every version has both
                spark.conf.set(key, str(value))


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def with_plain_names(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The frame and the function for its mapInArrow, which cannot take names with backticks; the function sees the own names."""
    names = df.columns
    if not any("`" in c for c in names):
        return df, run
    return df.toDF(*[f"_{k}" for k in range(len(names))]), lambda batches: run(b.rename_columns(names) for b in batches)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list] | None]], ddl: str, sized: str | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow in slices of bounded rows and, by the column ``sized``, bounded bytes. ``make`` runs once a task and gives the function from a slice to columns."""

    schema = arrow_schema(ddl)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, sized, rows):
                if (out := f(part)) is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip((out[n] for n in schema.names), schema.types, strict=True)], schema=schema)

    plain, run_plain = with_plain_names(df, run)
    return plain.mapInArrow(run_plain, ddl)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c):
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
