"""Writers as data sources: tasks write under a temporary name, and the job's commit puts all files in their places at once.

A task that fails, or is started twice, leaves files that no commit message names; commit and abort remove them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from .records import located

#: Consecutive keys that go to one task.
SPAN = 1 << 16


@dataclass
class Written(ds.WriterCommitMessage):
    """Temporary file and place of what a task has written."""

    files: list[tuple[str, str]]


class CommittedWriter(ds.DataSourceArrowWriter):
    """Puts the files of all tasks in place, or removes them all."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.temporary = f"{self.path}/_temporary-{options['job']}"
        self.o = options

    def commit(self, messages: list[Written | None]) -> None:
        system, place = located(self.path)
        if self.overwrite:
            from pyarrow import fs

            for old in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                if not old.base_name.startswith("_temporary-"):
                    system.delete_dir(old.path) if old.type == fs.FileType.Directory else system.delete_file(old.path)
        for message in messages:
            for held, final in message.files if message else ():
                target = located(final)[1]
                system.create_dir(target.rpartition("/")[0], recursive=True)
                system.move(located(held)[1], target)
        self.cleared()

    def abort(self, messages: list[Written | None]) -> None:
        self.cleared()

    def cleared(self) -> None:
        from pyarrow import fs

        system, place = located(self.temporary)
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


class FieldBatches(ds.DataSource):
    """SNK-GS: rows of (batch, key, values) as a folder for each batch of fields; format name gridloom_field_batches.

    Options: path, job, key, and names, the fields of each batch: commas within a batch, semicolons between."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_field_batches"

    def writer(self, schema, overwrite: bool) -> ds.DataSourceWriter:
        return BatchWriter(self.options, overwrite)


class BatchWriter(CommittedWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        names = [x.split(",") for x in self.o["names"].split(";")]
        system, top = located(self.temporary)
        system.create_dir(top, recursive=True)
        mine = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        files, now, out, sink = [], None, None, None
        try:
            for rows in iterator:
                batch = rows.column("batch").to_numpy()
                bounds = [0, *(np.flatnonzero(batch[1:] != batch[:-1]) + 1).tolist(), len(batch)] if len(batch) else [0]
                for a, b in zip(bounds, bounds[1:]):
                    k, part = int(batch[a]), rows.slice(a, b - a)
                    if k != now:
                        if out is not None:
                            out.close()
                            sink.close()
                        now = k
                        schema = pa.schema([(self.o["key"], pa.int64()), *[(c, pa.float64()) for c in names[k]]])
                        sink = system.open_output_stream(f"{top}/{k:04d}-{mine}", compression=None)
                        out = pq.ParquetWriter(sink, schema, compression="zstd")
                        files.append((f"{self.temporary}/{k:04d}-{mine}", f"{self.path}/batch={k:04d}/part-{mine}.parquet"))
                    values = part.column("values")
                    # A row's list has as many values as its batch has fields.
                    flat, n = values.flatten(), len(names[k])
                    columns = [flat.take(pa.array(np.arange(c, len(flat), n))) for c in range(n)]
                    out.write_table(pa.Table.from_arrays([part.column("key").cast(pa.int64()), *columns], schema=schema))
        finally:
            if out is not None:
                out.close()
                sink.close()
        return Written(files)


def write_batches(df: DataFrame, path: str, fields: list[str], each: int = 10, writers: int = 16, key: str = "iglo") -> list[str]:
    """SNK-GS: fields in batches of `each` columns, a folder for each batch, by `writers` tasks; gives the folders.

    df is computed once, whatever the number of batches: each point gives a row for each batch, dealt by batch and span of keys."""
    groups = [fields[k : k + each] for k in range(0, len(fields), each)]
    if any("," in f or ";" in f for f in fields):
        raise ValueError("names of fields must not hold commas or semicolons")
    spark = df.sparkSession
    spark.dataSource.register(FieldBatches)
    rows = F.array(*[F.struct(F.lit(k).alias("batch"), F.array(*[F.col(f"`{f}`").cast("double") for f in g]).alias("values")) for k, g in enumerate(groups)])
    long = df.select(F.col(key).cast("long").alias("key"), F.inline(rows)).select("batch", "key", "values")
    dealt = long.repartition(writers, "batch", F.floor(F.col("key") / SPAN)).sortWithinPartitions("batch", "key")
    dealt.write.format("gridloom_field_batches").options(path=path, key=key, job=uuid.uuid4().hex, names=";".join(",".join(g) for g in groups)).mode("append").save()
    return [f"{path}/batch={k:04d}" for k in range(len(groups))]


class OneRecord(ds.DataSource):
    """SNK-SOILVEG: rows of (at, value) as one sequential record in one file, written by many tasks; format name gridloom_record.

    Options: path (of the file's folder), file, job, count, nodata. Rows of a task are runs of consecutive places."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_record"

    def writer(self, schema, overwrite: bool) -> ds.DataSourceWriter:
        return RecordWriter(self.options, overwrite)


class RecordWriter(CommittedWriter):
    """Where files can be written at any place, tasks write into one file; elsewhere each writes a part, and commit puts the parts together in a stream."""

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, False)
        self.count = int(options["count"])

    def positioned(self) -> bool:
        from pyarrow import fs

        return isinstance(located(self.path)[0], fs.LocalFileSystem)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import os

        system, top = located(self.temporary)
        system.create_dir(top, recursive=True)
        nodata, files, expected, out = float(self.o["nodata"]), [], None, None
        try:
            if self.positioned():
                out = os.open(f"{top}/record", os.O_CREAT | os.O_WRONLY)
            for rows in iterator:
                at = rows.column("at").to_numpy()
                raw = rows.column("value").fill_null(nodata).to_numpy().astype(">f8")
                bounds = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)] if len(at) else [0]
                for a, b in zip(bounds, bounds[1:]):
                    data = raw[a:b].tobytes()
                    if self.positioned():
                        os.pwrite(out, data, 4 + 8 * int(at[a]))
                        continue
                    if at[a] != expected:
                        if out is not None:
                            out.close()
                        name = f"{at[a]:020d}-{uuid.uuid4().hex}"
                        out = system.open_output_stream(f"{top}/{name}", compression=None)
                        files.append((f"{self.temporary}/{name}", str(at[a])))
                    out.write(data)
                    expected = int(at[b - 1]) + 1
        finally:
            if out is not None:
                os.close(out) if isinstance(out, int) else out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        import os

        system, top = located(self.temporary)
        system.create_dir(top, recursive=True)
        mark = np.array([8 * self.count], ">i4").tobytes()
        if self.positioned():
            out = os.open(f"{top}/record", os.O_CREAT | os.O_WRONLY)
            os.pwrite(out, mark, 0)
            os.pwrite(out, mark, 4 + 8 * self.count)
            os.close(out)
        else:
            parts = sorted((int(at), held) for m in messages if m for held, at in m.files)
            with system.open_output_stream(f"{top}/record", compression=None) as out:
                out.write(mark)
                for _, held in parts:
                    with system.open_input_stream(located(held)[1], compression=None) as part:
                        while data := part.read(1 << 20):
                            out.write(data)
                out.write(mark)
        system.move(f"{top}/record", f"{located(self.path)[1]}/{self.o['file']}")
        self.cleared()


def write_record(df: DataFrame, path: str, field: str, nodata: float = -9999.0, key: str = "iglo") -> DataFrame:
    """SNK-SOILVEG: one sequential record of big-endian doubles in the order of the key, missing values as the sentinel; gives path and n_values.

    A value's place is its rank. Keys are cut into spans, whose counts give where each starts, and spans are written by many tasks."""
    spark = df.sparkSession
    spark.dataSource.register(OneRecord)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(field).cast("double").alias("value")).withColumn("span", F.floor(F.col("key") / SPAN))
    counts = rows.groupBy("span").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each span
    starts = counts.withColumn("start", before).select("span", "start")
    own = F.row_number().over(Window.partitionBy("span").orderBy("key")) - 1
    placed = rows.withColumn("own", own).join(starts, "span").select((F.col("start") + F.col("own")).alias("at"), "value")
    count = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    folder, _, name = path.rpartition("/")
    placed.write.format("gridloom_record").options(path=folder, file=name, job=uuid.uuid4().hex, count=count, nodata=nodata).mode("append").save()
    return spark.range(1).select(F.lit(path).alias("path"), F.lit(count).cast("long").alias("n_values"))
