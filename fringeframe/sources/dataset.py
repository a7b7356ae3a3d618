"""Datasets of samples: a folder for each window, written as a whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from fringeframe.sources.members import place

#: Columns of a sample; those in OPTIONAL may be absent, and flags are written only where one is set.
SCHEMA = "spw int, chan int, row_id long, u_m double, v_m double, w_m double, freq_hz double, re double, im double, sig_re double, sig_im double, flag boolean, ant1 int, ant2 int, time_s double"
OPTIONAL = ("row_id", "w_m", "freq_hz", "flag", "ant1", "ant2", "time_s")
#: What a live sample must have: finite values and places, noise above zero, a frequency above zero if there is one.
FINITE, ABOVE = ("u_m", "v_m", "re", "im", "freq_hz", "sig_re", "sig_im"), ("sig_re", "sig_im", "freq_hz")
#: Rows of a file.
FILE_ROWS = 1 << 22


def faults(batch: pa.RecordBatch) -> dict[str, int]:
    """Numbers of samples that a dataset must not hold, by what is wrong with them."""
    column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
    live = pc.invert(pc.fill_null(column["flag"], False)) if "flag" in column else pa.array(np.ones(batch.num_rows, bool))
    out = {f"{n} is missing": column[n].null_count for n in ("spw", "chan")}
    for n in (n for n in FINITE if n in column):
        out[f"{n} is not finite"] = pc.sum(pc.and_(live, pc.invert(pc.fill_null(pc.is_finite(column[n]), False)))).as_py() or 0
    for n in (n for n in ABOVE if n in column):
        out[f"{n} is not above zero"] = pc.sum(pc.and_(live, pc.fill_null(pc.less_equal(column[n], 0.0), False))).as_py() or 0
    return {k: v for k, v in out.items() if v}


@dataclass
class Written(WriterCommitMessage):
    """What a task has put aside: (window, file) of its files, rows and live ones by window, faults, frequency by window and channel."""

    files: list[tuple[int, str]] = field(default_factory=list)
    rows: dict[int, int] = field(default_factory=dict)
    live: dict[int, int] = field(default_factory=dict)
    faults: dict[str, int] = field(default_factory=dict)
    channels: dict[tuple[int, int], tuple[float, float]] = field(default_factory=dict)


class DatasetWriter(DataSourceArrowWriter):
    """Tasks write files to a folder of their own run beside the dataset; the driver validates what they report and only then moves them in.

    A task that fails takes its files with it, a run that fails or is refused takes its folder, which no task makes again, so a dataset is whole or
    isn't there. Attempts never share a name.
    """

    def __init__(self, path: str, meta: str, overwrite: bool):
        self.path, self.meta, self.overwrite = path.rstrip("/"), meta, overwrite
        self.aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        files, aside = place(self.aside)
        files.create_dir(aside, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, aside = place(self.aside)
        done, open_, rows = Written(), {}, {}
        made: list[str] = []
        try:
            for batch in iterator:
                for what, n in faults(batch).items():
                    done.faults[what] = done.faults.get(what, 0) + n
                table = pa.Table.from_batches([batch])
                if "flag" not in table.column_names:
                    table = table.append_column("flag", pa.array(np.zeros(len(table), bool)))
                for spw in pc.unique(table["spw"]).to_pylist():
                    if spw is None:
                        continue
                    own = table.filter(pc.equal(table["spw"], spw)).drop_columns(["spw"])
                    for r in () if "freq_hz" not in own.column_names else own.group_by("chan").aggregate([("freq_hz", "min"), ("freq_hz", "max")]).to_pylist():
                        low, high = done.channels.get((spw, r["chan"]), (np.inf, -np.inf))
                        if r["freq_hz_min"] is not None:
                            done.channels[spw, r["chan"]] = min(low, r["freq_hz_min"]), max(high, r["freq_hz_max"])
                    flagged = bool(pc.any(pc.fill_null(own["flag"], False)).as_py())
                    done.rows[spw] = done.rows.get(spw, 0) + len(own)
                    done.live[spw] = done.live.get(spw, 0) + len(own) - (pc.sum(own["flag"]).as_py() or 0)
                    # Files with and without flags are apart, so that a column is there only if it says something.
                    own = own if flagged else own.drop_columns(["flag"])
                    key = spw, flagged
                    if rows.get(key, 0) >= FILE_ROWS:
                        open_.pop(key).close()
                        rows[key] = 0
                    if key not in open_:
                        name = f"part-{uuid.uuid4().hex}.parquet"
                        made.append(name)
                        open_[key] = pq.ParquetWriter(f"{aside}/{name}", own.schema, filesystem=files)
                        done.files.append((spw, name))
                    open_[key].write_table(own)
                    rows[key] = rows.get(key, 0) + len(own)
            for w in open_.values():
                w.close()
        except BaseException:
            for w in open_.values():
                w.close()
            for name in made:
                files.delete_file(f"{aside}/{name}")
            raise
        return done

    def refused(self, messages: list[Written]) -> str | None:
        """Why the rows of all tasks make no dataset, or None."""
        wrong: dict[str, int] = {}
        span: dict[tuple[int, int], tuple[float, float]] = {}
        for m in messages:
            for what, n in m.faults.items():
                wrong[what] = wrong.get(what, 0) + n
            for key, (low, high) in m.channels.items():
                a, b = span.get(key, (np.inf, -np.inf))
                span[key] = min(a, low), max(b, high)
        if wrong:
            return "; ".join(f"{what} in {n} samples" for what, n in sorted(wrong.items()))
        if uneven := [k for k, (a, b) in sorted(span.items()) if a != b]:
            return f"frequencies differ within (window, channel) {uneven[:5]}"
        if not any(sum(m.live.values()) for m in messages):
            return "no sample is left unflagged"
        return None

    def commit(self, messages: list[Written | None]) -> None:
        own = [m for m in messages if m is not None]
        if why := self.refused(own):
            self.abort(messages)
            raise ValueError(f"{self.path} is not written: {why}")
        files, root = place(self.path)
        _, aside = place(self.aside)
        before = [i.path for i in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File and not i.path.startswith(aside)]
        for m in own:
            for spw, name in m.files:
                files.create_dir(f"{root}/spw={spw}", recursive=True)
                files.move(f"{aside}/{name}", f"{root}/spw={spw}/{name}")
        for path in before if self.overwrite else ():
            files.delete_file(path)
        rows = {str(k): sum(m.rows.get(k, 0) for m in own) for k in sorted({k for m in own for k in m.rows})}
        with files.open_output_stream(f"{root}/_meta.json") as f:
            f.write(json.dumps({**json.loads(self.meta), "rows": rows}, indent=1).encode())
        self.drop(files, aside)

    def abort(self, messages: list[Written | None]) -> None:
        self.drop(*place(self.aside))

    @staticmethod
    def drop(files: fs.FileSystem, aside: str) -> None:
        if files.get_file_info(aside).type == fs.FileType.Directory:
            files.delete_dir(aside)


class DatasetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "visdata"

    def writer(self, schema: StructType, overwrite: bool) -> DatasetWriter:
        missing = [c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] not in OPTIONAL and c.split()[0] not in schema.names]
        if missing:
            raise ValueError(f"a dataset needs the columns {', '.join(missing)}")
        return DatasetWriter(self.options["path"], self.options.get("meta", "{}"), overwrite)


def write_visibilities(vis: DataFrame, path: str, meta: dict | None = None, overwrite: bool = False) -> None:
    """A dataset with a folder for each window and _meta.json beside them.

    Live samples must have finite places and values, noise above zero and one frequency for each channel, and one of them must be there;
    else nothing is written and ValueError (by way of Spark) says what is wrong. Optional columns are written if ``vis`` has them, flags only where one is set.
    """
    spark = vis.sparkSession
    spark.dataSource.register(DatasetSource)
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    files, root = place(path)
    if not overwrite and any(i.type == fs.FileType.File for i in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))):
        raise FileExistsError(path)
    chosen = vis.select(*(F.col(c).cast(t) for c, t in kinds.items() if c in vis.columns))
    chosen.write.format("visdata").option("meta", json.dumps(meta or {})).mode("overwrite" if overwrite else "append").save(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a dataset; optional columns that weren't written are null, flags false. A table of other columns is read as it stands."""
    plain = spark.read.parquet(path)
    if not {"u_m", "v_m", "re", "im"} <= set(plain.columns):
        return plain
    return spark.read.schema(SCHEMA).option("basePath", path).parquet(path).withColumn("flag", F.coalesce("flag", F.lit(False)))
