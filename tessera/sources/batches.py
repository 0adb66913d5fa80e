"""A sink that survives rows it can't write: batches, retries row by row, a quarantine, and two phases.

Each task encodes its rows in batches.  A batch in which a row fails is given up and its rows are tried one by one, so that only those that fail are left out; they go to
the quarantine with their error.  A task writes files of its own in a staging folder and reports them; once all tasks are through the driver
moves the reported files into place and writes the job's manifest, the last file of all.  A task that dies, or is run twice, leaves files that nobody reports,
and a job that fails leaves none.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BATCH = 1000


def as_json(row: dict) -> str:
    """A row as a line of JSON, characters as they are; what has no JSON fails."""
    return json.dumps(row, ensure_ascii=False, allow_nan=False)


@dataclass
class Staged(WriterCommitMessage):
    rows: str
    bad: str
    n_rows: int
    n_bad: int
    n_retried: int


class BatchSource(DataSource):
    """Options: path, encode (a pickled function from a row as a dict to a line; it raises for a row that can't be written), batch (rows)."""

    @classmethod
    def name(cls) -> str:
        return "batches"

    def schema(self) -> str:
        raise NotImplementedError("written only; read its lines as JSON")

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("batches are only appended")
        return BatchWriter(dict(self.options))


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.encode = options["path"].rstrip("/"), options.get("encode")
        self.batch, self.job = int(options.get("batch", BATCH)), uuid.uuid4().hex

    def _place(self):
        """The file system of the path, and the path in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, iterator: Iterator) -> Staged:
        encode = cloudpickle.loads(base64.b64decode(self.encode)) if self.encode else as_json
        files, top = self._place()
        staged = f"{top}/_staged/{self.job}"
        files.create_dir(staged, recursive=True)
        name = uuid.uuid4().hex
        out = Staged(f"{staged}/{name}.rows", f"{staged}/{name}.bad", 0, 0, 0)
        with files.open_output_stream(out.rows) as good, files.open_output_stream(out.bad) as bad:
            for part in iterator:
                for at in range(0, part.num_rows, self.batch):
                    rows = part.slice(at, self.batch).to_pylist()
                    try:
                        lines = [encode(r) for r in rows]
                    except Exception:  # noqa: BLE001  whatever the encoder raises costs its row only
                        lines, out.n_retried = [], out.n_retried + 1
                        for r in rows:
                            try:
                                lines.append(encode(r))
                            except Exception as e:  # noqa: BLE001
                                bad.write((json.dumps({"error": f"{type(e).__name__}: {e}", "row": repr(r)}) + "\n").encode())
                                out.n_bad += 1
                    good.write("".join(f"{x}\n" for x in lines).encode("utf-8", "surrogatepass"))
                    out.n_rows += len(lines)
        return out

    def commit(self, messages: list[Staged | None]) -> None:
        files, top = self._place()
        done = [m for m in messages if m is not None]
        for folder in ("rows", "quarantine", "manifests"):
            files.create_dir(f"{top}/{folder}", recursive=True)
        for m in done:
            for kind, staged, n in (("rows", m.rows, m.n_rows), ("quarantine", m.bad, m.n_bad)):
                if n:
                    files.move(staged, f"{top}/{kind}/{self.job}-{staged.rpartition('/')[2].partition('.')[0]}.json")
        with files.open_output_stream(f"{top}/manifests/{self.job}.json") as f:
            f.write(json.dumps({"job": self.job, "rows": sum(m.n_rows for m in done), "bad": sum(m.n_bad for m in done), "retried": sum(m.n_retried for m in done)}).encode())
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """The job's staging folder, with what tasks left that nobody reported."""
        files, top = self._place()
        staged = f"{top}/_staged/{self.job}"
        if files.get_file_info(staged).type.name == "Directory":
            files.delete_dir(staged)


def insert(df: DataFrame, path: str, encode: Callable[[dict], str] | None = None, batch: int = BATCH) -> None:
    """Append ``df`` as lines below ``path``; rows that can't be encoded go to the quarantine."""
    df.sparkSession.dataSource.register(BatchSource)
    writer = df.write.format("batches").mode("append").option("path", path).option("batch", str(batch))
    (writer.option("encode", base64.b64encode(cloudpickle.dumps(encode)).decode()) if encode else writer).save()


def rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/rows")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """(error, row) of the rows left out; none if no row ever was."""
    return spark.read.schema("error string, row string").json(f"{path}/quarantine")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("job string, rows long, bad long, retried long").json(f"{path}/manifests")
