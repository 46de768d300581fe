"""Writers and readers of the hand-written models and estimators, in Spark ML's own layout.

An object becomes a folder with ``metadata`` (one JSON line: class, uid and
settings, as Spark ML writes it) and, if it holds fitted numbers, ``data``
(Parquet: name, shape, block number, values).  So ``model.write().overwrite().save``,
``Model.load``, and pipelines that hold such stages work as for Spark's own.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

#: Numbers of an array in one row of the data part.
_BLOCK = 100_000

_DATA = "name string, shape array<bigint>, block int, values array<double>"


def write_arrays(spark: SparkSession, path: str, arrays: dict[str, np.ndarray]) -> None:
    rows = []
    for name, array in arrays.items():
        flat = np.asarray(array, np.float64)
        shape, flat = list(flat.shape), flat.ravel()
        for k, at in enumerate(range(0, max(len(flat), 1), _BLOCK)):
            rows.append((name, shape, k, flat[at:at + _BLOCK].tolist()))
    spark.createDataFrame(rows, _DATA).write.parquet(path)


def read_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    found: dict[str, tuple] = {}
    for r in spark.read.schema(_DATA).parquet(path).orderBy("name", "block").collect():  # the fitted numbers
        found.setdefault(r["name"], (r["shape"], []))[1].append(np.array(r["values"], np.float64))
    return {name: np.concatenate(parts).reshape(shape) for name, (shape, parts) in found.items()}


class _Writer(MLWriter):
    def __init__(self, instance: Persisted):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession,
                                         extraMetadata={"settings": self.instance.settings()})
        arrays = self.instance.arrays()
        if arrays:
            write_arrays(self.sparkSession, f"{path}/data", arrays)
        for name, part in self.instance.parts().items():
            part.write().save(f"{path}/{name}")
        for name, table in self.instance.tables().items():
            table.write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, cls: type[Persisted]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Persisted:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        settings = metadata["settings"]
        arrays = read_arrays(self.sparkSession, f"{path}/data") if self.cls.has_arrays else {}
        parts = {name: DefaultParamsReader.loadParamsInstance(f"{path}/{name}", self.sparkSession)
                 for name in self.cls.part_names}
        parts |= {name: self.sparkSession.read.parquet(f"{path}/{name}") for name in self.cls.table_names}
        out = self.cls.restored(settings, arrays, parts)
        out._resetUid(metadata["uid"])
        return out


class Persisted(MLWritable, MLReadable):
    """Mixin: ``settings`` (JSON values), ``arrays`` (fitted numbers), ``parts`` (Spark ML objects inside), ``tables``."""

    has_arrays = False
    part_names: tuple[str, ...] = ()
    table_names: tuple[str, ...] = ()

    def settings(self) -> dict:
        return {}

    def arrays(self) -> dict[str, np.ndarray]:
        return {}

    def parts(self) -> dict[str, MLWritable]:
        return {}

    def tables(self) -> dict[str, DataFrame]:
        return {}

    @classmethod
    def restored(cls, settings: dict, arrays: dict[str, np.ndarray], parts: dict):
        return cls(**settings, **arrays, **parts)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)
