"""What the training-data operators share: reading, materialising, and Arrow output."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For words of letters, digits and what is not ASCII: every other byte as a space, and A-Z in lower case.
AS_WORDS = bytes(b + 32 if 0x41 <= b < 0x5B else b if 0x30 <= b < 0x3A or 0x61 <= b < 0x7B or b >= 0x80 else 32 for b in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the context's checkpoint folder. A local master may do without and gets a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kitwright-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage, in :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def batch(schema: pa.Schema, columns: Sequence[Iterable]) -> pa.RecordBatch:
    """A record batch from one iterable of values for each field."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def id_bucket(id_column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``: the rule that sets held-out folds apart."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % modulus
