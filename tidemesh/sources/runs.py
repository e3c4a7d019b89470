"""Runs that are told only when whole: outputs go to a folder of their attempt, and a manifest names it at the end.

    path/_attempts/<run_id>-<attempt>/<output>/...    what an attempt has written, whole or not
    path/_runs/<run_id>.json                          the manifest: run_id, attempt folder, names of outputs

Readers go by manifests alone, so an attempt that fails leaves nothing that they see, and can be made again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "run_id string, folder string, outputs array<string>"


def _files(spark: SparkSession, path: str):
    """(file system, file context, maker of paths) of the folder, whichever store it lies in."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(conf)
    return system, jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf), jvm.org.apache.hadoop.fs.Path


def write_run(spark: SparkSession, path: str, run_id: str, outputs: dict[str, Callable[[str], None]]) -> str:
    """Writes the outputs (name -> function that writes to the folder it is given), then the manifest; its folder.

    A run_id is used once: with a manifest there it is an error, before anything is written or, where another attempt was
    faster, at the end. The manifest is written beside and renamed without overwriting, so it is there whole or not at all.
    """
    if not run_id or "/" in run_id or run_id.startswith((".", "_")):
        raise ValueError(f"not a name for a run: {run_id!r}")
    system, context, at = _files(spark, path)
    manifest = at(f"{path}/_runs/{run_id}.json")
    if system.exists(manifest):
        raise FileExistsError(f"run {run_id} is written already")
    folder = f"{path}/_attempts/{run_id}-{uuid.uuid4().hex}"
    for name, write in outputs.items():
        write(f"{folder}/{name}")
    draft = at(f"{folder}/manifest.json")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps({"run_id": run_id, "folder": folder, "outputs": list(outputs)}).encode()))
    out.close()
    system.mkdirs(manifest.getParent())
    try:
        context.rename(draft, manifest, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        if system.exists(manifest):
            raise FileExistsError(f"run {run_id} was written by another attempt") from e
        raise
    return folder


def runs(spark: SparkSession, path: str) -> DataFrame:
    """run_id, folder, outputs of every whole run; none where nothing was written."""
    system, _, at = _files(spark, path)
    if not system.exists(at(f"{path}/_runs")):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{path}/_runs")


def output(spark: SparkSession, path: str, run_id: str, name: str) -> str:
    """The folder of one output of a whole run."""
    found = runs(spark, path).where(f"run_id = '{run_id}'").first()
    if found is None or name not in found["outputs"]:
        raise FileNotFoundError(f"no whole run {run_id} with {name}")
    return f"{found['folder']}/{name}"
