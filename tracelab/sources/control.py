"""Small control files on the driver: JSON objects, manifests, configs and digests."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_object(path: str | Path) -> dict[str, Any]:
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path} doesn't hold a JSON object")
    return value


def _files(spark: SparkSession, path: str):
    """Hadoop's view of a path's file system, local or not, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    qualified = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place)
    return spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration()), qualified


def put_object(spark: SparkSession, path: str | Path, value: dict[str, Any]) -> None:
    """Puts a JSON object at path in whatever file system it is in: readers see the one before or the new one, never a part. It is made durable beside the target, whose
    name it then takes in one step of the file system."""
    files, target = _files(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    array = spark.sparkContext._gateway.new_array
    flags = spark._jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE)
    parents = array(hadoop.Options.CreateOpts, 1)
    parents[0] = hadoop.Options.CreateOpts.createParent()
    aside = hadoop.Path(target.getParent(), f"_{uuid.uuid4().hex}.json")
    out = files.create(aside, flags, parents)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode()))
    out.hsync()
    out.close()
    how = array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    files.rename(aside, target, how)


def get_object(spark: SparkSession, path: str | Path) -> dict[str, Any] | None:
    """The JSON object at path; None if there is no file."""
    files, target = _files(spark, path)
    if not files.util().exists(target):
        return None
    value = json.loads("\n".join(r[0] for r in spark.read.text(str(target.toString()), wholetext=True).collect()))
    if not isinstance(value, dict):
        raise ValueError(f"{path} doesn't hold a JSON object")
    return value


def publish_folder(target: str | Path, files: dict[str, str]) -> None:
    """All files at once in a new folder; refuses an existing one and leaves nothing behind if it fails."""
    target = Path(target)
    if target.exists():
        raise FileExistsError(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=target.parent, prefix=f".{target.name}.") as folder:
        inner = Path(folder) / "new"
        inner.mkdir()
        for name, text in files.items():
            (inner / name).write_text(text, encoding="utf-8")
        os.rename(inner, target)


def require_new(path: str | Path, resume: bool = False) -> None:
    if Path(path).exists() and not resume:
        raise FileExistsError(f"{path} exists; resume or choose another output")


def differences(expected: dict[str, Any], found: dict[str, Any]) -> list[str]:
    """Keys, with a path into nested objects, whose values aren't equal."""
    out: list[str] = []
    for k in sorted({*expected, *found}):
        one, two = (x.get(k, differences) for x in (expected, found))
        if isinstance(one, dict) and isinstance(two, dict):
            out += [f"{k}.{inner}" for inner in differences(one, two)]
        elif one != two:
            out.append(k)
    return out


def claim(spark: SparkSession, path: str | Path, manifest: dict[str, Any], resume: bool) -> None:
    """Makes an output this run's: a new run needs that no manifest is there, and puts its own; a resumed one needs an equal one."""
    found = get_object(spark, path)
    if resume and found is None:
        raise FileNotFoundError(f"{path}: nothing to resume")
    if not resume and found is not None:
        raise FileExistsError(f"{path}: another run's output; resume it or choose another place")
    if resume and (apart := differences(manifest, found)):
        raise ValueError(f"{path}: this run differs in {', '.join(apart)}")
    if not resume:
        put_object(spark, path, manifest)


def unchanged(inputs: dict[str, str]) -> list[str]:
    """Of paths with the digests they had, those whose file is another now or gone."""
    return [p for p, digest in inputs.items() if not os.path.exists(p) or file_digest(p) != digest]


def key_drift(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Keys on one side only, with the side."""
    return expected.exceptAll(found).withColumn("side", F.lit("expected")).unionByName(found.exceptAll(expected).withColumn("side", F.lit("found")))


def file_digest(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def checkpoint_name(conversation_id: Column) -> Column:
    return F.concat(F.sha2(conversation_id, 256), F.lit(".json"))


def read_config(path: str | Path) -> dict[str, Any]:
    """A JSON config, or YAML where its reader is installed; values that name a path are resolved against the config's folder."""
    path = Path(path)
    if path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("YAML needs an installed reader; write the config as JSON") from error
        value = yaml.safe_load(path.read_text(encoding="utf-8"))
    else:
        value = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path} doesn't hold an object")
    return {k: str((path.parent / v).resolve()) if k.endswith("_path") and isinstance(v, str) else v for k, v in value.items()}
