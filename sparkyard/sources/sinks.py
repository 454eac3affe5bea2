"""Writers: CSV with BOM, label text, configuration, JSON reports, versioned tables, flat views."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkyard.functions.taxonomy import CLASSES, classes
from sparkyard.session import delete_path


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with header and BOM, columns in their order; an empty table gives the header alone. For reports."""
    first, *rest = df.columns
    df.withColumnRenamed(first, "\ufeff" + first).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
    if not any(f.endswith(".csv") for f in _list(df.sparkSession, path)) or not df.limit(1).count():
        _write_text(df.sparkSession, os.path.join(path, "part-00000.csv"), "\ufeff" + ",".join([first, *rest]) + "\n", only=True)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _list(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _write_text(spark: SparkSession, path: str, text: str, only: bool = False) -> None:
    p, fs = _fs(spark, path)
    if only:
        for s in fs.listStatus(p.getParent()):
            if s.getPath().getName().endswith(".csv"):
                fs.delete(s.getPath(), False)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def label_text(boxes: DataFrame) -> DataFrame:
    """``(image_id, content)``: the boxes of an image as label lines, by class id, then position; 8 decimals."""
    x = boxes.join(F.broadcast(classes(boxes.sparkSession)), "class")
    line = F.array_sort(F.collect_list(F.struct("class_id", "x", "y", "w", "h")))  # the boxes of one image
    text = F.transform(line, lambda b: F.format_string("%d %.8f %.8f %.8f %.8f", b["class_id"], b["x"], b["y"], b["w"], b["h"]))
    return x.groupBy("image_id").agg(F.concat(F.array_join(text, "\n"), F.lit("\n")).alias("content"))


def write_label_files(labels: DataFrame, folder: str) -> None:
    """One file per row ``(path, content)`` below a folder that all executors share: an absolute path, or the address of a store that Arrow's file systems know."""

    def write(rows) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for r in rows:
            target = f"{root}/{r['path']}"
            store.create_dir(target.rsplit("/", 1)[0], recursive=True)
            part = f"{target}.{uuid.uuid4().hex}"  # a task that runs twice leaves a whole file
            with store.open_output_stream(part) as f:
                f.write(r["content"].encode())
            store.move(part, target)

    labels.select("path", "content").foreachPartition(write)


def data_yaml(root: str, splits: list[str]) -> str:
    """The configuration that names the splits' folders and the classes."""
    lines = [f"path: {root}", *(f"{s}: images/{s}" for s in splits), f"nc: {len(CLASSES)}", "names:", *(f"  {i}: {c}" for i, c in enumerate(CLASSES))]
    return "\n".join(lines) + "\n"


def data_yamls(root: str, sources: list[str]) -> dict[str, str]:
    """By file name: the main configuration, and for each source one whose validation images are that source's alone."""
    out = {"data.yaml": data_yaml(root, ["train", "val", "test"])}
    for s in sources:
        out[f"data_val_{s}.yaml"] = data_yaml(root, ["train", "val", "test"]).replace("val: images/val\n", f"val: images/val/{s}\n")
    return out


def write_json_report(spark: SparkSession, report: dict, path: str) -> None:
    _write_text(spark, path, json.dumps(report, ensure_ascii=False, indent=2, default=str) + "\n")


class VersionedTable:
    """A table whose versions are folders; the current one is named by a small file that is replaced last, so readers see the old version or the new."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[str]:
        return sorted(v for v in _list(self.spark, self.root) if v.startswith("v"))

    def current(self) -> str | None:
        p, fs = _fs(self.spark, f"{self.root}/CURRENT")
        return self.spark.read.text(f"{self.root}/CURRENT").first()[0] if fs.exists(p) else None

    def read(self, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{version or self.current()}")

    def commit(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        """Writes the next version beside the others; a failed write leaves the current one as it was."""
        name = f"v{len(self.versions()):06d}"
        try:
            df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{self.root}/{name}")
        except Exception:
            delete_path(self.spark, f"{self.root}/{name}")
            raise
        _write_text(self.spark, f"{self.root}/CURRENT", name)
        return name

    def roll_back(self, version: str) -> None:
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        _write_text(self.spark, f"{self.root}/CURRENT", version)


def flat_view(images: DataFrame) -> DataFrame:
    """A flat folder's names, source and file joined by ``__``; names that two images share are marked."""
    x = images.withColumn("flat_name", F.concat_ws("__", "source", "image"))
    twice = x.groupBy("flat_name").agg((F.count(F.lit(1)) > 1).alias("collides"))
    return x.join(twice, "flat_name")


def flat_labels(labels: DataFrame) -> DataFrame:
    """Label texts ``(path, content)`` without repeated lines; the first of each stays in its place."""
    lines = F.array_distinct(F.filter(F.transform(F.split("content", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return labels.withColumn("content", F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(""))


def mirrored(images: DataFrame, splits: tuple[str, ...] = ("train", "valid")) -> DataFrame:
    """Every image in each of the splits: the pool on which a final model is trained."""
    return images.drop("split").withColumn("split", F.explode(F.array(*map(F.lit, splits))))
