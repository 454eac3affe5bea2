"""Readers of the file formats around a data set: images, label text, CSV, JSON, id lists, snapshots, data set folders."""

from __future__ import annotations

import json
import os
import re
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkyard.functions.taxonomy import D1_NAMES

# Suffixes of archives and images, names a split's folder may have, the size limit of an image.
ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")
SPLIT_FOLDERS = {"train": ("train",), "val": ("valid", "val"), "test": ("test",)}
MAX_IMAGE_BYTES = 10 * 1024 * 1024


def is_archive(path: str) -> bool:
    return path.lower().endswith(ARCHIVES)


def prepare_source(folder: str, cache: str) -> str:
    """The root of a source: the folder if it holds a ``data.yaml``, else its one archive unpacked once into ``cache``, else its one sub-folder."""
    if find_yamls(folder):
        return choose_root(find_yamls(folder))
    entries = sorted(os.listdir(folder))
    archives = [e for e in entries if is_archive(e)]
    if len(archives) == 1:
        target = os.path.join(cache, os.path.basename(os.path.normpath(folder)))
        done = os.path.join(target, ".unpacked")
        if not os.path.exists(done):
            os.makedirs(target, exist_ok=True)
            path = os.path.join(folder, archives[0])
            if archives[0].lower().endswith(".zip"):
                with zipfile.ZipFile(path) as z:
                    z.extractall(target)
            else:
                with tarfile.open(path) as t:
                    t.extractall(target, filter="data")
            open(done, "w").close()
        return choose_root(find_yamls(target)) if find_yamls(target) else target
    inner = [e for e in entries if os.path.isdir(os.path.join(folder, e))]
    if not archives and len(inner) == 1:
        return os.path.join(folder, inner[0])
    raise ValueError(f"{folder}: neither a data.yaml, nor one archive, nor one sub-folder")


def find_yamls(folder: str) -> list[str]:
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.lower() in ("data.yaml", "data.yml"))


def choose_root(yamls: list[str]) -> str:
    """Of several data set files the folder with most split folders, then the shallowest, then the first by name."""
    roots = [os.path.dirname(y) for y in yamls]
    return min(roots, key=lambda r: (-sum(split_folder(r, s) is not None for s in SPLIT_FOLDERS), r.count(os.sep), r))


def split_folder(root: str, split: str, config: dict | None = None) -> str | None:
    """The shallowest folder of images of a split, whichever of its names it has; where there is none, the one that the data set file names."""
    found = [d for d, names, _ in os.walk(root) if os.path.basename(d).lower() in SPLIT_FOLDERS[split]]
    found.sort(key=lambda d: (d.count(os.sep), d))
    for d in found:
        return os.path.join(d, "images") if os.path.isdir(os.path.join(d, "images")) else d
    for key in SPLIT_FOLDERS[split]:
        named = (config or {}).get(key)
        path = os.path.normpath(os.path.join(root, str((config or {}).get("path") or ""), named)) if isinstance(named, str) else None
        if path and os.path.isdir(path):
            return path
    return None


def data_set_config(source: str, root: str) -> dict:
    """The data set file below the root; the source ``d1`` may lack one and then has its fixed class names."""
    yamls = find_yamls(root)
    if yamls:
        return load_yaml(min(yamls, key=lambda p: (p.count(os.sep), p)))
    if source == "d1":
        return {"names": list(D1_NAMES)}
    raise ValueError(f"{source}: no data.yaml below {root}")


def load_yaml(path: str) -> dict:
    """A data set file; where no YAML library is at hand, its flat keys and its list or map of names."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        return simple_yaml(text)


def simple_yaml(text: str) -> dict:
    out: dict = {}
    key = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line or line.lstrip().startswith("#"):
            continue
        scalar = lambda v: v.strip().strip("'\"")
        if line[0] not in " -" and ":" in line:
            key, _, v = line.partition(":")
            v = v.strip()
            out[key.strip()] = [scalar(x) for x in v[1:-1].split(",") if x.strip()] if v.startswith("[") else scalar(v) if v else None
            key = key.strip()
        elif line.lstrip().startswith("- ") and key:
            out[key] = [*(out[key] or []), scalar(line.lstrip()[2:])]
        elif ":" in line and key:
            k, _, v = line.strip().partition(":")
            out[key] = {**(out[key] or {}), int(k) if k.strip().isdigit() else k.strip(): scalar(v)}
    return out


def parse_names(names: list | dict) -> dict[int, str]:
    return {i: str(n) for i, n in enumerate(names)} if isinstance(names, list) else {int(i): str(n) for i, n in names.items()}


def names_table(spark: SparkSession, names: list | dict) -> DataFrame:
    return spark.createDataFrame(list(parse_names(names).items()), "id int, name string")


def list_images(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """``(path, length, modificationTime[, content])`` of the images below a folder; without ``content`` no file is opened."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    x = x.where(F.lower("path").rlike(r"\.(" + "|".join(s[1:] for s in IMAGES) + ")$"))
    return x if content else x.drop("content")


def image_size(data: bytes) -> tuple[int, int]:
    """Width and height from the header of a PNG, JPEG, BMP, GIF, WEBP or TIFF file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:4] == b"GIF8":
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                raise ValueError("damaged JPEG")
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + size
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind = data[12:16]
        if kind == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8L" and data[20] == 0x2F:
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        raise ValueError("damaged WEBP")
    if data[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if data[:2] == b"II" else ">"
        at = struct.unpack(order + "I", data[4:8])[0]
        sizes = {}
        for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            tag, kind = struct.unpack(order + "HH", data[at + 2 + 12 * i : at + 6 + 12 * i])
            value = data[at + 10 + 12 * i : at + 14 + 12 * i]
            if tag in (256, 257):
                sizes[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
        if len(sizes) == 2:
            return sizes[256], sizes[257]
        raise ValueError("damaged TIFF")
    raise ValueError("unknown image format")


def check_body(data: bytes) -> None:
    """Refuses a file that ends before its format says it does: what can be told without decoding."""
    whole = True
    if data[:4] == b"\x89PNG":
        whole = b"IEND" in data[-16:]
    elif data[:2] == b"\xff\xd8":
        whole = b"\xff\xd9" in data[-64:]
    elif data[:4] == b"GIF8":
        whole = data.rstrip(b"\0")[-1:] == b";"
    elif data[:2] == b"BM":
        whole = len(data) >= struct.unpack("<I", data[2:6])[0]
    elif data[:4] == b"RIFF":
        whole = len(data) >= 8 + struct.unpack("<I", data[4:8])[0]
    if not whole:
        raise ValueError("truncated")


def with_image_size(images: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``width``, ``height`` and ``problem``: empty, over the size limit, a header that can't be read, or a body cut short."""
    schema = T.StructType([*(images.schema[k] for k in keep), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("problem", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column("content").to_pylist():
                try:
                    if not data:
                        raise ValueError("empty")
                    if len(data) > MAX_IMAGE_BYTES:
                        raise ValueError("too large")
                    size = image_size(data)
                    check_body(data)
                    rows.append((*size, None))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((None, None, f"invalid_image:{type(e).__name__}:{e}"))
            w, h, p = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(p, pa.string())], schema.names)

    return images.select(*keep, "content").mapInArrow(run, schema)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line_no, line)`` of label text files; a missing file simply has no lines."""
    x = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), "value")
    return x.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def label_counts(lines: DataFrame) -> DataFrame:
    """Lines of five fields per file and class id."""
    f = F.split(F.trim("line"), r"\s+")
    return lines.where(F.size(f) == 5).withColumn("class_id", F.floor(f[0].try_cast("double")).cast("int")).where("class_id IS NOT NULL").groupBy("path", "class_id").agg(F.count(F.lit(1)).alias("n"))


def rel_stem(path: str = "path", kind: str = "images") -> F.Column:
    """What an image and its label file have in common: the path below ``images`` or ``labels``, without suffix."""
    return F.regexp_replace(F.regexp_extract(path, rf"(?:^|/){kind}/(.*)$", 1), r"\.[^./]*$", "")


def with_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with the path of their label file, null where there is none."""
    right = labels.select(rel_stem(kind="labels").alias("stem"), F.col("path").alias("label_path")).distinct()
    return images.withColumn("stem", rel_stem(kind="images")).join(right, "stem", "left").drop("stem")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, UTF-8 with or without BOM; all texts unless a schema is given."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def read_records(spark: SparkSession, path: str, schema: str, key: str = "works") -> DataFrame:
    """A JSON document that is a list of records, or an object that has the list under ``key``."""
    text = spark.read.text(path, wholetext=True)
    body = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.col("value")).otherwise(F.get_json_object("value", f"$.{key}"))
    return text.select(F.explode(F.from_json(body, f"array<struct<{schema}>>", {"mode": "FAILFAST"})).alias("r")).select("r.*")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """``(class, confidence, bbox, zone_id)`` of a JSON file that is an array of detections; anything else is refused."""
    with open(path, encoding="utf-8-sig") as f:
        rows = json.load(f)
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ValueError(f"{path}: an array of objects is needed")
    number = lambda x: None if x is None else float(x)
    cut = [(r.get("class"), number(r.get("confidence")), [float(v) for v in r["bbox"]] if r.get("bbox") is not None else None, r.get("zone_id")) for r in rows]
    return spark.createDataFrame(cut, "class string, confidence double, bbox array<double>, zone_id string")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids, one a line, without blank lines and ``#`` comments."""
    return spark.read.text(path).select(F.trim("value").alias("pair_id")).where("pair_id <> '' AND NOT startswith(pair_id, '#')")


def read_snapshots(spark: SparkSession, glob: str) -> DataFrame:
    """All CSV snapshots that a pattern names, each row with ``snapshot_id``, the folder it comes from."""
    return read_csv(spark, glob).withColumn("snapshot_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def union_tagged(frames: list[DataFrame], tag: str = "iteration") -> DataFrame:
    """The rows of all, numbered from 1 by table; columns that some lack are null."""
    out = None
    for i, x in enumerate(frames, 1):
        x = x.withColumn(tag, F.lit(i))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def read_json_text(path: str) -> dict:
    with open(path, encoding="utf-8-sig") as f:
        return json.load(f)


def checkpoint_rank(paths: list[str], names: list[str], required: str = "", forbidden: str = "$^") -> str | None:
    """Of model files whose path has ``required`` and not ``forbidden`` the one with the preferred name, then the shortest path."""
    ok = [p for p in paths if re.search(required, p) and not re.search(forbidden, p) and os.path.basename(p) in names]
    return min(ok, key=lambda p: (names.index(os.path.basename(p)), len(p), p), default=None)
