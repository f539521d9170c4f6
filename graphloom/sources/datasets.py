"""Dataset registry: named splits, made on first use, with hooks that preprocess them. There is no network here: files come from a local folder."""

from __future__ import annotations

import gzip
import os
import re
import shutil
import tarfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.transforms import math_triplets


def extract(archive: str, folder: str, member: str | None = None) -> str:
    """Unpack gz, tar, tar.gz/tgz or zip into folder, or one member only; returns the path of what was unpacked. Other files are returned as they are."""
    os.makedirs(folder, exist_ok=True)
    if archive.endswith((".tar", ".tar.gz", ".tgz", ".zip")):
        opened = zipfile.ZipFile(archive) if archive.endswith(".zip") else tarfile.open(archive)
        with opened as a:
            if isinstance(a, zipfile.ZipFile):
                a.extract(member, folder) if member else a.extractall(folder)
            elif member:
                a.extract(member, folder, filter="data")
            else:
                a.extractall(folder, filter="data")
        return os.path.join(folder, member) if member else folder
    if archive.endswith(".gz"):
        out = os.path.join(folder, os.path.basename(archive)[:-3])
        with gzip.open(archive) as src, open(out, "wb") as dst:
            shutil.copyfileobj(src, dst)
        return out
    return archive


class Dataset:
    """Splits by name. A split is a file in `folder`, an archive there, or what its hook makes; dataset["train"] or dataset.train gives its path or table."""

    def __init__(self, name: str, sources: dict[str, str | tuple[str, str]] | None = None, hooks: dict[str, Callable] | None = None, folder: str | None = None):
        self.name, self.sources, self.hooks = name, sources or {}, hooks or {}
        self.folder = folder or os.path.join(os.path.expanduser("~/.graphloom/dataset"), name)
        self._made: dict[str, object] = {}

    def __getitem__(self, split: str):
        if split not in self._made:
            if split not in self.sources and split not in self.hooks:
                raise KeyError(f"dataset `{self.name}` has no split `{split}`")
            raw = self._file(split) if split in self.sources else None
            self._made[split] = self.hooks[split](raw) if split in self.hooks else raw
        return self._made[split]

    def __getattr__(self, split: str):
        if split.startswith("_"):
            raise AttributeError(split)
        try:
            return self[split]
        except KeyError as e:
            raise AttributeError(str(e)) from None

    def _file(self, split: str) -> str:
        source = self.sources[split]
        file, member = source if isinstance(source, tuple) else (source, None)
        path = os.path.join(self.folder, file)
        if not os.path.exists(path):
            raise FileNotFoundError(f"{path} isn't there; nothing is downloaded: put the file of {self.name}.{split} in its place")
        return extract(path, self.folder, member)


#: Splits of well-known public sets: file names wanted in the dataset's folder.
KNOWN: dict[str, dict[str, str | tuple[str, str]]] = {
    "blogcatalog": {"graph": "blogcatalog_graph.txt", "label": "blogcatalog_label.txt", "train": "blogcatalog_train.txt", "test": "blogcatalog_test.txt"},
    "youtube": {"graph": "youtube_graph.txt", "label": "youtube_label.txt"},
    "flickr": {"graph": "flickr_graph.txt", "label": "flickr_label.txt"},
    "hyperlink2012": {"pld_train": "pld_train.txt", "pld_test": "pld_test.txt"},
    "friendster": {"graph": "friendster_graph.txt", "small_graph": "friendster_small_graph.txt", "label": "friendster_label.txt"},
    "wikipedia": {"graph": "wikipedia_graph.txt"},
    "fb15k": {s: f"fb15k_{s}.txt" for s in ("train", "valid", "test")},
    "fb15k237": {s: f"fb15k237_{s}.txt" for s in ("train", "valid", "test")},
    "wn18": {s: f"wn18_{s}.txt" for s in ("train", "valid", "test")},
    "wn18rr": {s: f"wn18rr_{s}.txt" for s in ("train", "valid", "test")},
    "wikidata5m": {s: f"wikidata5m_{s}.txt" for s in ("train", "valid", "test", "entity", "relation", "text")},
    "freebase": {"train": "freebase_train.txt"},
    "mnist": {s: f"mnist_{s}" for s in ("train_image_data", "train_label_data", "test_image_data", "test_label_data")},
    "cifar10": {"train_image_data": "cifar10_train", "test_image_data": "cifar10_test"},
    "imagenet": {"train_image": "imagenet_train", "train_feature_data": "imagenet_train_feature.npy", "train_label": "imagenet_train_label.txt", "train_hierarchical_label": "imagenet_train_hierarchical_label.txt"},
}


class Registry:
    """All datasets a session knows; `math` is synthetic and needs no files."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.sets = spark, folder, {}
        for name, sources in KNOWN.items():
            self.add(Dataset(name, sources, folder=os.path.join(folder, name) if folder else None))
        made = {"train": (20000, 1023), "valid": (1000, 1024), "test": (1000, 1025)}
        self.add(Dataset("math", hooks={s: lambda _, n=n, seed=seed: self._math(n, seed) for s, (n, seed) in made.items()}))

    def _math(self, n: int, seed: int) -> DataFrame:
        return math_triplets(self.spark, n, seed).withColumnRenamed("id", "line")

    def add(self, dataset: Dataset) -> None:
        self.sets[dataset.name] = dataset

    def __getitem__(self, name: str) -> Dataset:
        if name not in self.sets:
            raise KeyError(f"unknown dataset `{name}`")
        return self.sets[name]

    def resolve(self, value):
        """`<dataset.split>` as a whole string becomes that split; anything else stays."""
        if isinstance(value, str) and (m := re.fullmatch(r"<([\w-]+)\.([\w-]+)>", value.strip())):
            return self[m[1]][m[2]]
        return value
