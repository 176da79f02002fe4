"""A model store: versioned parameter files, committed by one rename, each with its own digest.

A file holds the SHA-256 (64 hex digits) of what follows it, and then the
parameters and facts as an npz archive. It is written under a temporary name
and renamed to its version's; a version is never overwritten, and a write that
breaks off leaves the versions before as they are.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSION = re.compile(r"v(\d{6})\.npz$")


def packed(parameters: dict[str, np.ndarray], facts: dict | None = None) -> bytes:
    out = io.BytesIO()
    np.savez(out, **parameters, _facts=np.frombuffer(json.dumps(facts or {}, sort_keys=True).encode(), np.uint8))
    body = out.getvalue()
    return hashlib.sha256(body).hexdigest().encode() + body


def unpacked(content: bytes) -> tuple[dict[str, np.ndarray], dict]:
    """Parameters and facts; a file that does not fit its digest is an error."""
    digest, body = content[:64], content[64:]
    if hashlib.sha256(body).hexdigest().encode() != digest:
        raise ValueError("the file does not fit its digest")
    with np.load(io.BytesIO(body), allow_pickle=False) as found:
        parameters = {k: found[k] for k in found.files if k != "_facts"}
        return parameters, json.loads(found["_facts"].tobytes().decode())


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return []
        found = (_VERSION.fullmatch(s.getPath().getName()) for s in self._fs.listStatus(folder))
        return sorted(int(m[1]) for m in found if m)

    def save(self, name: str, parameters: dict[str, np.ndarray], facts: dict | None = None) -> int:
        """The new version's number: the next that no one has taken."""
        held = self._path(f"{self.root}/{name}/.{uuid.uuid4().hex}")
        out = self._fs.create(held, False)
        out.write(packed(parameters, facts))
        out.close()
        number = (self.versions(name) or [0])[-1] + 1
        while True:
            to = self._path(f"{self.root}/{name}/v{number:06d}.npz")
            if not self._fs.exists(to) and self._fs.rename(held, to):
                return number
            number += 1

    def load(self, name: str, version: int | None = None) -> tuple[dict[str, np.ndarray], dict]:
        """Parameters and facts of a version, the latest unless given; checked against the digest."""
        version = version or (self.versions(name) or [0])[-1]
        rows = self.spark.read.format("binaryFile").load(f"{self.root}/{name}/v{version:06d}.npz").select("content").collect()
        return unpacked(bytes(rows[0]["content"]))

    def registry(self) -> DataFrame:
        """(``name``, ``version``, ``bytes``, ``sha256``, ``intact``) of every committed file."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "v*.npz").option("recursiveFileLookup", "true").load(self.root)
        body, stated = F.expr("substring(content, 65)"), F.expr("cast(substring(content, 1, 64) AS string)")
        name, version = F.regexp_extract("path", r"([^/]+)/v\d{6}\.npz$", 1), F.regexp_extract("path", r"v(\d{6})\.npz$", 1).cast("int")
        return files.select(name.alias("name"), version.alias("version"), F.col("length").alias("bytes"), stated.alias("sha256"), (F.sha2(body, 256) == stated).alias("intact"))
