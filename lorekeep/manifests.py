"""What of a folder counts: numbered JSON files, of which the newest does."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .errors import UnavailableError


class Manifest:
    """Files <folder>/<n>.json, each written once. Of two writers that start from the same one the later fails and changes nothing; what no
    manifest names is left over from a write that failed, and is not read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read(self) -> tuple[int, dict]:
        """(number, contents) of the newest; (0, {}) where there is none."""
        fs, folder = self._fs()
        if not fs.exists(folder):
            return 0, {}
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        for n in sorted((int(x.removesuffix(".json")) for x in names if x.endswith(".json")), reverse=True):
            stream = fs.open(self._fs(f"{n}.json")[1])
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            try:
                return n, json.loads(text)
            except ValueError:  # its writer died or is at it
                continue
        return 0, {}

    def write(self, after: int, contents: dict) -> int:
        """The manifest that follows number `after`."""
        fs, folder = self._fs()
        known = [int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")] if fs.exists(folder) else []
        following = after + 1
        while following in known and self._broken(following):
            following += 1
        try:
            out = fs.create(self._fs(f"{following}.json")[1], False)
        except Exception as e:
            if "exist" not in str(e):
                raise
            raise UnavailableError("another writer has changed this folder") from None
        out.write(bytearray(json.dumps(contents).encode()))
        out.close()
        for old in sorted(known)[:-8]:  # readers may still hold the last few
            fs.delete(self._fs(f"{old}.json")[1], False)
        return following

    def _broken(self, n: int) -> bool:
        fs, _ = self._fs()
        stream = fs.open(self._fs(f"{n}.json")[1])
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        try:
            json.loads(text)
        except ValueError:
            return True
        return False
