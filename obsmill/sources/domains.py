"""The typed whole table of each domain, one version per published bulk file."""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from obsmill.schema import DOMAINS, require_columns
from obsmill.session import sound_unions
from obsmill.sources.bulk import domain_union, load_bulk
from obsmill.sources.log import PublishLog
from obsmill.sources.workspace import remove_folder

LOG_SCHEMA = (
    "code string, sequence long, version string, name string, updated string, url string, "
    "source string, rows long, published_at double"
)
METADATA = ("code", "name", "updated", "url", "source")


class DomainStore:
    """Bulk files typed into Parquet below one root that all executors can reach.

    A version is entered in the log only when it is written whole, typed
    strictly and not empty, so a failed update leaves the old version in use.
    """

    def __init__(self, spark: SparkSession, root: str):
        sound_unions(spark)
        self.spark = spark
        self.root = root.rstrip("/")
        self._log = PublishLog(spark, f"{self.root}/published", LOG_SCHEMA)

    def _path(self, code: str, version: str) -> str:
        return f"{self.root}/{code}/{version}"

    def _known(self, code: str) -> str:
        if code not in DOMAINS:
            raise ValueError(f"unknown domain {code}")
        return code

    def record(self, code: str):
        """The newest log entry of a domain, or None."""
        return self._log.newest(F.col("code") == self._known(code))

    def open(self, code: str) -> DataFrame:
        record = self.record(code)
        if record is None:
            raise ValueError(f"domain {code} was never loaded")
        return require_columns(self.spark.read.parquet(self._path(code, record.version)))

    def load(self, metadata: Mapping[str, str], folder: str, multi_line: bool = False) -> str:
        """Types the bulk CSV in `folder` and publishes it as a new version; a failed one leaves no files."""
        code = self._known(metadata["code"])
        version = uuid.uuid4().hex
        path = self._path(code, version)
        try:
            seen = Observation("loaded")
            typed_rows = load_bulk(self.spark, folder, multi_line).observe(seen, F.count("*").alias("rows"))
            typed_rows.write.option("compression", "zstd").parquet(path)
            rows = seen.get["rows"]  # counted by the writing tasks
            if rows == 0:
                raise ValueError(f"the bulk file of {code} is empty")
        except Exception:
            remove_folder(self.spark, path)
            raise
        self._log.append(
            F.col("code") == code,
            **{name: metadata.get(name) for name in METADATA},
            version=version,
            rows=rows,
            published_at=time.time(),
        )
        return version

    def _readable(self, code: str) -> Row | None:
        """The newest entry whose files can be read with the required columns."""
        entry = self.record(code)
        if entry is None:
            return None
        try:
            self.open(code)
        except Exception as cause:
            warnings.warn(f"files of {code} cannot be read, {cause}; loading them anew")
            return None
        return entry

    def ensure(self, metadata: Mapping[str, str], folder: str, multi_line: bool = False) -> str:
        """A version that is readable and of the catalog's date, loaded if none is held.

        If that load fails, a readable version of another date is given, with a
        warning.
        """
        code = self._known(metadata["code"])
        fallback = self._readable(code)
        if fallback is not None and fallback.updated == metadata["updated"]:
            return fallback.version
        try:
            return self.load(metadata, folder, multi_line)
        except Exception as cause:
            if fallback is None:
                raise ValueError(f"{code} cannot be loaded: {cause}") from cause
            warnings.warn(f"{code} stays at {fallback.updated}, as loading failed: {cause}")
            return fallback.version

    def metadata(self) -> DataFrame:
        """One row per loaded domain: what the catalog said and the rows of the whole table."""
        newest = F.max_by(F.struct(*METADATA, "rows"), F.struct("sequence", "published_at"))
        return self._log.read().groupBy("code").agg(newest.alias("_m")).select("_m.*")

    def observations(self) -> DataFrame:
        """All loaded domains in one frame, ready for a release."""
        loaded = [code for code in DOMAINS if self.record(code) is not None]
        if not loaded:
            raise ValueError(f"nothing is loaded in {self.root}")
        return domain_union({code: self.open(code) for code in loaded})
