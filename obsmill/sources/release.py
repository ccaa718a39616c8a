"""Prepared releases: one partitioned write, a tree of fingerprints, verification, publishing.

A release lives in its own folder and is entered in the publish log only after
it was written whole and verified.  Readers follow the log, so they never see a
half-written release and a failed build leaves the old one in place.

Fingerprints add up, so those of a file's items (the leaves) give those of an
item, and these those of a domain.  A release that follows another one writes
only the files that hold changed items, and lists the others, which stay where
they are, so the folders of the releases it builds on must be kept.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from obsmill.functions.fingerprint import HALF, HALVES, fingerprint, summed, with_halves
from obsmill.operators.bitmaps import item_bits, numbered, with_range, year_bits
from obsmill.operators.partials import crop_states, price_states
from obsmill.operators.selection import availability, dimensions, is_primary, primary_items
from obsmill.schema import (
    ANNUAL,
    CROP_ELEMENTS,
    DOMAINS,
    M49_COLUMN,
    MONTHS_COLUMN,
    PRICE_ELEMENT,
    SCHEMA_VERSION,
    TRADE_ELEMENTS,
    empty_like,
    require_columns,
)
from obsmill.session import sound_unions, union_all
from obsmill.sources.catalog import stale_domains
from obsmill.sources.log import PublishLog
from obsmill.sources.workspace import remove_folder

#: What an option stands for: its years are the words of its bitmap.
OPTION = ("Domain", "Item", "Area", "Element")
LOG_SCHEMA = "sequence long, release string, schema_version int, published_at double"


def domain_condition() -> Column:
    """What a release keeps of each domain."""
    domain, element = F.col("Domain"), F.col("Element")
    return (
        ((domain == "QCL") & element.isin(*CROP_ELEMENTS))
        | ((domain == "PP") & (element == PRICE_ELEMENT) & (F.col(MONTHS_COLUMN) == ANNUAL))
        | ((domain == "TCL") & element.isin(*TRADE_ELEMENTS))
    )


def release_rows(observations: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """The observations of the given or else the primary items that belong in a release."""
    if items is None:
        items = primary_items(observations.where(F.col("Domain") == "QCL"))
    return observations.where(domain_condition()).join(items, "Item", "left_semi").select(
        *observations.columns
    )


def _row_hash(columns: Sequence[str]) -> Column:
    # xxhash64 skips nulls, so the null flags are hashed as well.
    quoted = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*quoted, *[c.isNull() for c in quoted])


def _manifest_of(parts: DataFrame) -> DataFrame:
    """Rows and fingerprint per (Domain, Item), from parts that have counts and halves."""
    grouped = parts.groupBy("Domain", "Item").agg(F.sum("n_rows").alias("n_rows"), *summed())
    return grouped.select("Domain", "Item", "n_rows", fingerprint().alias("fingerprint"))


def manifest(rows: DataFrame) -> DataFrame:
    """Rows and content fingerprint per (Domain, Item).

    The fingerprint holds sums of row hashes: it does not depend on order or
    files, and unlike an exclusive or it notices duplicated rows.  Other
    engines can work it out from the rows' text.
    """
    sound_unions(rows.sparkSession)
    grouped = with_halves(rows).groupBy("Domain", "Item").agg(F.count("*").alias("n_rows"), *summed(*HALVES))
    return grouped.select("Domain", "Item", "n_rows", fingerprint().alias("fingerprint"))


def source_cells(observations: DataFrame) -> DataFrame:
    """What one read of a source tells: per domain, area and item the rows a release keeps, their fingerprint, and whether
    the item is primary there."""
    kept, halved = domain_condition(), with_halves(observations)
    halves = summed(*(F.when(kept, F.col(h)) for h in HALVES))
    primary = F.bool_or((F.col("Domain") == "QCL") & is_primary())
    return halved.groupBy("Domain", "Area", M49_COLUMN, "Item").agg(
        primary.alias("primary"), F.count(F.when(kept, 1)).alias("n_rows"), *halves
    )


PLACE = r"^.*/releases/([^/]+)/observations/(.+)$"


def leaves(rows: DataFrame) -> DataFrame:
    """Rows and halves per domain, item and file of a release's observations; `owner` is the release whose folder has the file."""
    path = F.col("_metadata.file_path")
    place = {"_owner": F.regexp_extract(path, PLACE, 1), "_name": F.regexp_extract(path, PLACE, 2)}
    # Where a row lies is no part of its text.
    placed = with_halves(rows).withColumns(place)
    grouped = placed.groupBy("Domain", "Item", F.col("_owner").alias("owner"), F.col("_name").alias("name"))
    return grouped.agg(F.count("*").alias("n_rows"), *summed(*HALVES))


def manifest_mismatches(stored: DataFrame, actual: DataFrame) -> DataFrame:
    """Entries that are missing, extra, or differ in rows or content."""
    s, a = stored.alias("s"), actual.alias("a")
    same = F.col("s.Domain").eqNullSafe(F.col("a.Domain")) & F.col("s.Item").eqNullSafe(
        F.col("a.Item")
    )
    problem = (
        F.when(F.col("a.n_rows").isNull(), "missing")
        .when(F.col("s.n_rows").isNull(), "extra")
        .when(F.col("s.n_rows") != F.col("a.n_rows"), "rows")
        .when(F.col("s.fingerprint") != F.col("a.fingerprint"), "content")
    )
    return (
        s.join(a, same, "full_outer")
        .select(
            F.coalesce("s.Domain", "a.Domain").alias("Domain"),
            F.coalesce("s.Item", "a.Item").alias("Item"),
            F.col("s.n_rows").alias("stored_rows"),
            F.col("a.n_rows").alias("actual_rows"),
            problem.alias("problem"),
        )
        .where(F.col("problem").isNotNull())
    )


def row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that occur more often on one side, and by how much.

    One aggregation over the union instead of two multiset differences;
    positive `surplus` counts copies only `left` has, negative only `right`.
    """
    columns = [f"`{c}`" for c in left.columns]
    tagged = union_all(left.withColumn("_n", F.lit(1)), right.withColumn("_n", F.lit(-1)))
    return (
        tagged.groupBy(*columns).agg(F.sum("_n").alias("surplus")).where(F.col("surplus") != 0)
    )


def parity(left: DataFrame, right: DataFrame, by: str = "Domain") -> DataFrame:
    """Per domain: rows of each side and rows only one side has."""
    columns = [f"`{c}`" for c in left.columns]
    tagged = union_all(
        left.withColumns({"_l": F.lit(1), "_r": F.lit(0)}),
        right.withColumns({"_l": F.lit(0), "_r": F.lit(1)}),
    )
    per_row = tagged.groupBy(*columns).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    surplus = F.col("l") - F.col("r")
    return per_row.groupBy(by).agg(
        F.sum("l").alias("left_rows"),
        F.sum("r").alias("right_rows"),
        F.sum(F.greatest(surplus, F.lit(0))).alias("only_left"),
        F.sum(F.greatest(-surplus, F.lit(0))).alias("only_right"),
    )


#: What a reader of one item or area may skip: row groups by Bloom filters, pages by their index.
WRITTEN_WITH = {
    "compression": "zstd",
    "parquet.bloom.filter.enabled#Item": "true",
    "parquet.bloom.filter.enabled#Area": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.max.bytes": str(128 << 10),
    "parquet.page.row.count.limit": "20000",
}
Totals = dict[str, tuple]


def write_rows(rows: DataFrame, path: str, **options: str) -> Totals:
    """One job for all domains and crops, clustered so that files prune by Item; counts and fingerprints of what was written, by domain.

    The range key goes down to the whole row, so a crop with a third of all
    rows is spread over many tasks instead of landing in one.  The figures are
    gathered by the writing tasks themselves.
    """
    order = ["Domain", "Item", "Area", "Year", "Element"]
    ordered = rows.repartitionByRange(*order, _row_hash(rows.columns)).sortWithinPartitions(*order)
    seen = Observation("written")
    figures = []
    for code in DOMAINS:
        own = F.col("Domain") == code
        figures += [F.count(F.when(own, 1)).alias(f"{code}_rows")]
        figures += [F.sum(F.when(own, F.col(h))).cast(HALF).alias(f"{code}{h}") for h in HALVES]
    observed = with_halves(ordered).observe(seen, *figures).drop(*HALVES)
    observed.write.options(**WRITTEN_WITH | options).partitionBy("Domain").parquet(path)
    found = seen.get
    return {c: tuple(found[f"{c}{x}"] for x in ("_rows", *HALVES)) for c in DOMAINS if found[f"{c}_rows"]}


def totals(parts: DataFrame) -> Totals:
    """The same figures from parts that have counts and halves: a row for each domain."""
    rows = parts.where("n_rows > 0").groupBy("Domain").agg(F.sum("n_rows").alias("n_rows"), *summed()).collect()
    return {r.Domain: (r.n_rows, r.first, r.second) for r in rows}


class ReleaseStore:
    """Releases below one root folder that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str):
        sound_unions(spark)
        self.spark = spark
        self.root = root.rstrip("/")
        self._log = PublishLog(spark, f"{self.root}/published", LOG_SCHEMA)

    def path(self, release: str, table: str) -> str:
        return f"{self.root}/releases/{release}/{table}"

    def current(self) -> str | None:
        """The published release, or None; an unknown layout version is an error."""
        entry = self._log.newest()
        if entry is None:
            return None
        if entry.schema_version != SCHEMA_VERSION:
            raise ValueError(f"release layout {entry.schema_version} is not supported")
        return entry.release

    def stage(self, observations: DataFrame, metadata: DataFrame) -> str:
        """Writes a release that is not visible to readers yet and checks it against its source.

        The source is read twice: once for what a release keeps of it, with
        fingerprints, and once for the rows.  The writing job tells what it
        was given, and a read of the files what they hold.  What a failed build
        has written is removed.
        """
        return self._staged(lambda release: self._build(release, observations, metadata))

    def _staged(self, build: Callable[[str], None]) -> str:
        release = self._next_name()
        try:
            build(release)
        except Exception:
            remove_folder(self.spark, f"{self.root}/releases/{release}")
            raise
        return release

    def _next_name(self) -> str:
        """Named by its place in the log; a second builder of the same place gets a name of its own."""
        newest = self._log.newest()
        place = 0 if newest is None else newest.sequence + 1
        return f"r{place:06d}-{time.time_ns():x}"

    def _described(self, release: str, observations: DataFrame) -> DataFrame:
        """Stores what one read of the source tells; gives its parts that belong in a release."""
        self._write(release, "cells", source_cells(require_columns(observations)))
        cells = self._table(release, "cells")
        self._write(release, "areas", cells.where("Domain = 'QCL'").select("Area", M49_COLUMN).distinct())
        self._write(release, "items", cells.where("primary").select("Item").distinct())
        items = self._table(release, "items")
        if items.isEmpty():
            raise ValueError("a release without rows is not published")
        kept = cells.where("n_rows > 0").join(items, "Item", "left_semi")
        self._write(release, "manifest", _manifest_of(kept))
        return kept

    def _build(self, release: str, observations: DataFrame, metadata: DataFrame) -> None:
        kept = self._described(release, observations)
        items = self._table(release, "items")
        written = write_rows(release_rows(observations, items), self.path(release, "observations"))
        if written != totals(kept):
            raise ValueError(f"{release} was not given the rows of its source")
        rows = self._table(release, "observations")
        self._write(release, "leaves", leaves(rows), "Domain")
        crops = rows.where("Domain = 'QCL'")
        self._write(release, "availability", availability(crops, items))
        self._write(release, "year_bits", year_bits(rows, OPTION))
        self._write(release, "crop_states", crop_states(crops))
        self._write(release, "price_states", price_states(rows.where("Domain = 'PP'")))
        self._finish(release, metadata)

    def _finish(self, release: str, metadata: DataFrame) -> None:
        """What follows from the tables that each item has its own rows in; and the check of the files."""
        ranges = with_range(self._table(release, "year_bits"), "min_year", "max_year")
        self._write(release, "dimensions", dimensions(ranges, ["Domain"], "min_year", "max_year"))
        self._write(release, "item_numbers", numbered(self._table(release, "items")))
        self._write(release, "item_bits", item_bits(self._table(release, "availability"), self._table(release, "item_numbers")))
        self._write(release, "domains", metadata)
        parts = self._table(release, "leaves")
        self._write(release, "files", parts.select("owner", "name").distinct())
        self._write(release, "totals", parts.groupBy("Domain").agg(F.sum("n_rows").alias("n_rows"), *summed()))
        if not manifest_mismatches(self._table(release, "manifest"), _manifest_of(parts)).isEmpty():
            raise ValueError(f"{release} does not hold the rows of its source")

    def _rebuild(self, release: str, held: str, observations: DataFrame, metadata: DataFrame) -> None:
        kept = self._described(release, observations)
        items = self._table(release, "items")
        problems = manifest_mismatches(self._table(held, "manifest"), self._table(release, "manifest"))
        self._write(release, "changed", problems)
        changed = self._table(release, "changed").select("Domain", "Item")
        before = self._table(held, "leaves")
        touched = before.join(changed, ["Domain", "Item"], "left_semi").select("owner", "name").distinct()
        # Other items of a file that goes are written again, from that file.
        stale = [(r.owner, r.name) for r in touched.collect()]  # some of the files that a release lists on opening
        columns = observations.columns
        fresh = release_rows(observations, items).join(changed, ["Domain", "Item"], "left_semi").select(*columns)
        moved = self._files(stale).join(changed, ["Domain", "Item"], "left_anti").select(*columns) if stale else None
        source = fresh if moved is None else union_all(fresh, moved)
        stays = before.join(touched, ["owner", "name"], "left_anti")
        if not source.isEmpty():
            written = write_rows(source, self.path(release, "observations"))
            if any(totals(kept)[c][0] - totals(stays).get(c, (0,))[0] != n for c, (n, *_) in written.items()):
                raise ValueError(f"{release} was not given the rows of its source")
            stays = union_all(stays, leaves(self._table(release, "observations")).select(*stays.columns))
        self._write(release, "leaves", stays, "Domain")
        self._write(release, "files", self._table(release, "leaves").select("owner", "name").distinct())

        rows = self._observations(release).join(changed, ["Domain", "Item"], "left_semi")
        crops = rows.where("Domain = 'QCL'")
        for table, own, domain in (
            ("availability", availability(crops, items), "QCL"),
            ("crop_states", crop_states(crops), "QCL"),
            ("price_states", price_states(rows.where("Domain = 'PP'")), "PP"),
        ):
            gone = changed.where(F.col("Domain") == domain).select("Item")
            carried = self._table(held, table).join(gone, "Item", "left_anti").select(*own.columns)
            self._write(release, table, union_all(carried, own))
        own = year_bits(rows, OPTION)
        carried = self._table(held, "year_bits").join(changed, ["Domain", "Item"], "left_anti").select(*own.columns)
        self._write(release, "year_bits", union_all(carried, own))
        remove_folder(self.spark, self.path(release, "files"))
        self._finish(release, metadata)

    def _file_names(self, release: str) -> set[tuple[str, str]]:
        """The files in a release's own folder, by owner and name; read from the listing alone."""
        try:
            listed = self._table(release, "observations").inputFiles()
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return set()
        return {(release, f.rpartition("/observations/")[2]) for f in listed}

    def _files(self, wanted: Iterable[tuple[str, str]]) -> DataFrame:
        """The rows of some files, each below the folder of its owner."""
        by_owner: dict[str, list[str]] = {}
        for owner, name in sorted(wanted):
            by_owner.setdefault(owner, []).append(f"{self.path(owner, 'observations')}/{name}")
        frames = [
            self.spark.read.option("basePath", self.path(owner, "observations")).parquet(*names) for owner, names in by_owner.items()
        ]
        return union_all(*frames, allow_missing=True)

    def _observations(self, release: str) -> DataFrame:
        """All observations of a release; where it has only files of its own, its folder is read as a whole."""
        listed = {(r.owner, r.name) for r in self._table(release, "files").collect()}
        if {owner for owner, _ in listed} <= {release}:
            return self._table(release, "observations")
        return self._files(listed)

    def publish(self, observations: DataFrame, metadata: DataFrame) -> str:
        return self._entered(self.stage(observations, metadata))

    def _entered(self, release: str) -> str:
        self._log.append(
            release=release, schema_version=SCHEMA_VERSION, published_at=time.time()
        )
        return release

    def update(self, observations: DataFrame, metadata: DataFrame, most_owners: int = 8) -> str:
        """A release like that of `publish`, which writes only the files that hold an item whose rows changed.

        What changed is told by fingerprints of source and current release, per
        domain and item.  Without a current release, with other columns, or
        once files lie in the folders of `most_owners` releases, all is written
        anew.
        """
        held = self.current()
        owners = set() if held is None else {r.owner for r in self._table(held, "files").select("owner").distinct().collect()}
        if held is None or len(owners) >= most_owners or set(self.open(held).columns) != set(observations.columns):
            return self.publish(observations, metadata)
        return self._entered(self._staged(lambda release: self._rebuild(release, held, observations, metadata)))

    def ensure(
        self, build: Callable[[], tuple[DataFrame, DataFrame]], catalog: DataFrame | None = None
    ) -> str:
        """The current release if it is whole and, given a catalog, up to date; else a new one.

        When building fails an intact older release stays in use, with a warning.
        """
        held = self.current()
        if held is not None:
            try:
                self.open(held)
                if catalog is None or not self._stale(held, catalog):
                    return held
            except Exception as problem:
                warnings.warn(f"{held} is damaged and will be rebuilt: {problem}")
                held = None
        try:
            return self.publish(*build())
        except Exception as problem:
            if held is None:
                raise ValueError(f"no release can be built: {problem}") from problem
            warnings.warn(f"update failed, {held} stays in use: {problem}")
            return held

    def _stale(self, release: str, catalog: DataFrame) -> bool:
        return not stale_domains(catalog, self._table(release, "domains")).where("stale").isEmpty()

    def _write(self, release: str, table: str, frame: DataFrame, *by: str) -> None:
        frame.write.option("compression", "zstd").partitionBy(*by).parquet(self.path(release, table))

    def _table(self, release: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(release, table))

    def published(self) -> str:
        release = self.current()
        if release is None:
            raise ValueError(f"nothing is published in {self.root}")
        return release

    def table(self, table: str, release: str | None = None) -> DataFrame:
        """A table of the given or else the current release."""
        release = release or self.published()
        return self._observations(release) if table == "observations" else self._table(release, table)

    def open(self, release: str | None = None, domain: str | None = None) -> DataFrame:
        """The observations of a release or of one domain, checked for their columns and files."""
        if domain is not None and domain not in DOMAINS:
            raise ValueError(f"unknown domain {domain}")
        release = release or self.published()
        listed = {(r.owner, r.name) for r in self._table(release, "files").collect()}
        lost = listed - set().union(*(self._file_names(owner) for owner in {owner for owner, _ in listed}))
        if lost:
            raise ValueError(f"{release} lacks {len(lost)} of its files, such as {min(lost)[1]}")
        rows = require_columns(self.table("observations", release))
        return rows if domain is None else rows.where(F.col("Domain") == domain)

    def mismatches(self, release: str) -> DataFrame:
        return manifest_mismatches(
            self._table(release, "manifest"), manifest(self._observations(release))
        )

    def differing_items(self, left: str, right: str) -> DataFrame:
        """Domains and items whose rows differ between two releases, as `manifest_mismatches` tells them.

        Domains are compared first, a row for each; items only of those that differ.
        """
        ours, theirs = (totals(self._table(r, "totals")) for r in (left, right))
        codes = sorted(c for c in ours.keys() | theirs.keys() if ours.get(c) != theirs.get(c))
        kept = [self._table(r, "manifest").where(F.col("Domain").isin(codes)) for r in (left, right)]
        return manifest_mismatches(*kept)

    def differing_files(self, left: str, right: str) -> DataFrame:
        """(release, Domain, Item, owner, name, n_rows): parts of files that have no equal part in the other release.

        Only leaves of domains and items that differ are read.
        """
        items = self.differing_items(left, right).select("Domain", "Item")
        codes = [r.Domain for r in items.select("Domain").distinct().collect()]
        content = ["Domain", "Item", "n_rows", "first", "second"]
        ours, theirs = (
            self._table(r, "leaves").where(F.col("Domain").isin(codes)).join(items, ["Domain", "Item"], "left_semi") for r in (left, right)
        )
        alone = [
            a.join(b.select(*content), content, "left_anti").withColumn("release", F.lit(r)) for a, b, r in ((ours, theirs, left), (theirs, ours, right))
        ]
        return union_all(*alone).select("release", "Domain", "Item", "owner", "name", "n_rows")


def opened(
    spark: SparkSession, openers: Mapping[str, Callable[[], DataFrame]], like: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The frames that open, and a table of problems (domain, message) for the others.

    A frame that cannot be opened, or lacks a required column, is given as an
    empty one with the columns of `like`, so its failure stays its own.
    """
    frames, problems = {}, []
    for code, opener in openers.items():
        try:
            frames[code] = require_columns(opener())
        except Exception as problem:
            problems.append((code, str(problem)))
    empty = dict.fromkeys((code for code, _ in problems), empty_like(like))
    return frames | empty, spark.createDataFrame(problems, "domain string, message string")
