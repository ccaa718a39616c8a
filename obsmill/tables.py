"""What an application asks for: options, selections and domain frames by code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsmill.operators import bitmaps, partials, selection
from obsmill.operators.selection import Selection
from obsmill.plans import reports
from obsmill.schema import (
    CROP_ELEMENTS,
    DOMAINS,
    M49_COLUMN,
    PRICE_ELEMENT,
    PRODUCTION,
    TRADE_ELEMENTS,
    require_columns,
)
from obsmill.sources.catalog import stale_domains
from obsmill.sources.domains import DomainStore
from obsmill.sources.release import ReleaseStore, opened

ELEMENTS = {"QCL": CROP_ELEMENTS, "PP": (PRICE_ELEMENT,), "TCL": TRADE_ELEMENTS}
Names = Sequence[str] | None
Years = tuple[int, int] | None


class BulkTables:
    """Answers from the whole tables of the domains."""

    def __init__(self, store: DomainStore):
        self.store = store

    def rows(self, code: str) -> DataFrame:
        return self.store.open(code)

    def metadata(self) -> DataFrame:
        """One row per domain; `rows` counts the whole domain, not a selection."""
        return self.store.metadata()

    def query(
        self, code: str, areas: Names = None, items: Names = None, elements: Names = None, years: Years = None
    ) -> DataFrame:
        """All columns of the selected observations.

        Unordered: sort by `selection.canonical_order()` where rows are presented.
        """
        chosen = Selection(areas, items, elements, years)
        return selection.select_observations(self.rows(code), code, chosen)

    def area_table(self, code: str = "QCL") -> DataFrame:
        return self.rows(code).select("Area", M49_COLUMN).distinct()

    def available_items(self, code: str = "QCL", areas: Names = None) -> DataFrame:
        chosen = selection.apply_selection(self.rows(code), Selection(areas))
        if code == "QCL":
            return selection.primary_items(chosen)
        return selection.items_with_rows(chosen)

    def available_years(
        self, code: str = "QCL", areas: Names = None, items: Names = None, elements: Names = None
    ) -> DataFrame:
        return selection.years_on_record(self.rows(code), Selection(areas, items, elements))

    def dimensions(self, code: str = "QCL") -> DataFrame:
        return selection.dimensions(self.rows(code))

    def stale(self, catalog: DataFrame) -> DataFrame:
        return stale_domains(catalog, self.metadata())

    def frames(self, areas: Names, items: Names, years: Years) -> tuple[dict[str, DataFrame], DataFrame]:
        """The three domains under one selection, and the problems of PP and TCL, which may fail."""
        chosen = {code: partial(self.query, code, areas, items, ELEMENTS[code], years) for code in DOMAINS}
        base = chosen.pop("QCL")()
        frames, problems = opened(base.sparkSession, chosen, like=base)
        return {"QCL": base} | frames, problems


class PreparedTables(BulkTables):
    """Answers from a prepared release: options come from its index, not from the facts.

    All answers come from the one release that is current when this is made.
    """

    def __init__(self, store: ReleaseStore):
        self.store = store
        self.release = store.published()
        self._opened: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        # A release never changes, so its files are listed and its schema read once.
        if name not in self._opened:
            self._opened[name] = self.store.table(name, self.release)
        return self._opened[name]

    def rows(self, code: str) -> DataFrame:
        if code not in DOMAINS:
            raise ValueError(f"unknown domain {code}")
        return require_columns(self._table("observations")).where(F.col("Domain") == code)

    def metadata(self) -> DataFrame:
        return self._table("domains")

    def area_table(self, code: str = "QCL") -> DataFrame:
        return self._table("areas")

    def dimensions(self, code: str = "QCL") -> DataFrame:
        return self._table("dimensions").where(F.col("Domain") == code).drop("Domain")

    def available_items(self, code: str = "QCL", areas: Names = None) -> DataFrame:
        if code == "QCL":
            chosen = selection.apply_selection(self._table("item_bits"), Selection(areas))
            return bitmaps.items_of(bitmaps.merged_bits(chosen), self._table("item_numbers"))
        # The manifest lists the items each domain has rows of.
        return self._table("manifest").where(F.col("Domain") == code).select("Item")

    def _years(self, code: str) -> DataFrame:
        if code not in DOMAINS:
            raise ValueError(f"unknown domain {code}")
        return self._table("year_bits").where(F.col("Domain") == code)

    def available_years(
        self, code: str = "QCL", areas: Names = None, items: Names = None, elements: Names = None
    ) -> DataFrame:
        return bitmaps.years_offered(self._years(code), Selection(areas, items, elements))

    def items_in_period(self, code: str, years: Years, areas: Names = None, elements: Names = None) -> DataFrame:
        """Items that have a row within the years, so that a choice of years narrows that of items."""
        return bitmaps.items_offered(self._years(code), Selection(areas, None, elements, years))

    def member_years(self, code: str = "QCL") -> DataFrame:
        """The members of each dimension, their range of years and how many different ones they have."""
        return bitmaps.member_years(self._years(code))

    def states(self) -> DataFrame:
        """Mergeable crop figures per area, item and year, see `operators.partials`."""
        return self._table("crop_states")

    def figures(self, element: str, groups: Sequence[str], areas: Names = None, items: Names = None, years: Years = None) -> DataFrame:
        """An element of a selection by groups, from the stored states."""
        chosen = selection.apply_selection(self.states(), Selection(areas, items, None, years))
        return partials.merged(chosen, element, groups)

    def key_figures(
        self, countries: DataFrame, areas: Sequence[str], items: Sequence[str], years: tuple[int, int], indicator: str = PRODUCTION
    ) -> DataFrame:
        """The key figures of a selection, from the stored states."""
        cells = partials.cells(self.states())
        return reports.kpi_of_cells(cells, self._table("price_states"), countries, areas, items, years, indicator)

    def ranking(self, countries: DataFrame, indicator: str, years: tuple[int, int], scope: Sequence[str]) -> DataFrame:
        """All countries ranked per year, from the stored states."""
        return reports.world_ranking_of_states(self.states(), countries, indicator, years, scope)
