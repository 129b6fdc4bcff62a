"""The end-to-end job: changes → targets → subgraph → coverage → verdicts → fixes → decisions.

Heavy work is done per distinct target and joined back to the changes once. Tables that several
later steps read (targets, closure, coverage) are written to the shared folder: that cuts the
lineage, survives lost executors, and gives Spark real sizes to choose joins by.
"""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.functions.constants import COVERAGE_THRESHOLD, MAX_HOPS
from ripplemap.operators import coverage as cov
from ripplemap.operators import decisions as dec
from ripplemap.operators import expand, report, resolve, rewrite, verdict
from ripplemap.operators.skew import ROWS_PER_SHARD
from ripplemap.plans.session import if_any, stored


@dataclass(frozen=True)
class Catalog:
    """What the metadata catalog holds. Edges carry the profiles that can see them.

    ``masked`` and ``masked_columns`` are the same edges as ``catalog.masked_edges`` has them, stored;
    the expansion reads them where they are given.
    """

    entities: DataFrame
    edges: DataFrame
    column_edges: DataFrame
    registry: DataFrame
    profiles: tuple[str, ...]
    landing: tuple[str, ...]
    model_platform: str
    masked: DataFrame | None = None
    masked_columns: DataFrame | None = None


class Walked:
    """Targets of the changes and what lies in their reach, each table built on first use.

    Counters are taken from the walk as it ends. Who needs its entities too asks for ``closure_rows``
    first, which stores them.
    """

    def __init__(self, changes: DataFrame, catalog: Catalog, rows_per_shard: int, max_hops: int) -> None:
        self.changes, self.catalog = changes, catalog
        self.rows_per_shard, self.max_hops = rows_per_shard, max_hops
        self.profiles = list(catalog.profiles)

    @cached_property
    def resolved(self) -> DataFrame:
        targets = resolve.distinct_targets(self.changes)
        return stored(resolve.resolve(targets, self.catalog.entities), "resolved")

    @cached_property
    def scopes(self) -> DataFrame:
        return resolve.scopes(self.resolved)

    @cached_property
    def links(self) -> DataFrame:
        edges = self.catalog.edges if self.catalog.masked is None else self.catalog.masked
        return expand.links_of(edges, self.profiles, stored)

    @cached_property
    def hubs(self) -> DataFrame | None:
        return if_any(expand.link_hubs(self.links, self.rows_per_shard))

    def _reached(self, scopes: DataFrame) -> DataFrame:
        fields = self.catalog.masked_columns
        fields = self.catalog.column_edges if fields is None else fields
        return expand.reached(scopes, self.links, fields, self.profiles, self.max_hops, self.hubs, keep=stored)

    @cached_property
    def reached(self) -> DataFrame:
        return self._reached(self.scopes)

    @cached_property
    def closure_rows(self) -> DataFrame:
        return stored(self.reached, "closure")

    @cached_property
    def signatures(self) -> DataFrame:
        walked = self.__dict__.get("closure_rows", self.reached)
        return stored(expand.signatures(walked, self.profiles), "signatures")

    @cached_property
    def trims(self) -> DataFrame:
        return stored(expand.trimmed_scopes(self.signatures, self.max_hops), "trimmed")

    @cached_property
    def counted(self) -> DataFrame:
        """Kept entities by their number only."""
        return expand.subgraph(self.signatures, self.trims, self.max_hops)

    @cached_property
    def subgraph(self) -> DataFrame:
        rows = expand.candidates(self.closure_rows, self.profiles)
        return expand.subgraph(rows, self.trims, self.max_hops)

    def subgraph_of(self, scopes: DataFrame) -> DataFrame:
        """The kept entities of other scopes."""
        found = stored(self._reached(scopes), "closure")
        trims = expand.trimmed_scopes(expand.signatures(found, self.profiles), self.max_hops)
        return expand.subgraph(expand.candidates(found, self.profiles), stored(trims, "trimmed"), self.max_hops)


class Review:
    """Tables of one review run, each built on first use."""

    carry = tuple(
        dict.fromkeys(rewrite.EDIT_CARRY + dec.TAG_CARRY + report.REPORT_CARRY)
    )

    def __init__(
        self,
        changes: DataFrame,
        catalog: Catalog,
        overrides: DataFrame,
        sources: DataFrame | None = None,
        attempts: DataFrame | None = None,
        threshold: float = COVERAGE_THRESHOLD,
        judge_column: str | None = None,
        true_provenance: bool = False,
        rows_per_shard: int = ROWS_PER_SHARD,
        max_hops: int = MAX_HOPS,
        true_edges: bool = False,
    ) -> None:
        self.changes, self.catalog, self.overrides = changes, catalog, overrides
        self.sources, self.attempts = sources, attempts
        self.threshold, self.judge_column = threshold, judge_column
        self.true_provenance, self.rows_per_shard = true_provenance, rows_per_shard
        self.max_hops, self.true_edges = max_hops, true_edges

    def variant(
        self, judge_column: str | None = None, true_provenance: bool = False, true_edges: bool = False
    ) -> "Review":
        """The same review under another judge, or with the catalog's own evidence (``true_provenance``)
        or edges (``true_edges``: orphans of the induced subgraph), on the same expansion."""
        other = Review(
            self.changes, self.catalog, self.overrides, self.sources, self.attempts, self.threshold,
            judge_column, true_provenance, self.rows_per_shard, self.max_hops, true_edges,
        )
        other.walked = self.walked
        return other

    @cached_property
    def walked(self) -> "Walked":
        """The expansion, which variants of a review share."""
        return Walked(self.changes, self.catalog, self.rows_per_shard, self.max_hops)

    @property
    def resolved(self) -> DataFrame:
        return self.walked.resolved

    @cached_property
    def targets(self) -> DataFrame:
        return self.resolved.select("model", "column", "scope_id", "n_changes")

    @property
    def scopes(self) -> DataFrame:
        return self.walked.scopes

    @property
    def links(self) -> DataFrame:
        return self.walked.links

    @property
    def hubs(self) -> DataFrame | None:
        return self.walked.hubs

    def subgraph_of(self, scopes: DataFrame) -> DataFrame:
        return self.walked.subgraph_of(scopes)

    @property
    def subgraph(self) -> DataFrame:
        return self.walked.subgraph

    @cached_property
    def facts(self) -> DataFrame:
        landing = list(self.catalog.landing)
        orphans = self.orphans if self.true_edges else None
        return cov.scope_facts(self.walked.counted, landing, self.true_provenance, orphans)

    @cached_property
    def orphans(self) -> DataFrame:
        """Kept entities without an incoming edge from another one of their scope."""
        landing = list(self.catalog.landing)
        hot = if_any(cov.hot_entities(cov.unproven(self.subgraph), self.rows_per_shard))
        found = cov.orphan_rows(self.subgraph, landing, self.catalog.edges, hot, walked=True)
        return stored(found, "orphans")

    @cached_property
    def coverage(self) -> DataFrame:
        covered = cov.coverage(
            self.resolved, self.facts, self.catalog.registry, list(self.catalog.profiles), self.threshold
        )
        return stored(covered, "coverage")

    @cached_property
    def hot_targets(self) -> DataFrame | None:
        return if_any(verdict.hot_targets(self.targets, self.rows_per_shard))

    @cached_property
    def reviewed(self) -> DataFrame:
        joined = verdict.changes_with(self.changes, self.coverage, self.hot_targets)
        return cov.with_override(joined, self.overrides)

    @cached_property
    def verdicts(self) -> DataFrame:
        return rewrite.with_outcome(verdict.verdicts(self.reviewed, self.judge_column))

    @cached_property
    def verdict_table(self) -> DataFrame:
        """Verdicts as a table, for the steps that read them several times, and entities beside them."""
        self.walked.closure_rows  # noqa: B018 - stored before it is counted, so that it is walked once
        return stored(self.verdicts, "verdicts")

    @cached_property
    def impacts(self) -> DataFrame:
        return self.impacts_of(self.verdict_table)

    @cached_property
    def entries(self) -> DataFrame:
        """One list for each scope and tier; changes refer to it."""
        hot = if_any(verdict.hot_scopes(self.subgraph, self.rows_per_shard))
        return stored(verdict.scope_entries(self.verdict_table, self.subgraph, hot), "entries")

    @cached_property
    def hot_lists(self) -> DataFrame | None:
        return if_any(verdict.hot_lists(self.entries, self.rows_per_shard))

    def impacts_of(self, verdict_rows: DataFrame) -> DataFrame:
        """Impact rows of some or all of this review's verdicts."""
        return verdict.impact_rows(
            verdict_rows, self.entries, self.hot_lists, self.judge_column, self.carry
        )

    @cached_property
    def edits(self) -> DataFrame:
        if self.sources is None:
            raise ValueError("edits need model sources")
        edits = rewrite.edit_rows(self.impacts, self.sources, self.catalog.model_platform)
        return stored(edits, "edits")

    @cached_property
    def decisions(self) -> DataFrame:
        return dec.decisions(rewrite.with_fix_counts(self.verdict_table, self.edits))

    @cached_property
    def checks(self) -> DataFrame | None:
        """Last attempt per profile and change; blocked changes and those without edits have none."""
        if self.attempts is None:
            return None
        ran = self.decisions.filter(~F.col("is_blocked") & (F.col("fixed") > 0)).select(
            "profile", "change_id"
        )
        return ran.join(rewrite.last_attempt_passed(self.attempts, ["change_id"]), "change_id")

    @cached_property
    def bodies(self) -> DataFrame:
        """Decision bodies. A judge's text differs by change, so that lists are then made for each."""
        lists = dec.entry_lists(self.entries) if self.judge_column is None else None
        return dec.body_parts(self.decisions, self.impacts, self.edits, self.checks, lists=lists)

    @cached_property
    def documents(self) -> DataFrame:
        return report.documents(self.decisions, self.impacts, self.edits, self.attempts)
