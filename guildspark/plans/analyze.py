"""The two end-to-end jobs: `analyze` (tables to condition graphs) and `cluster` (graph and seed to community)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guildspark.functions.scalars import evidence_type, weight_type
from guildspark.operators import abundance as A
from guildspark.operators import association as S
from guildspark.operators import community as C
from guildspark.operators import network as N
from guildspark.operators.methods import METHODS
from guildspark.sources.sinks import read_graph
from guildspark.sources.staging import cut
from guildspark.sources.tables import load_abundance, load_metadata, sample_ids

SELECTING = ("spieceasi", "spring")


@dataclass(frozen=True)
class Request:
    """What a job is asked to do; an invalid request raises before anything is read."""

    dataset: str
    conditions: tuple[str, str]
    bacteria: tuple[str, ...] = ()
    fungi: tuple[str, ...] = ()
    metadata: tuple[str, ...] = ()
    fungi_metadata: tuple[str, ...] = ()  # of the fungi table; empty: the same as the other's
    condition_column: str = "Combination_treat2"
    grouping: str = "all"
    method: str = "spearman"
    max_p: float = 0.05
    min_abs: float = 0.0
    filters: A.TaxaFilter = field(default_factory=A.TaxaFilter)
    settings: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.dataset not in ("bacteria", "fungi", "both"):
            raise ValueError(f"unknown dataset type: {self.dataset}")
        need = {"bacteria": self.bacteria, "fungi": self.fungi, "both": self.bacteria and self.fungi}[self.dataset]
        if not need or not self.metadata:
            raise ValueError("abundance and metadata files are required")
        if len(self.conditions) != 2 or self.conditions[0] == self.conditions[1]:
            raise ValueError("two different conditions are required")
        if self.grouping not in ("all", "phylum", "genus"):
            raise ValueError(f"unknown grouping: {self.grouping}")
        if self.method != "spearman" and self.method not in METHODS:
            raise ValueError(f"unknown method: {self.method}")
        if not 0 <= self.max_p <= 1 or self.min_abs < 0:
            raise ValueError("thresholds are out of range")

    @classmethod
    def from_json(cls, text: str) -> Request:
        raw = json.loads(text)
        raw["filters"] = A.TaxaFilter(**raw.get("filters", {}))
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))


def pairs_of(cells: DataFrame, method: str, settings: dict) -> DataFrame:
    """(condition, left, right, rho, n, p, selected) by the method; Spearman is a plan, the others are matrix kernels."""
    if method == "spearman":
        return S.with_p(S.spearman(S.pair_cells(cells))).withColumn("selected", F.lit(None).cast("boolean"))
    found = METHODS[method](cells, **settings).withColumn("n", F.lit(None).cast("long"))
    if method in SELECTING:
        return found.withColumnRenamed("weight", "rho")
    return found.withColumn("selected", F.lit(None).cast("boolean"))


#: Methods that see both domains as one matrix; the others correlate within a domain on that domain's own samples.
JOINT = ("spieceasi", "spring")


def pairs_of_two(a: DataFrame, b: DataFrame, method: str, settings: dict) -> DataFrame:
    """Pairs within two domains and across them, from their cells (condition, sample_id, feature, value).

    A joint method gets the samples that both have in a condition. SparCC and CCLasso get three matrices per condition: each
    domain's own, and the joint one for the pairs across. Matrices are told apart by their name, so all are dealt out together."""
    has = lambda df: df.select("condition", "sample_id").distinct()
    joint = a.unionByName(b).join(has(a).join(has(b), ["condition", "sample_id"]), ["condition", "sample_id"], "left_semi")
    if method in JOINT:
        return pairs_of(joint, method, settings)
    named = lambda df, scope: df.withColumn("condition", F.concat(F.lit(scope), "condition"))
    every = named(a, "a:").unionByName(named(b, "b:")).unionByName(named(joint, "x:"))
    found = cut(pairs_of(every, method, settings), "pairs")
    of_a = a.select("feature").distinct().withColumn("of_a", F.lit(True))
    ends = lambda end: of_a.select(F.col("feature").alias(end), F.col("of_a").alias(f"{end}_of_a"))
    across = found.where("condition like 'x:%'").join(ends("left"), "left", "left").join(ends("right"), "right", "left")
    across = across.where(F.col("left_of_a").isNull() != F.col("right_of_a").isNull()).select(*found.columns)
    return found.where("condition not like 'x:%'").unionByName(across).withColumn("condition", F.substr("condition", F.lit(3)))


def analyze(spark: SparkSession, request: Request) -> dict[str, DataFrame]:
    """pairs, edges, nodes, stats, samples and the filter report of each domain. Filters see all samples of a table and
    run before grouping; correlations are per condition, which is a column and not a loop."""
    meta = load_metadata(spark, list(request.metadata), request.condition_column)
    metas = dict.fromkeys(("bacteria", "fungi"), meta)
    if request.fungi_metadata and request.dataset == "both":  # the bacteria's value counts where they differ
        metas["fungi"] = load_metadata(spark, list(request.fungi_metadata), request.condition_column)
        meta = A.merged_metadata(meta, metas["fungi"])
    ids = meta.select("sample_id")
    samples_of = {d: sample_ids(spark, list(p), ids) for d, p in (("bacteria", request.bacteria), ("fungi", request.fungi)) if p and request.dataset in (d, "both")}
    tables = {d: load_abundance(spark, list(p), ids) for d, p in (("bacteria", request.bacteria), ("fungi", request.fungi)) if p and request.dataset in (d, "both")}
    totals = A.combined_totals(*tables.values()) if len(tables) == 2 else None
    wanted = meta.where(F.col("condition").isin(*request.conditions))
    out, cells, ratios = {}, {}, None
    for domain, table in tables.items():
        if request.filters.enabled:
            table, judged = A.filter_taxa(table, request.filters, totals, samples_of[domain])
            out[f"filter_report_{domain}"] = A.filter_report(judged, domain, totals is not None)
        grouped = cut(A.group_taxa(table, request.grouping), domain)
        if grouped.select("feature").distinct().limit(2).count() < 2:
            raise ValueError(f"fewer than two features are left in {domain}")
        prefix = {"bacteria": "bac::", "fungi": "fun::"}[domain] if len(tables) == 2 else ""
        named = grouped.withColumn("feature", F.concat(F.lit(prefix), "feature"))
        cells[domain] = S.in_condition(named, metas[domain].where(F.col("condition").isin(*request.conditions)))
        own = A.overabundance(named, metas[domain])
        ratios = own if ratios is None else ratios.unionByName(own)
    if len(cells) == 1:
        pairs = pairs_of(next(iter(cells.values())), request.method, request.settings)
    elif request.method == "spearman":
        a, b = cells["bacteria"], cells["fungi"]
        every = S.pair_cells(a).unionByName(S.pair_cells(b)).unionByName(S.cross_cells(a, b))
        pairs = S.with_p(S.spearman(every)).withColumn("selected", F.lit(None).cast("boolean"))
    else:
        pairs = pairs_of_two(cells["bacteria"], cells["fungi"], request.method, request.settings)
    order = None
    for domain, table in tables.items():  # bacteria first, then the order of the files
        prefix = {"bacteria": "bac::", "fungi": "fun::"}[domain] if len(tables) == 2 else ""
        own = table.groupBy(F.concat(F.lit(prefix), A.taxon_of(F.col("feature"), request.grouping)).alias("feature")).agg(F.min(F.struct(F.lit(list(tables).index(domain)).alias("d"), "feature_ord")).alias("place"))
        order = own if order is None else order.unionByName(own)
    pairs = cut(S.oriented(pairs, order), "pairs")
    kept = S.significant(pairs, None if request.method in SELECTING else request.max_p, request.min_abs)
    edges = N.edges_of(kept, request.method, weight_type(F.lit(request.method)), evidence_type(F.lit(request.method)))
    samples = A.condition_stats(next(iter(tables.values())), wanted) if len(tables) == 1 else A.condition_stats_both(tables["bacteria"], tables["fungi"], wanted)
    return out | {"pairs": pairs, "edges": edges, "nodes": N.nodes_of(edges, ratios), "stats": N.graph_stats(edges), "samples": samples}


@dataclass(frozen=True)
class Clustering:
    """What a clustering job is asked to do. An empty or negative phi becomes the default and a negative alpha is unset;
    both are told in `clamped`. Without b, the size of each condition's graph gives it."""

    seed: str
    phi: float | None = None
    b: int | None = None
    alpha: float | None = None
    weighted: bool = False
    signed: bool = False
    sign_lambda: float = 1.0
    profile: str = "app"

    def __post_init__(self):
        if not self.seed:
            raise ValueError("a seed is required")
        if self.profile != "app":
            raise ValueError(f"unknown parameter profile: {self.profile}; give the values themselves")

    @classmethod
    def from_json(cls, text: str) -> Clustering:
        """Values under `overrides` win over those beside it; nulls are as good as absent."""
        raw = json.loads(text)
        given = lambda d: {k: v for k, v in d.items() if v is not None}
        overrides = raw.pop("overrides", None) or {}
        return cls(**given(raw) | given(overrides))

    @property
    def ladder(self) -> C.Ladder:
        phi, alpha = self.phi if self.phi is not None and self.phi > 0 else C.DEFAULT_PHI, self.alpha
        return C.Ladder(phi=phi, b=self.b, alpha=C.DEFAULT_ALPHA if alpha is None or alpha < 0 else alpha)

    @property
    def clamped(self) -> dict[str, float]:
        return {n: v for n, v, out in (("phi", self.phi, self.phi is not None and not self.phi > 0), ("alpha", self.alpha, self.alpha is not None and self.alpha < 0)) if out}


def run_clustering(edges: DataFrame, job: Clustering) -> dict[str, DataFrame]:
    """Members, their edges and the report of the job in every condition; `presence` tells which graphs have the seed."""
    nodes = N.nodes_of(edges)
    seeds = nodes.where(F.col("id") == job.seed).select("condition", F.col("id").alias("node"))
    found, _, report = C.cluster_with_report(edges, seeds, job.ladder, job.signed, job.sign_lambda, job.weighted)
    found = cut(found, "members")
    whole = C.conductance(edges, found, job.weighted).select("condition", F.col("volume").alias("_v"), F.col("conductance"))
    report = report.join(whole, "condition", "left").withColumn("volume", F.coalesce("volume", "_v")).withColumn("conductance", F.when(F.col("step") == 0, F.lit(float("inf"))).otherwise(F.col("conductance"))).drop("_v")
    if job.signed:
        composition = C.signed_composition(edges, found, job.sign_lambda).drop("score")
        report = report.join(composition, "condition", "left")
    return {"members": found, "report": report, "edges": N.induced(edges, found), "presence": N.seed_presence(nodes, job.seed)}


def recluster(spark: SparkSession, root: str, key: str, job: Clustering) -> dict[str, DataFrame]:
    """The clustering of a stored graph; no correlation is computed again."""
    return run_clustering(read_graph(spark, root, key), job)


def cluster(edges: DataFrame, seed: str, ladder: C.Ladder | None = None, signed: bool = False, weighted: bool = True, sign_lambda: float = 1.0) -> dict[str, DataFrame]:
    """The community of a seed in every condition whose graph has it: members, their edges and how they were selected.

    Without a ladder, the b of each condition comes from its graph's size."""
    seeds = N.nodes_of(edges).where(F.col("id") == seed).select("condition", F.col("id").alias("node"))
    found, chosen = C.cluster(edges, seeds, ladder, signed, sign_lambda, weighted)
    return {"members": found, "selection": chosen, "edges": N.induced(edges, found)}
