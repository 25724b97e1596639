"""Registered queries over the supplied tables and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guildspark.operators import abundance as A
from guildspark.operators import association as S
from guildspark.operators import community as C
from guildspark.operators import compare as X
from guildspark.operators import experiments as XP
from guildspark.operators import methods as MD
from guildspark.operators import network as N
from guildspark.operators import sets as ST
from guildspark.operators import stability as T
from guildspark.operators import walks as WK
from guildspark.sources import demo
from guildspark.sources.staging import cut

QUERIES: dict = {}
SQL: dict = {}

FILTER = A.TaxaFilter(prevalence_percent=72.0, mean_relative_percent=3.9, min_variance=0.0014)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


# --- SQL building blocks ---------------------------------------------------------------------------

B = "b as (select o_custkey as sample_id, p_brand as feature, sum(l_quantity) as value from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2)"
BL = "b as (select o_custkey as sample_id, 'p_' || p_type || ';g_' || p_brand as feature, sum(l_quantity) as value from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2)"
FU = "fu as (select user_id as sample_id, event_type as feature, count(*)::double as value from events group by 1, 2)"
M = "m as (select c_custkey as sample_id, c_mktsegment as condition from customer)"
CELLS = f"{B}, {M}, cells as (select condition, sample_id, feature, value from b join m using (sample_id))"
TOTALS = "tot as (select sample_id, sum(value) as total from b group by 1)"
REL = f"{B}, {TOTALS}, rel as (select b.sample_id, feature, value, case when total > 0 then value / total else 0 end as relative from b join tot using (sample_id)), n as (select count(*) as n from tot)"
GRID = f"{REL}, grid as (select t.sample_id, f.feature, coalesce(r.value, 0) as value, coalesce(r.relative, 0) as relative from tot t cross join (select distinct feature from b) f left join rel r on r.sample_id = t.sample_id and r.feature = f.feature)"
METRICS = f"{GRID}, metrics as (select feature, count(*) as n_samples, count(*) filter (where value > 0) / count(*) as prevalence, avg(relative) as mean_relative, var_pop(relative) as variance from grid group by 1)"
REASONS = f"{METRICS}, judged as (select *, list_filter([case when prevalence < 72.0 / 100 then 'prevalence' end, case when mean_relative < 3.9 / 100 then 'meanRelativeAbundance' end, case when variance < 0.0014 then 'variability' end], lambda x: x is not null) as reasons from metrics)"


def ranks(pairs: str) -> str:
    by = "condition, \"left\", \"right\""
    return f"""ranked as (select *, rank() over (partition by {by} order by x) + (count(*) over (partition by {by}, x) - 1) / 2.0 as rx,
      rank() over (partition by {by} order by y) + (count(*) over (partition by {by}, y) - 1) / 2.0 as ry from ({pairs})),
    rho as (select {by}, greatest(-1.0, least(1.0, corr(rx, ry))) as rho, count(*) as n from ranked group by {by}
      having count(*) >= 3 and min(rx) <> max(rx) and min(ry) <> max(ry))"""


PAIRS = 'select a.condition, a.sample_id, a.feature as "left", b.feature as "right", a.value as x, b.value as y from cells a join cells b on a.condition = b.condition and a.sample_id = b.sample_id and a.feature < b.feature'
RHO = f"{CELLS}, {ranks(PAIRS)}"
P = """ang as (select *, n - 2 as df, atan(abs(rho) * sqrt((n - 2) / ((1 - rho) * (1 + rho))) / sqrt(n - 2.0)) as th from rho),
    pv as (select condition, "left", "right", rho, n, case when abs(rho) >= 1 then 0.0 when df % 2 = 1 then
        greatest(0, 1 - 2 / pi() * (th + sin(th) * cos(th) * coalesce(list_sum(list_transform(range(0, (df - 1) // 2), lambda k: exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(cos(th), 2 * k))), 0)))
      else greatest(0, 1 - sin(th) * coalesce(list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos(th), 2 * k))), 0)) end as p from ang)"""
#: Graphs for the graph queries: pairs of two segments whose rounded correlation is at least 0.04 in size.
EDGES = f"""{RHO}, edges as (select condition, "left" as source, "right" as target, round(rho, 6) as weight from rho where condition in ('FURNITURE', 'MACHINERY') and abs(round(rho, 6)) >= 0.04)"""
ADJ = f"{EDGES}, adj as (select condition, source as u, target as v, weight from edges union all select condition, target, source, weight from edges)"
DEG = f"{ADJ}, deg as (select condition, u as node, count(*) as degree, sum(abs(weight)) as d from adj group by 1, 2)"
EA = f"{EDGES}, ea as (select * from edges where condition = 'FURNITURE'), eb as (select * from edges where condition = 'MACHINERY'), ka as (select *, least(source, target) || '::' || greatest(source, target) as k from ea), kb as (select *, least(source, target) || '::' || greatest(source, target) as k from eb)"
#: Clusters for set views: nodes with a strong tie to the hub brand.
NODES = f"{EA}, na as (select distinct unnest([source, target]) as node from ea where abs(weight) >= 0.18), nb as (select distinct unnest([source, target]) as node from eb where abs(weight) >= 0.18), ca as (select * from ka where source in (select node from na) and target in (select node from na)), cb as (select * from kb where source in (select node from nb) and target in (select node from nb))"


#: Cells that a task of the pairs gets at most, about; each makes some ten pairs.
PAIR_LANE_ROWS = 50_000


def cells(spark, sf) -> DataFrame:
    return S.in_condition(demo.bacteria(spark, sf), demo.conditions(spark, sf))


def correlated(own: DataFrame) -> DataFrame:
    """Correlations of all pairs of features; pairs and points are dealt over partitions that grow with the cells."""
    own = cut(own, "cells")  # both sides of the pairs
    n = demo.lanes(own, PAIR_LANE_ROWS)
    return S.spearman(S.pair_cells(own, n), n)


def rho(spark, sf) -> DataFrame:
    return correlated(cells(spark, sf))


def edges(spark, sf, wanted: tuple[str, ...] | None = ("FURNITURE", "MACHINERY")) -> DataFrame:
    own = S.in_condition(demo.bacteria(spark, sf), demo.conditions(spark, sf), wanted)
    e = correlated(own).select("condition", F.col("left").alias("source"), F.col("right").alias("target"), F.round("rho", 6).alias("weight"))
    return cut(e.where(F.abs("weight") >= 0.04), "edges")


def one(e: DataFrame, condition: str) -> DataFrame:
    return e.where(F.col("condition") == condition).select("source", "target", "weight", F.lit(None).cast("double").alias("p"), F.lit("correlation").alias("weight_type"), F.lit("pairwise_p_value").alias("evidence_type"), F.lit("spearman").alias("method"))


def two_clusters(spark, sf):
    e = edges(spark, sf)
    a, b = one(e, "FURNITURE"), one(e, "MACHINERY")
    na, nb = (X.node_ids(x.where(F.abs("weight") >= 0.18)) for x in (a, b))
    within = lambda x, n: x.join(n.select(F.col("node").alias("source")), "source", "left_semi").join(n.select(F.col("node").alias("target")), "target", "left_semi")
    return a, b, na, nb, within(a, na), within(b, nb)


# --- sources ---------------------------------------------------------------------------------------


@query(f"with {B} select sample_id, feature, value from b")
def src3_abundance_long(spark, sf):
    return demo.bacteria(spark, sf)


@query(f"with {B}, {FU} select sample_id::varchar as sample_id, feature, value from b union all select sample_id::varchar, feature, value from fu")
def src1_tables_both_ways(spark, sf):
    """Both abundance tables as files, one by samples and one by features, with three separators; an older version of the first comes before it."""
    from guildspark.sources import cells as FC
    from guildspark.sources.staging import shared_folder

    root = shared_folder(spark, "tables")
    one, two = cut(demo.bacteria(spark, sf), "cells"), cut(demo.fungi(spark, sf), "cells")
    FC.write_tables(one.withColumn("value", F.col("value") + 1), f"{root}/older", ";", whole=True)
    FC.write_tables(one, f"{root}/bacteria", ",", whole=True)
    FC.write_tables(two, f"{root}/fungi", "\t", transposed=True, whole=True)
    ids = one.select("sample_id").unionByName(two.select("sample_id"))
    loaded = [FC.load_tables(spark, [f"{root}/{name}" for name in names], ids, whole=True) for names in (("older", "bacteria"), ("fungi",))]
    return loaded[0].unionByName(loaded[1]).select("sample_id", "feature", "value")


@query("select c_custkey::varchar as sample_id, c_mktsegment as condition from customer")
def src2_metadata_files(spark, sf):
    """Metadata as files: an older version of every sample's condition, then the one that holds."""
    from guildspark.sources import cells as FC
    from guildspark.sources.staging import shared_folder

    root, meta = shared_folder(spark, "metadata"), demo.conditions(spark, sf)
    for name, value in (("older", F.lit("unknown")), ("newer", F.col("condition"))):
        rows = meta.select(F.concat_ws("\t", FC.said(F.col("sample_id").cast("string")), F.lit("x"), FC.said(value)).alias("value"))
        head = spark.createDataFrame([("sample\tnote\tcondition",)], "value string")
        FC.write_with_header(rows, head, f"{root}/{name}")
    return FC.load_conditions(spark, [f"{root}/older", f"{root}/newer"], "condition").select(FC.unsaid(F.col("sample_id")).alias("sample_id"), FC.unsaid(F.col("condition")).alias("condition"))


@query("with b as (select l_suppkey as sample_id, p_brand as feature, sum(l_quantity) as value from lineitem join part on l_partkey = p_partkey group by 1, 2) select feature, sample_id::varchar as sample_id, value from b")
def src5_transposed_unpivot(spark, sf):
    """A table with its samples as columns, as files of some thousand columns each, read back into long cells."""
    from guildspark.sources import cells as FC
    from guildspark.sources.staging import shared_folder

    path, own = shared_folder(spark, "transposed"), cut(demo.dense(spark, sf), "cells")
    FC.write_tables(own, path, "\t", transposed=True, whole=True)
    return FC.long_cells(FC.read_cells(spark, [path]), own.select("sample_id"), whole=True).select("feature", "sample_id", "value")


@query("select event_id, case when regexp_matches(trim(v), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') then trim(v)::double end as value from (select event_id, case event_id % 4 when 0 then ' ' || value::varchar || ' ' when 1 then 'n/a' when 2 then '' else (event_id)::varchar || 'd' end as v from events)")
def src6_coerce_cells(spark, sf):
    from guildspark.sources.tables import number

    k = F.col("event_id") % 4
    v = F.when(k == 0, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).when(k == 1, "n/a").when(k == 2, "").otherwise(F.concat(F.col("event_id").cast("string"), F.lit("d")))
    return demo.table(spark, sf, "events").select("event_id", number(v).alias("value"))


@query("select user_id as sample_id, event_type as condition from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def src7_metadata_last_wins(spark, sf):
    e = demo.table(spark, sf, "events")
    return A.last_wins(e, ["user_id"], ["ts", "event_id"]).select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("condition"))


@query(f"with {M} select condition, count(distinct sample_id) as n_samples from m where condition is not null and trim(condition) <> '' group by 1")
def src9_distinct_conditions(spark, sf):
    from guildspark.sources.tables import distinct_conditions

    return distinct_conditions(demo.conditions(spark, sf))


# --- filters ---------------------------------------------------------------------------------------


@query(f"with {REL} select sample_id, feature, round(relative, 6) + 0.0 as relative from rel")
def flt1_relative_abundance(spark, sf):
    return A.relative_abundance(demo.bacteria(spark, sf)).select("sample_id", "feature", r6("relative").alias("relative"))


@query(f"with {METRICS} select feature, round(prevalence, 6) as prevalence from metrics where prevalence >= 0.72")
def flt2_prevalence(spark, sf):
    return A.feature_metrics(demo.bacteria(spark, sf)).where("prevalence >= 0.72").select("feature", F.round("prevalence", 6).alias("prevalence"))


@query(f"with {METRICS} select feature, round(mean_relative, 6) as mean_relative from metrics where mean_relative >= 0.039")
def flt3_mean_relative(spark, sf):
    return A.feature_metrics(demo.bacteria(spark, sf)).where("mean_relative >= 0.039").select("feature", F.round("mean_relative", 6).alias("mean_relative"))


@query(f"with {METRICS} select feature, round(variance, 8) as variance from metrics")
def flt4_variance(spark, sf):
    return A.feature_metrics(demo.bacteria(spark, sf)).select("feature", F.round("variance", 8).alias("variance"))


@query(f"with {REASONS} select feature, array_to_string(reasons, ',') as reasons from judged")
def flt5_filter_reasons(spark, sf):
    return A.filter_taxa(demo.bacteria(spark, sf), FILTER)[1].select("feature", F.array_join("reasons", ",").alias("reasons"))


@query(f"with {B}, {FU}, s as (select sample_id, sum(value) as total from (select sample_id, value from b union all select sample_id, value from fu) group by 1) select b.sample_id, feature, round(case when total > 0 then value / total else 0 end, 6) as relative from b join s using (sample_id)")
def flt6_combined_denominator(spark, sf):
    b, fu = demo.bacteria(spark, sf), demo.fungi(spark, sf)
    return A.relative_abundance(b, A.combined_totals(b, fu)).select("sample_id", "feature", F.round("relative", 6).alias("relative"))


@query(f"with {REASONS} select max(n_samples) as total_samples, count(*) as before, count(*) filter (where len(reasons) = 0) as after, count(*) filter (where list_contains(reasons, 'prevalence')) as removed_prevalence, count(*) filter (where list_contains(reasons, 'meanRelativeAbundance')) as removed_mean_relative, count(*) filter (where list_contains(reasons, 'variability')) as removed_variability, count(*) filter (where len(reasons) > 0) / count(*) > 0.6 as aggressive_removal from judged")
def flt7_filter_report(spark, sf):
    judged = A.filter_taxa(demo.bacteria(spark, sf), FILTER)[1]
    return A.filter_report(judged, "bacteria").select("total_samples", "before", "after", "removed_prevalence", "removed_mean_relative", "removed_variability", "aggressive_removal")


@query(f"with {REASONS} select b.sample_id, b.feature, b.value from b join judged using (feature) where len(reasons) = 0")
def flt8_restrict(spark, sf):
    return A.filter_taxa(demo.bacteria(spark, sf), FILTER)[0].select("sample_id", "feature", "value")


@query(f"with {B}, {M}, s as (select sample_id from m where sample_id in (select sample_id from b)), g as (select feature, count(*) as k, min(value) as lo, max(value) as hi from b where sample_id in (select sample_id from s) group by 1), n as (select count(*) as n from s) select feature from g, n where case when k < n then least(lo, 0) else lo end <> case when k < n then greatest(hi, 0) else hi end")
def flt9_constant_features(spark, sf):
    b = demo.bacteria(spark, sf)
    s = demo.conditions(spark, sf).join(b, "sample_id", "left_semi")
    return A.varying_features(b, s)


@query(f"with {CELLS}, n as (select condition, count(distinct sample_id) as n from cells group by 1), g as (select condition, feature, count(distinct sample_id) as k, min(value) as lo, max(value) as hi from cells group by 1, 2) select condition, feature from g join n using (condition) where case when k < n then least(lo, 0) else lo end <> case when k < n then greatest(hi, 0) else hi end")
def flt9_varying_by_condition(spark, sf):
    return A.varying_by_condition(S.in_condition(demo.bacteria(spark, sf), demo.conditions(spark, sf)))


@query(f"with {FU} select sample_id from fu where feature <> 'view' group by 1 having sum(value) > 0")
def flt10_empty_samples(spark, sf):
    return A.non_empty_samples(demo.fungi(spark, sf).where("feature <> 'view'"))


# --- group and condition aggregates ----------------------------------------------------------------


@query(f"with {BL} select sample_id, regexp_extract(feature, 'g_([^;]*)', 1) as feature, sum(value) as value from b group by 1, 2")
def ag1_group_taxa(spark, sf):
    return A.group_taxa(demo.bacteria_labels(spark, sf), "genus")


@query(f"with {BL} select sample_id, regexp_extract(feature, 'p_([^;]*)', 1) as feature, sum(value) as value from b group by 1, 2")
def ag1_group_phylum(spark, sf):
    return A.group_taxa(demo.bacteria_labels(spark, sf), "phylum")


@query(f"with {B} select sample_id, sum(value) as total from b group by 1")
def ag2_sample_totals(spark, sf):
    return A.sample_totals(demo.bacteria(spark, sf))


@query(f"with {CELLS} select feature, round(coalesce(avg(value) filter (where condition = 'FURNITURE'), 0), 6) as mean from cells group by 1")
def ag4_mean_present(spark, sf):
    return A.mean_present(demo.bacteria(spark, sf), demo.conditions(spark, sf).where("condition = 'FURNITURE'")).select("feature", F.round("mean", 6).alias("mean"))


@query(f"with {CELLS}, al as (select feature, avg(value) as a from cells group by 1), ow as (select condition, feature, avg(value) as o from cells group by 1, 2) select c.condition, al.feature, round(case when a > 0 then coalesce(o, 0) / a else 1 end, 6) as ratio from al cross join (select distinct condition from m) c left join ow on ow.condition = c.condition and ow.feature = al.feature")
def ag5_overabundance(spark, sf):
    return A.overabundance(demo.bacteria(spark, sf), demo.conditions(spark, sf)).select("condition", "feature", F.round("ratio", 6).alias("ratio"))


@query(f"with {B}, {M}, s as (select distinct sample_id from b) select condition, count(*) as metadata_samples, count(s.sample_id) as matched, count(*) - count(s.sample_id) as missing from m left join s using (sample_id) group by 1")
def ag8_condition_stats(spark, sf):
    return A.condition_stats(demo.bacteria(spark, sf), demo.conditions(spark, sf))


@query(f"with {B}, {FU}, {M}, s as (select distinct sample_id, 1 as a from b), t as (select distinct sample_id, 1 as f from fu) select condition, count(a) as bacteria, count(f) as fungi, count(a + f) as \"cross\", count(coalesce(a, f)) as total from m left join s using (sample_id) left join t using (sample_id) group by 1")
def ag9_condition_stats_both(spark, sf):
    return A.condition_stats_both(demo.bacteria(spark, sf), demo.fungi(spark, sf), demo.conditions(spark, sf))


# --- correlation -----------------------------------------------------------------------------------


@query(f'with {RHO} select condition, "left", "right", round(rho, 6) + 0.0 as rho, n from rho')
def ag6_spearman(spark, sf):
    return rho(spark, sf).select("condition", "left", "right", r6("rho").alias("rho"), "n")


@query(f'with {RHO}, {P} select condition, "left", "right", n, round(p, 6) + 0.0 as p from pv')
def ag6_spearman_p(spark, sf):
    return S.with_p(rho(spark, sf)).select("condition", "left", "right", "n", r6("p").alias("p"))


DENSE = "b as (select l_suppkey as sample_id, p_brand as feature, sum(l_quantity) as value from lineitem join part on l_partkey = p_partkey group by 1, 2), m as (select s_suppkey as sample_id, r_name as condition from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey), cells as (select condition, sample_id, feature, value from b join m using (sample_id) where feature in (select feature from b group by 1 having count(*) = (select count(distinct sample_id) from b)))"


@query(f'with {DENSE}, {ranks(PAIRS)} select condition, "left", "right", round(rho, 6) + 0.0 as rho, n from rho')
def ag6_spearman_complete(spark, sf):
    b = demo.dense(spark, sf)
    n = b.agg(F.countDistinct("sample_id").alias("_n"))
    full = b.groupBy("feature").agg(F.count("*").alias("_k")).join(F.broadcast(n), F.col("_k") == F.col("_n")).select("feature")
    own = S.in_condition(b.join(full, "feature", "left_semi"), demo.dense_conditions(spark, sf))
    return S.spearman_complete(own).select("condition", "left", "right", r6("rho").alias("rho"), "n")


@query(f"with {RHO}, {P} select condition, \"left\" as source, \"right\" as target, round(rho, 6) + 0.0 as weight, round(p, 6) + 0.0 as p from pv where condition in ('FURNITURE', 'MACHINERY') and p <= 0.05")
def flt12_significant_edges(spark, sf):
    own = S.in_condition(demo.bacteria(spark, sf), demo.conditions(spark, sf), ["FURNITURE", "MACHINERY"])
    found = S.significant(S.with_p(correlated(own)), 0.05)
    return N.edges_of(found).select("condition", "source", "target", r6("weight").alias("weight"), r6("p").alias("p"))


@query(f"with {RHO}, {P} select condition, \"left\", \"right\", round(rho, 6) + 0.0 as rho from pv where p <= 0.2 and abs(rho) >= 0.05")
def flt14_weight_threshold(spark, sf):
    return S.significant(S.with_p(rho(spark, sf)), 0.2, 0.05).select("condition", "left", "right", r6("rho").alias("rho"))


CROSS = 'select a.condition, a.sample_id, a.feature as "left", f.feature as "right", a.value as x, f.value as y from cells a join fcells f on a.condition = f.condition and a.sample_id = f.sample_id'
FCELLS = f"{FU}, fcells as (select condition, sample_id, feature, value from fu join m using (sample_id))"


@query(f'with {CELLS}, {FCELLS}, {ranks(CROSS)} select condition, "left", "right", round(rho, 6) + 0.0 as rho, n from rho')
def jn4_cross_domain_spearman(spark, sf):
    meta = demo.conditions(spark, sf)
    a, b = (cut(S.in_condition(df, meta), "cells") for df in (demo.bacteria(spark, sf), demo.fungi(spark, sf)))
    n = demo.lanes(a.unionByName(b), PAIR_LANE_ROWS)
    return S.spearman(S.cross_cells(a, b, n), n).select("condition", "left", "right", r6("rho").alias("rho"), "n")


BOTH = f"""select 'bac::' || a.feature as "left", 'bac::' || b.feature as "right", a.condition, a.sample_id, a.value as x, b.value as y from cells a join cells b on a.condition = b.condition and a.sample_id = b.sample_id and a.feature < b.feature
 union all select 'fun::' || a.feature, 'fun::' || b.feature, a.condition, a.sample_id, a.value, b.value from fcells a join fcells b on a.condition = b.condition and a.sample_id = b.sample_id and a.feature < b.feature
 union all select 'bac::' || a.feature, 'fun::' || b.feature, a.condition, a.sample_id, a.value, b.value from cells a join fcells b on a.condition = b.condition and a.sample_id = b.sample_id"""


@query(f'with {CELLS}, {FCELLS}, {ranks(BOTH)} select condition, "left", "right", round(rho, 6) + 0.0 as rho, n from rho')
def so6_both_domain_pairs(spark, sf):
    meta = demo.conditions(spark, sf)
    tag = lambda df, p: cut(S.in_condition(df, meta).withColumn("feature", F.concat(F.lit(p), "feature")), "cells")
    a, b = tag(demo.bacteria(spark, sf), "bac::"), tag(demo.fungi(spark, sf), "fun::")
    n = demo.lanes(a.unionByName(b), PAIR_LANE_ROWS)
    every = S.pair_cells(a, n).unionByName(S.pair_cells(b, n)).unionByName(S.cross_cells(a, b, n))
    return S.spearman(every, n).select("condition", "left", "right", r6("rho").alias("rho"), "n")


@query(f"with {B}, g as (select s.sample_id, f.feature, coalesce(b.value, 0) + 0.5 as v from (select distinct sample_id from b) s cross join (select distinct feature from b) f left join b on b.sample_id = s.sample_id and b.feature = f.feature) select sample_id, feature, round(ln(v) - avg(ln(v)) over (partition by sample_id), 6) + 0.0 as clr from g")
def md_clr(spark, sf):
    return A.clr(demo.bacteria(spark, sf)).select("sample_id", "feature", r6("clr").alias("clr"))


@query(f"with {B}, c as (select sample_id, feature, ln(value) - avg(ln(value)) over (partition by sample_id) as c from b where value > 0), s as (select abs(min(c)) + 1 as s from c) select sample_id, feature, round(c + s, 6) as mclr from c, s")
def md_mclr(spark, sf):
    return A.mclr(demo.bacteria(spark, sf)).select("sample_id", "feature", F.round("mclr", 6).alias("mclr"))


@query(f'with {DENSE}, pc as ({PAIRS}) select a.condition, a."left", a."right", round(avg(sign(a.x - b.x) * sign(a.y - b.y)), 6) + 0.0 as tau from pc a join pc b on a.condition = b.condition and a."left" = b."left" and a."right" = b."right" and a.sample_id < b.sample_id group by 1, 2, 3')
def md_kendall(spark, sf):
    b = demo.dense(spark, sf)
    n = b.agg(F.countDistinct("sample_id").alias("_n"))
    full = b.groupBy("feature").agg(F.count("*").alias("_k")).join(F.broadcast(n), F.col("_k") == F.col("_n")).select("feature")
    own = S.in_condition(b.join(full, "feature", "left_semi"), demo.dense_conditions(spark, sf))
    return S.kendall(S.pair_cells(own)).select("condition", "left", "right", r6("tau").alias("tau"))


@query(f'with {CELLS}, pc as ({PAIRS}) select a.condition, a."left", a."right", round(avg(sign(a.x - b.x) * sign(a.y - b.y)), 6) + 0.0 as tau, any_value(n) as n from pc a join pc b on a.condition = b.condition and a."left" = b."left" and a."right" = b."right" and a.sample_id < b.sample_id join (select condition, "left", "right", count(*) as n from pc group by 1, 2, 3) c on c.condition = a.condition and c."left" = a."left" and c."right" = a."right" group by 1, 2, 3')
def md_kendall_segments(spark, sf):
    """Kendall's tau of every pair of brands in all five segments, over the customers that bought both."""
    return S.kendall(S.pair_cells(cells(spark, sf))).select("condition", "left", "right", r6("tau").alias("tau"), "n")


# --- graphs ----------------------------------------------------------------------------------------


@query(f"with {EDGES} select condition, source, target, weight + 0.0 as weight from edges")
def gr1_edges(spark, sf):
    return edges(spark, sf)


@query(f"with {EDGES}, {{}} select e.condition, e.id, round(coalesce(r.ratio, 1), 6) as overabundance from (select distinct condition, unnest([source, target]) as id from edges) e left join r on r.condition = e.condition and r.feature = e.id".format("al as (select feature, avg(value) as a from cells group by 1), r as (select c.condition, c.feature, case when max(a) > 0 then avg(value) / max(a) else 1 end as ratio from cells c join al using (feature) group by 1, 2)"))
def gr1_nodes(spark, sf):
    ratios = A.overabundance(demo.bacteria(spark, sf), demo.conditions(spark, sf))
    return N.nodes_of(edges(spark, sf), ratios).select("condition", "id", F.round("overabundance", 6).alias("overabundance"))


STATS = f"with {EDGES}, nn as (select condition, count(distinct id) as node_count from (select condition, unnest([source, target]) as id from edges) group by 1)"


@query(f"""with {RHO}, {P}, kept as (select * from pv where p <= 0.05 and abs(rho) >= 0.15), nn as (select condition, count(distinct id) as node_count from (select condition, unnest(["left", "right"]) as id from kept) group by 1),
  e as (select condition, count(*) as n, avg(rho) as w from kept group by 1)
  select t.condition, total_pairs, coalesce(e.n, 0) as significant_pairs, coalesce(node_count, 0) as node_count, coalesce(e.n, 0) as edge_count, round(e.w, 6) as mean_weight, 0.05::double as p_value_threshold, true as p_value_threshold_applied, 0.15::double as correlation_threshold, 'minimum_absolute_correlation' as correlation_threshold_label, 'correlation' as weight_type, 'pairwise_p_value' as evidence_type
  from (select condition, count(*) as total_pairs from pv group by 1) t left join e using (condition) left join nn using (condition)""")
def ag7_labelled_stats(spark, sf):
    """Statistics of all five segments' graphs with the thresholds that made them."""
    pairs = cut(S.with_p(rho(spark, sf)), "pairs")
    kept = S.significant(pairs, 0.05, 0.15)
    found = N.labelled_stats(pairs, kept, N.graph_stats(N.edges_of(kept)), "spearman", 0.05, 0.15)
    return found.select("condition", "total_pairs", "significant_pairs", "node_count", "edge_count", F.round("mean_weight", 6).alias("mean_weight"), "p_value_threshold", "p_value_threshold_applied", "correlation_threshold", "correlation_threshold_label", "weight_type", "evidence_type")


@query(f"with {RHO} select condition, \"left\", \"right\", round(rho, 6) + 0.0 as rho, n from rho order by condition, \"left\", \"right\" limit 200")
def tk5_preview(spark, sf):
    return N.preview(rho(spark, sf), ["condition", "left", "right"]).select("condition", "left", "right", r6("rho").alias("rho"), "n")


@query(f"with {CELLS}, al as (select feature, avg(value) as a from cells group by 1), ow as (select condition, feature, avg(value) as o from cells group by 1, 2), r as (select c.condition, al.feature, case when a > 0 then coalesce(o, 0) / a else 1 end as ratio from al cross join (select distinct condition from m) c left join ow on ow.condition = c.condition and ow.feature = al.feature), x as (select condition, greatest(1, max(ratio)) as most from r group by 1) select condition, feature, round(0.8 + 3 * greatest(0.1, least(1, case when ratio > 0 then ratio else 1 end / most)), 6) as border from r join x using (condition)")
def sc26_node_borders(spark, sf):
    from guildspark.functions.scalars import node_border

    ratios = A.overabundance(demo.bacteria(spark, sf), demo.conditions(spark, sf))
    most = Window.partitionBy("condition")
    return ratios.select("condition", "feature", F.round(node_border(F.col("ratio"), F.max("ratio").over(most)), 6).alias("border"))


@query(f"{STATS} select condition, node_count, count(*) as edge_count, round(avg(weight), 6) as mean_weight from edges join nn using (condition) group by 1, 2")
def ag7_graph_stats(spark, sf):
    return N.graph_stats(edges(spark, sf)).select("condition", "node_count", "edge_count", F.round("mean_weight", 6).alias("mean_weight"))


@query(f"{STATS} select condition, count(*) filter (where weight < 0) as negative, count(*) filter (where weight > 0) as positive, round(count(*) filter (where weight < 0) / count(*) filter (where weight > 0), 6) as np_ratio from edges group by 1")
def ag15_np_ratio(spark, sf):
    return N.graph_stats(edges(spark, sf)).select("condition", "negative", "positive", F.round("np_ratio", 6).alias("np_ratio"))


@query(f"with {EDGES} select condition, count(*) filter (where weight > 0) as positive_edges, count(*) filter (where weight < 0) as negative_edges, round(count(*) filter (where weight > 0) / count(*), 6) as positive_fraction, round(coalesce(avg(weight) filter (where weight > 0), 0), 6) as mean_abs_positive_corr, round(coalesce(-avg(weight) filter (where weight < 0), 0), 6) as mean_abs_negative_corr from edges group by 1")
def ag28_sign_stats(spark, sf):
    return N.sign_stats(edges(spark, sf)).select("condition", "positive_edges", "negative_edges", *[F.round(c, 6).alias(c) for c in ("positive_fraction", "mean_abs_positive_corr", "mean_abs_negative_corr")])


@query(f"with {DEG} select condition, node, degree, round(d, 6) as weighted_degree from deg")
def ag10_degrees(spark, sf):
    return N.degrees(edges(spark, sf)).select("condition", "node", "degree", F.round("weighted_degree", 6).alias("weighted_degree"))


@query(f"with {EDGES}, dup as (select condition, source, target, weight from edges union all select condition, target, source, round(-weight / 2, 6) from edges) select condition, least(source, target) as source, greatest(source, target) as target, arg_max(weight, abs(weight)) as weight from dup group by 1, 2, 3")
def ag11_strongest_edge(spark, sf):
    e = edges(spark, sf)
    weaker = e.select("condition", F.col("target").alias("source"), F.col("source").alias("target"), F.round(-F.col("weight") / 2, 6).alias("weight"))
    return N.strongest(e.unionByName(weaker))


@query(f"with {ADJ}, rk as (select condition, u as node, v as neighbor, abs(weight) as weight, row_number() over (partition by condition, u order by abs(weight) desc, v) as rank from adj) select condition, node, rank::int as rank, neighbor, weight from rk where rank <= 10")
def ag30_top_neighbors(spark, sf):
    return N.top_neighbors(edges(spark, sf))


@query(f"with {EDGES}, g as (select distinct p_brand as node, 'G' || substr(p_brand, 7, 1) as grp from part) select e.condition, least(a.grp, b.grp) as source, greatest(a.grp, b.grp) as target, round(sum(abs(weight)), 6) as weight, count(*) as n_edges from edges e join g a on a.node = e.source join g b on b.node = e.target where a.grp <> b.grp group by 1, 2, 3")
def ag31_grouped_graph(spark, sf):
    g = demo.table(spark, sf, "part").select(F.col("p_brand").alias("node"), F.concat(F.lit("G"), F.substring("p_brand", 7, 1)).alias("group")).distinct()
    both = g.crossJoin(F.broadcast(spark.createDataFrame([("FURNITURE",), ("MACHINERY",)], "condition string")))
    return N.grouped_graph(edges(spark, sf), both).select("condition", "source", "target", F.round("weight", 6).alias("weight"), "n_edges")


# --- comparison ------------------------------------------------------------------------------------


@query(f"with {NODES} select a.source, a.target, a.weight as weight_a, b.weight as weight_b, case when a.weight > 0 then 'positive' when a.weight < 0 then 'negative' else 'neutral' end as sign_a, case when b.weight > 0 then 'positive' when b.weight < 0 then 'negative' else 'neutral' end as sign_b, case when sign_a = sign_b then '' when sign_a = 'positive' then 'pos_to_neg' else 'neg_to_pos' end as conflict_type, case when sign_a = sign_b then a.weight when abs(a.weight) >= abs(b.weight) then a.weight else b.weight end as weight from ca a join cb b using (k)")
def so1_intersection(spark, sf):
    *_, ca, cb = two_clusters(spark, sf)
    return X.intersection_edges(ca, cb).select("source", "target", "weight_a", "weight_b", "sign_a", "sign_b", "conflict_type", "weight")


EXCLUSIVE = "xa as (select node from na except select node from nb), xb as (select node from nb except select node from na)"


@query(f"with {NODES}, {EXCLUSIVE} select source, target, weight from ca where k not in (select k from cb) and source in (select node from xa) and target in (select node from xa)")
def so2_exclusive(spark, sf):
    _, _, na, nb, ca, cb = two_clusters(spark, sf)
    return X.exclusive_edges(ca, cb, na, nb).select("source", "target", "weight")


@query(f"with {NODES}, {EXCLUSIVE}, x as (select node from xa union all select node from xb) select source, target, weight, 'A' as side from ca where k not in (select k from cb) and source in (select node from x) and target in (select node from x) union all select source, target, weight, 'B' from cb where k not in (select k from ca) and source in (select node from x) and target in (select node from x)")
def so3_complement(spark, sf):
    _, _, na, nb, ca, cb = two_clusters(spark, sf)
    return X.complement_edges(ca, cb, na, nb).select("source", "target", "weight", "side")


@query(f"with {NODES}, {EXCLUSIVE} select node from xa union all select node from xb")
def so3_complement_nodes(spark, sf):
    _, _, na, nb, _, _ = two_clusters(spark, sf)
    return X.complement_nodes(na, nb)


@query(f"with {NODES}, {EXCLUSIVE}, ga as (select distinct unnest([source, target]) as node from ea), gb as (select distinct unnest([source, target]) as node from eb) select node, node in (select node from na) as in_cluster_a, node in (select node from nb) as in_cluster_b, node in (select node from ga) as in_graph_a, node in (select node from gb) as in_graph_b, case when node in (select node from na) then 'FURNITURE' else 'MACHINERY' end as present_in from (select node from xa union all select node from xb)")
def ex5_node_presence(spark, sf):
    a, b, na, nb, _, _ = two_clusters(spark, sf)
    return X.node_presence(na, nb, X.node_ids(a), X.node_ids(b), "FURNITURE", "MACHINERY")


@query(f"with {NODES} select source, target, weight from ca")
def jn11_subgraph(spark, sf):
    e = edges(spark, sf).where("condition = 'FURNITURE'")
    n = X.node_ids(e.where(F.abs("weight") >= 0.18)).withColumn("condition", F.lit("FURNITURE"))
    return N.induced(e, n).select("source", "target", "weight")


@query(f"with {EA} select 'FURNITURE' as condition, source, target, weight, 'correlation' as weight_type, case when weight > 0 then 'positive' when weight < 0 then 'negative' else 'neutral' end as sign, 'spearman' as method from ea")
def ex1_export_edges(spark, sf):
    return X.export_edges(one(edges(spark, sf), "FURNITURE"), "FURNITURE").select("condition", "source", "target", "weight", "weight_type", "sign", "method")


FORM = "'correlation' as weight_type, case when weight > 0 then 'positive' when weight < 0 then 'negative' else 'neutral' end as sign, null::double as p_value, 'pairwise_p_value' as evidence_type, weight as correlation, null::double as selection_stability, null::double as weight"


@query(f"with {NODES} select 'FURNITURE' as condition, source, target, {FORM} from ca union all select 'MACHINERY', source, target, {FORM} from cb")
def ex2_cluster_edges(spark, sf):
    _, _, _, _, ca, cb = two_clusters(spark, sf)
    return X.export_derived_edges(ca, "FURNITURE").unionByName(X.export_derived_edges(cb, "MACHINERY"))


@query(f"with {NODES}, {EXCLUSIVE}, x as (select node from xa union all select node from xb), v as (select 'exclusive' as view, 'FURNITURE' as condition, source, target, weight as w from ca where k not in (select k from cb) and source in (select node from xa) and target in (select node from xa) union all select 'exclusive', 'MACHINERY', source, target, weight from cb where k not in (select k from ca) and source in (select node from xb) and target in (select node from xb) union all select 'complement', 'FURNITURE', source, target, weight from ca where k not in (select k from cb) and source in (select node from x) and target in (select node from x) union all select 'complement', 'MACHINERY', source, target, weight from cb where k not in (select k from ca) and source in (select node from x) and target in (select node from x)) select view, condition, source, target, {FORM.replace('weight > 0', 'w > 0').replace('weight < 0', 'w < 0').replace('weight as correlation', 'w as correlation')} from v")
def ex3_derived_edges(spark, sf):
    """The exclusive and the complement edges of both clusters in the form of a download."""
    _, _, na, nb, ca, cb = two_clusters(spark, sf)
    side = F.when(F.col("side") == "A", "FURNITURE").otherwise("MACHINERY")
    parts = {"exclusive": X.export_derived_edges(X.exclusive_edges(ca, cb, na, nb), "FURNITURE").unionByName(X.export_derived_edges(X.exclusive_edges(cb, ca, nb, na), "MACHINERY")), "complement": X.export_derived_edges(X.complement_edges(ca, cb, na, nb), side)}
    return parts["exclusive"].withColumn("view", F.lit("exclusive")).unionByName(parts["complement"].withColumn("view", F.lit("complement")))


@query(f"with {NODES} select a.source, a.target, case when sign(a.weight) = sign(b.weight) then 'same sign' when a.weight < 0 then 'negative in FURNITURE → positive in MACHINERY' else 'positive in FURNITURE → negative in MACHINERY' end as relation from ca a join cb b using (k)")
def ex4_intersection_export(spark, sf):
    *_, ca, cb = two_clusters(spark, sf)
    return X.intersection_edges(ca, cb, "FURNITURE", "MACHINERY").select("source", "target", "relation")


# --- communities -----------------------------------------------------------------------------------

SEEDS = "seeds as (select condition, min(node) as node from deg group by 1)"
STEP = "select condition, node, sum(p) as p from (select condition, node, p * 0.85 / 2 as p from {0} union all select {0}.condition, mv.v, p * mm * 0.85 / 2 from {0} join mv on mv.condition = {0}.condition and mv.u = {0}.node union all select condition, node, 0.15 from seeds) group by 1, 2"
WALK = f"{DEG}, {SEEDS}, mv as (select condition, u, v, abs(weight) / sum(abs(weight)) over (partition by condition, u) as mm from adj), p0 as (select condition, node, 1.0::double as p from seeds), p1 as ({STEP.format('p0')}), p2 as ({STEP.format('p1')}), p3 as ({STEP.format('p2')}), sc as (select condition, node, round(p, 9) as p from p3)"
SWEEP = f"""{WALK}, tv as (select condition, sum(d) as total_volume from deg group by 1), mm as (select condition, count(*) as m from edges group by 1),
  rk as (select sc.*, coalesce(d, 0) as d, row_number() over (partition by sc.condition order by p / greatest(coalesce(d, 0), 1) desc, sc.node) as k from sc left join deg using (condition, node)),
  ins as (select e.condition, greatest(a.k, b.k) as k, sum(abs(weight)) as wi from edges e join rk a on a.condition = e.condition and a.node = e.source join rk b on b.condition = e.condition and b.node = e.target group by 1, 2),
  pre as (select rk.condition, rk.k, node, sum(d) over w as volume, sum(d - 2 * coalesce(wi, 0)) over w as cut, sum(p) over w as mass from rk left join ins using (condition, k) window w as (partition by rk.condition order by rk.k)),
  pf as (select pre.*, total_volume, m, cut / nullif(least(volume, total_volume - volume), 0) as score from pre join tv using (condition) join mm using (condition) where volume <= floor(total_volume / 2))"""


def seeds_of(e: DataFrame) -> DataFrame:
    return cut(N.degrees(e).groupBy("condition").agg(F.min("node").alias("node")), "seeds")


def walk(spark, sf):
    e = edges(spark, sf)
    s = seeds_of(e)
    return e, s, C.power_walk(e, s, 0.15, 3).withColumn("p", F.round("p", 9))


@query(f"with {WALK} select condition, node, round(p, 6) as p from sc")
def ppr_power_t(spark, sf):
    return walk(spark, sf)[2].select("condition", "node", F.round("p", 6).alias("p"))


@query(f"with {SWEEP} select condition, k::int as k, node, round(volume, 6) as volume, round(cut, 6) + 0.0 as cut, round(mass, 6) as mass, round(score, 6) as score from pf")
def gr4_sweep(spark, sf):
    e, _, p = walk(spark, sf)
    return C.sweep(e, p).select("condition", "k", "node", *[r6(c).alias(c) for c in ("volume", "cut", "mass", "score")])


LADDER = C.Ladder(phi=0.75, b=4, alpha=0.15, min_cut_size=3)


@query(
    f"""with {SWEEP}, sk as (select pf.condition, pf.k as sk from pf join seeds using (condition, node)),
  ad as (select pf.* from pf left join sk using (condition) where k >= greatest(3, coalesce(sk, 1))),
  rung as (select * from (values (0, 1, 8.0, 0.75, true), (1, 2, 8.0, 0.75, false), (2, 3, 4.0, 0.75, false), (3, 3, 2.0, 0.75, false), (4, 4, 8.0, 0.75 * 1.25, false), (5, 4, 8.0, 0.75 * 1.5, false), (6, 4, 8.0, 0.75 * 1.75, false), (7, 4, 8.0, 0.75 * 2.0, false)) as r(rung, step, fl, ph, mass_too)),
  tag as (select ad.*, rung, step, score as key from ad, rung where volume > fl and score < ph and (not mass_too or mass > 1.0 / (48 * ceil(log2(greatest(m, 2))))) 
    union all select ad.*, 8, 5, score / 0.75 + 0.5 * case when volume < 8 then log2(8 / volume) else 0 end - 0.1 * least(mass, 1) from ad where volume > 0),
  fs as (select *, min(rung) over (partition by condition) as fr from tag), bs as (select *, min(key) over (partition by condition) as best from fs where rung = fr),
  won as (select condition, step, min(k) as k from bs where case when step = 5 then key = best else key <= best * 1.1 end group by 1, 2)
  select s.condition, coalesce(won.step, 0)::int as step, coalesce(won.k, 1)::int as size, round(pf.score, 6) as score, round(pf.volume, 6) as volume from seeds s left join won using (condition) left join pf on pf.condition = s.condition and pf.k = won.k"""
)
def gr5_ladder(spark, sf):
    e, s, p = walk(spark, sf)
    return C.select(C.sweep(e, p), s, LADDER).select("condition", "step", F.col("size").cast("int").alias("size"), F.round("score", 6).alias("score"), F.round("volume", 6).alias("volume"))


MEMBERS = "mem as (select condition, node from deg where degree >= 8)"
JOINED = "j as (select adj.*, a.node is not null as iu, b.node is not null as iv from adj left join mem a on a.condition = adj.condition and a.node = adj.u left join mem b on b.condition = adj.condition and b.node = adj.v)"


def dense_members(e: DataFrame) -> DataFrame:
    return N.degrees(e).where("degree >= 8").select("condition", "node")


@query(f"with {DEG}, {MEMBERS}, {JOINED}, s as (select condition, coalesce(sum(abs(weight)) filter (where iu), 0) as volume, coalesce(sum(abs(weight)) filter (where iu and not iv), 0) as boundary, sum(abs(weight)) as total from j group by 1) select condition, round(volume, 6) as volume, round(boundary, 6) as boundary, case when abs(least(volume, total - volume)) < 1e-9 then 'infinite' else round(boundary / least(volume, total - volume), 6)::varchar end as conductance from s")
def ag12_conductance(spark, sf):
    e = edges(spark, sf)
    c = C.conductance(e, dense_members(e))
    least = F.least("volume", F.col("total") - F.col("volume"))
    return c.select("condition", F.round("volume", 6).alias("volume"), F.round("boundary", 6).alias("boundary"), F.when(F.abs(least) < 1e-9, "infinite").otherwise(F.round("conductance", 6).cast("string")).alias("conductance"))


@query(f"with {DEG}, {MEMBERS}, {JOINED} select condition, round(coalesce(sum(weight) filter (where weight > 0 and iu), 0), 6) as vol_pos, round(coalesce(sum(weight) filter (where weight > 0 and iu and not iv), 0), 6) as cut_pos, round(coalesce(-sum(weight) filter (where weight < 0 and iu and iv), 0) / 2, 6) + 0.0 as neg_inside, round(coalesce(-sum(weight) filter (where weight < 0 and iu and not iv), 0), 6) as neg_cut from j group by 1")
def ag14_signed_metrics(spark, sf):
    e = edges(spark, sf)
    return C.signed_composition(e, dense_members(e)).select("condition", *[r6(c).alias(c) for c in ("vol_pos", "cut_pos", "neg_inside", "neg_cut")])


@query(f"{STATS}, x as (select condition, node_count as n, count(*) as m from edges join nn using (condition) group by 1, 2), y as (select *, greatest(10, least(greatest(n // 3, 10), round_even(0.1 * n, 0))) as sz from x) select condition, greatest(1, least(greatest(1, floor(log2(greatest(2 * m, 2)))), round_even(log2(greatest(2.0, 2 * m / n * sz)), 0)))::int as b from y")
def sc13_default_b(spark, sf):
    return N.graph_stats(edges(spark, sf)).select("condition", C.default_b(F.col("node_count"), F.col("edge_count")).alias("b"))


@query(f"with {SWEEP} select condition, k::int as k, round(score / 0.75 + 0.5 * case when volume < 8 then log2(8 / volume) else 0 end - 0.1 * least(mass, 1), 6) as penalty from pf where volume > 0")
def sc18_penalty(spark, sf):
    e, _, p = walk(spark, sf)
    pf = C.sweep(e, p).where("volume > 0")
    return pf.select("condition", "k", F.round(C.penalty(F.col("score"), F.col("volume"), F.col("mass"), LADDER), 6).alias("penalty"))


@query()
def gr2_push(spark, sf):
    e = edges(spark, sf)
    runs = N.degrees(e).select(F.xxhash64("condition", "node").alias("run_id"), "condition", "node", F.lit(0.15).alias("alpha"), F.lit(1e-5).alias("epsilon"), F.lit(None).cast("long").alias("order_seed"))
    return C.push(e, runs)


@query(f"with {DEG} select condition, node as seed, 1.0::double as mass, 0.0::double as gap, true as under_bar, true as converged from deg")
def gr2_push_by_joins(spark, sf):
    """Every node of both graphs as a seed, all runs at once; the audit recomputes what must hold from p and r alone."""
    e = edges(spark, sf)
    runs = N.degrees(e).select(F.xxhash64("condition", "node").alias("run_id"), "condition", "node", F.lit(0.15).alias("alpha"), F.lit(1e-5).alias("epsilon"))
    found = WK.push_audit(e, runs, cut(WK.push_by_joins(e, runs, weighted=False), "pushed"), weighted=False)
    return found.select("condition", "seed", F.round("mass", 9).alias("mass"), r6("gap").alias("gap"), (F.col("over") < 1).alias("under_bar"), "converged")


@query(SQL["gr2_push_by_joins"])
def gr2_push_audit(spark, sf):
    """The same audit of the pushes in queue order."""
    e = edges(spark, sf)
    runs = N.degrees(e).select(F.xxhash64("condition", "node").alias("run_id"), "condition", "node", F.lit(0.15).alias("alpha"), F.lit(1e-5).alias("epsilon"), F.lit(None).cast("long").alias("order_seed"))
    found = WK.push_audit(e, runs, cut(C.push(e, runs, weighted=False), "pushed"), weighted=False)
    return found.select("condition", "seed", F.round("mass", 9).alias("mass"), r6("gap").alias("gap"), (F.col("over") < 1).alias("under_bar"), "converged")


@query()
def gr8_cluster(spark, sf):
    e = edges(spark, sf)
    return C.cluster(e, seeds_of(e), C.Ladder(b=4))[0]


@query(f"with {DEG}, {SEEDS} select condition, node as seed, true as seed_inside, true as size_told, true as within_half, 0.0::double as conductance_gap, true as push_converged from seeds")
def gr8_audit(spark, sf):
    """What must hold of every cluster, recomputed from its members and the graph: the seed is inside, the report's size and conductance are theirs, and they have half of the volume at most."""
    e = edges(spark, sf)
    s = seeds_of(e)
    found, _, report = C.cluster_with_report(e, s, C.Ladder(b=4))
    found = cut(found, "members")
    own = found.groupBy("condition").agg(F.count("*").alias("members"))
    inside = found.join(s, ["condition", "node"]).select("condition", F.lit(True).alias("seed_inside"))
    whole = C.conductance(e, found).select("condition", F.col("volume").alias("v"), "total", F.col("conductance").alias("c"))
    both = s.withColumnRenamed("node", "seed").join(report, "condition").join(own, "condition").join(inside, "condition", "left").join(whole, "condition")
    gap = F.when(F.col("step") == 0, 0.0).otherwise(r6(F.abs(F.col("c") - F.col("score"))))
    return both.select("condition", "seed", F.coalesce("seed_inside", F.lit(False)).alias("seed_inside"), (F.col("members") == F.col("size")).alias("size_told"), ((F.col("v") <= F.col("total") / 2) | (F.col("step") == 0)).alias("within_half"), gap.alias("conductance_gap"), "push_converged")


@query()
def gr9_signed_cluster(spark, sf):
    e = edges(spark, sf)
    return C.cluster(e, seeds_of(e), C.Ladder(b=4), signed=True)[1]


# --- stability over supplied clusters: runs are days of the event stream, nodes are users ------------

RUNS = "runs as (select distinct date_trunc('day', ts)::varchar as run_id, user_id::varchar as node from events)"


def runs_of(spark, sf) -> DataFrame:
    return demo.table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("user_id").cast("string").alias("node")).distinct()


RUNS = "runs as (select distinct strftime(ts, '%Y-%m-%d') as run_id, user_id::varchar as node from events)"


@query("select event_type, count(value) as count, round(avg(value), 6) as mean, round(median(value), 6) as median, min(value) as min, max(value) as max, round(quantile_cont(value, 0.05), 6) as p05, round(quantile_cont(value, 0.95), 6) as p95, round(stddev_pop(value), 6) as stdev from events group by 1")
def ag19_describe(spark, sf):
    d = T.describe(demo.table(spark, sf, "events"), "value", ["event_type"])
    return d.select("event_type", "count", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p05", "p95", "stdev")])


@query(f"with {RUNS}, sz as (select run_id, count(*) as n from runs group by 1), sh as (select a.run_id as ra, b.run_id as rb, count(*) as k from runs a join runs b using (node) where a.run_id < b.run_id group by 1, 2) select a.run_id as run_a, b.run_id as run_b, round(coalesce(k, 0) / (a.n + b.n - coalesce(k, 0)), 6) as jaccard from sz a join sz b on a.run_id < b.run_id left join sh on sh.ra = a.run_id and sh.rb = b.run_id")
def ag20_pairwise_jaccard(spark, sf):
    return T.pairwise_jaccard(runs_of(spark, sf)).select("run_a", "run_b", F.round("jaccard", 6).alias("jaccard"))


@query(f"with {RUNS}, n as (select count(distinct run_id) as n from runs) select node, count(*) as runs, round(count(*) / max(n), 6) as frequency, count(*) / max(n) >= 0.8 as consensus_80, count(*) / max(n) >= 0.9 as consensus_90, count(*) = max(n) as in_all from runs, n group by 1")
def ag22_consensus(spark, sf):
    return T.consensus(runs_of(spark, sf)).select("node", "runs", F.round("frequency", 6).alias("frequency"), "consensus_80", "consensus_90", "in_all")


@query(f"with {RUNS}, h as (select run_id, sha1(string_agg(node, chr(31) order by node))[:12] as h from runs group by 1), g as (select h, count(*) as n from h group by 1) select count(*) as distinct_clusters, max(n) as largest_group, sum(n)::bigint as runs from g")
def ag23_distinct_clusters(spark, sf):
    return T.distinct_clusters(runs_of(spark, sf))


@query("with nested as (select distinct l_suppkey as seed, p_size as node from lineitem join part on l_partkey = p_partkey where l_quantity >= 45), s as (select distinct seed from nested), p as (select a.seed as a, b.seed as b from s a join s b on a.seed < b.seed), f as (select p.*, exists (select 1 from nested n where n.seed = p.a and n.node = p.b) as x, exists (select 1 from nested n where n.seed = p.b and n.node = p.a) as y from p) select count(*) filter (where x and y) as \"both\", count(*) filter (where x and not y) as only_left, count(*) filter (where not x and y) as only_right, count(*) filter (where not x and not y) as neither from f")
def ag26_asymmetry(spark, sf):
    li, part = demo.table(spark, sf, "lineitem"), demo.table(spark, sf, "part")
    nested = li.where("l_quantity >= 45").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("seed"), F.col("p_size").cast("long").alias("node")).distinct()
    return T.asymmetry(nested)


@query(f"with {RUNS}, base as (select node from runs where run_id = (select min(run_id) from runs)), n as (select count(distinct run_id) as n from runs) select base.node, round(count(r.node) / max(n), 6) as support from base left join runs r using (node), n group by 1")
def ag25_support(spark, sf):
    r = runs_of(spark, sf)
    first = r.agg(F.min("run_id").alias("run_id"))
    return T.support(r, r.join(F.broadcast(first), "run_id").select("node")).select("node", F.round("support", 6).alias("support"))


JACCARD = "sz as (select run_id, count(*) as n from runs group by 1), sh as (select a.run_id as ra, b.run_id as rb, count(*) as k from runs a join runs b using (node) where a.run_id < b.run_id group by 1, 2), jac as (select a.run_id as run_a, b.run_id as run_b, coalesce(k, 0) as shared, coalesce(k, 0) / (a.n + b.n - coalesce(k, 0)) as j from sz a join sz b on a.run_id < b.run_id left join sh on sh.ra = a.run_id and sh.rb = b.run_id)"


@query(f"with {RUNS}, {JACCARD} select run_a as class_a, run_b as class_b, shared::int as shared, round(j, 6) as jaccard from jac where j >= 0.85 - 1e-9")
def ag20_similar_runs(spark, sf):
    """Pairs of different clusters with a Jaccard index of 0.85 or more; on these tables every cluster is a class of its own."""
    found = cut(ST.classes(runs_of(spark, sf)), "classes")
    return ST.similar_classes(found, 0.85).select("class_a", "class_b", "shared", r6("jaccard").alias("jaccard"))


@query(f"with {RUNS}, {JACCARD} select round(case when j >= 0.4 - 1e-9 then 0.4 + least(floor((j - 0.4) / 0.06 + 1e-9), 9) * 0.06 end, 6) as low, count(*) as pairs from jac group by 1")
def ag20_jaccard_histogram(spark, sf):
    return ST.jaccard_histogram(runs_of(spark, sf), 0.4).where("pairs > 0").select(F.round("low", 6).alias("low"), "pairs")


@query(f"with {RUNS}, per as (select node, count(*) as k from runs group by 1), n as (select count(distinct run_id) as n from runs) select max(n) as runs, count(*)::bigint as union_nodes, count(*) filter (where k = n)::bigint as intersection_nodes from per, n")
def ag21_union_and_intersection(spark, sf):
    return ST.union_and_intersection(runs_of(spark, sf))


@query(f"with {RUNS}, base as (select node from runs where run_id = (select min(run_id) from runs)), s as (select run_id, count(*) as size, count(base.node) as shared from runs left join base using (node) group by 1) select run_id, size, shared, round(shared / (size + (select count(*) from base) - shared), 6) as jaccard, size - shared as escaped from s")
def so7_against_base(spark, sf):
    r = cut(runs_of(spark, sf), "runs")
    first = r.agg(F.min("run_id").alias("run_id"))
    return ST.against_base(r, r.join(F.broadcast(first), "run_id").select("node")).select("run_id", "size", "shared", r6("jaccard").alias("jaccard"), "escaped")


@query("with nested as (select distinct l_suppkey as seed, p_size as node from lineitem join part on l_partkey = p_partkey where l_quantity >= 45), own as (select seed, bool_or(node = 3) as b, bool_or(node = seed) as s from nested group by 1) select count(*) as runs, round(count(*) filter (where b) / count(*), 6) as seed_recovery, round(count(*) filter (where s) / count(*), 6) as self_recovery from own")
def ag25_recovery(spark, sf):
    """Suppliers as seeds and the sizes they sell as their clusters, as in ag26; the base's seed is 3."""
    li, part = demo.table(spark, sf, "lineitem"), demo.table(spark, sf, "part")
    nested = li.where("l_quantity >= 45").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("seed"), F.col("p_size").cast("long").alias("node")).distinct()
    return ST.recovery(nested, 3).select("runs", F.round("seed_recovery", 6).alias("seed_recovery"), F.round("self_recovery", 6).alias("self_recovery"))


# --- scalar functions over real columns --------------------------------------------------------------


@query("select distinct p_type || ' / ' || p_brand as label, coalesce(nullif(trim(regexp_replace(lower(p_type || ' / ' || p_brand), '[^\\p{L}\\p{N}]', '_', 'g'), '_'), ''), 'condition') as slug from part")
def sc1_slug(spark, sf):
    from guildspark.functions.scalars import slug

    label = F.concat_ws(" / ", "p_type", "p_brand")
    return demo.table(spark, sf, "part").select(label.alias("label"), slug(label).alias("slug")).distinct()


@query("select distinct 'x; g__' || p_brand || ' |p_' || p_type || '_' as label, p_brand as genus, p_type as phylum from part")
def sc3_taxon(spark, sf):
    label = F.concat(F.lit("x; g__"), "p_brand", F.lit(" |p_"), "p_type", F.lit("_"))
    return demo.table(spark, sf, "part").select(label.alias("label"), A.taxon_of(label, "genus").alias("genus"), A.taxon_of(label, "phylum").alias("phylum")).distinct()


# --- matrix methods ------------------------------------------------------------------


def method_cells(spark, sf) -> DataFrame:
    """Brands of all segments of customers; the matrix methods get every sample and feature of them."""
    return S.in_condition(demo.bacteria(spark, sf), demo.conditions(spark, sf))


@query()
def md2_sparcc(spark, sf):
    return MD.sparcc(method_cells(spark, sf))


@query()
def md3_cclasso(spark, sf):
    return MD.cclasso(method_cells(spark, sf))


@query()
def md4_spieceasi(spark, sf):
    return MD.spieceasi(method_cells(spark, sf))


@query()
def md5_spring(spark, sf):
    return MD.spring(method_cells(spark, sf))


@query()
def stars_instability(spark, sf):
    picked = MD.selections(method_cells(spark, sf), MD.centred_logs, 20, 20, 1e-3, None, 4, 17)
    return MD.instability(picked, 20, 20)


# --- experiments ------------------------------------------------------------------------------------


@query()
def xp1_repeatability(spark, sf):
    e = edges(spark, sf, None)
    runs = XP.repeatability(e, seeds_of(e), C.Ladder(b=4))
    return T.consensus(runs)


@query()
def xp2_nested(spark, sf):
    e = edges(spark, sf)
    base, nested = XP.nested(e, seeds_of(e).where("condition = 'FURNITURE'"), C.Ladder(b=4))
    return T.support(nested, base)


@query()
def xp5_parameter_sweep(spark, sf):
    e = edges(spark, sf)
    return XP.parameter_sweep(e, seeds_of(e), C.Ladder(b=4), {"alpha": [0.05, 0.1], "phi": [0.4, 0.75]})


def _swept(mode: str, weight: str) -> str:
    """The prefixes of the fixed vectors in one weight mode, as tables whose names end in the mode."""
    return f"""dg_{mode} as (select condition, u as node, sum({weight}) as d from adj group by 1, 2), tv_{mode} as (select condition, sum(d) as total_volume from dg_{mode} group by 1),
  rk_{mode} as (select sc.*, coalesce(d, 0) as d, row_number() over (partition by sc.condition order by p / greatest(coalesce(d, 0), 1) desc, sc.node) as k from sc left join dg_{mode} using (condition, node)),
  ins_{mode} as (select e.condition, greatest(a.k, b.k) as k, sum({weight}) as wi from edges e join rk_{mode} a on a.condition = e.condition and a.node = e.source join rk_{mode} b on b.condition = e.condition and b.node = e.target group by 1, 2),
  pre_{mode} as (select r.condition, r.k, node, sum(d) over w as volume, sum(d - 2 * coalesce(wi, 0)) over w as cut, sum(p) over w as mass from rk_{mode} r left join ins_{mode} i on i.condition = r.condition and i.k = r.k window w as (partition by r.condition order by r.k)),
  pf_{mode} as (select pre_{mode}.*, '{mode}' as mode, m, cut / nullif(least(volume, total_volume - volume), 0) as score from pre_{mode} join tv_{mode} using (condition) join (select condition, count(*) as m from edges group by 1) using (condition) where volume <= floor(total_volume / 2))"""


#: One parameter at a time around the ladder of the queries.
SWEPT = {"phi": [0.2, 0.4, 0.75, 1.5], "b": [1, 4, 6], "min_cut_size": [1, 3, 8]}


def swept(spark, e: DataFrame, s: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The settings of SWEPT for the seeds of both networks and weight modes, and what each selects from the fixed vectors."""
    each = F.explode(F.array(F.lit("weighted"), F.lit("unweighted"))).alias("mode")
    vectors = p.select("*", each).withColumn("condition", F.concat_ws("/", "condition", "mode")).select("condition", "node", "p")
    prefixes = cut(C.sweep(XP.in_modes(e), vectors), "prefixes")
    settings = XP.sweep_settings(spark, LADDER, SWEPT)
    asked = cut(s.select("condition", "node", each).crossJoin(settings).withColumn("network", F.col("condition")).withColumn("condition", F.concat_ws("/", "condition", "mode")).withColumn("setting", F.xxhash64("condition", "node", "parameter", "value")), "settings")
    return asked, C.select_each(prefixes, asked)


@query(
    f"""with {WALK}, {_swept('weighted', 'abs(weight)')}, {_swept('unweighted', '1.0')},
  pf as (select * from pf_weighted union all select * from pf_unweighted),
  st as (select parameter, value, phi::double as phi, b, least_k from (values (null, null, 0.75, 4, 3), ('phi', 0.2, 0.2, 4, 3), ('phi', 0.4, 0.4, 4, 3), ('phi', 1.5, 1.5, 4, 3), ('b', 1.0, 0.75, 1, 3), ('b', 6.0, 0.75, 6, 3), ('min_cut_size', 1.0, 0.75, 4, 1), ('min_cut_size', 8.0, 0.75, 4, 8)) as s(parameter, value, phi, b, least_k)),
  runs as (select seeds.condition, seeds.node, mode, st.*, row_number() over () as run from seeds, (values ('weighted'), ('unweighted')) as x(mode), st),
  rung as (select * from (values (0, 1, 1.0, 1.0, true), (1, 2, 1.0, 1.0, false), (2, 3, 2.0, 1.0, false), (3, 3, 4.0, 1.0, false), (4, 4, 1.0, 1.25, false), (5, 4, 1.0, 1.5, false), (6, 4, 1.0, 1.75, false), (7, 4, 1.0, 2.0, false)) as r(rung, step, down, up, mass_too)),
  ad as (select runs.run, runs.phi, pow(2.0, runs.b - 1) as fl, pf.* from runs join pf on pf.condition = runs.condition and pf.mode = runs.mode left join pf own on own.condition = runs.condition and own.mode = runs.mode and own.node = runs.node where pf.k >= greatest(runs.least_k, coalesce(own.k, 1))),
  tag as (select ad.*, rung, step, score as key from ad, rung where volume > fl / down and score < phi * up and (not mass_too or mass > 1.0 / (48 * ceil(log2(greatest(m, 2)))))
    union all select ad.*, 8, 5, score / phi + 0.5 * case when volume < fl then log2(fl / volume) else 0 end - 0.1 * least(mass, 1) from ad where volume > 0),
  fs as (select *, min(rung) over (partition by run) as fr from tag), bs as (select *, min(key) over (partition by run) as best from fs where rung = fr),
  won as (select run, step, min(k) as k from bs where case when step = 5 then key = best else key <= best * 1.1 end group by 1, 2)
  select runs.parameter, runs.value::double as value, runs.condition as network, runs.mode, coalesce(won.step, 0)::int as step, coalesce(won.k, 1)::int as size, round(pf.score, 6) as score, round(pf.volume, 6) as volume
  from runs left join won using (run) left join pf on pf.condition = runs.condition and pf.mode = runs.mode and pf.k = won.k"""
)
def xp5_parameter_table(spark, sf):
    """Ladders as rows of a table over two networks in both weight modes, on fixed vectors."""
    e, s, p = walk(spark, sf)
    asked, found = swept(spark, e, s, p)
    return asked.join(found.select("setting", "step", "size", "score", "volume"), "setting").select("parameter", "value", "network", "mode", "step", F.col("size").cast("int").alias("size"), F.round("score", 6).alias("score"), F.round("volume", 6).alias("volume"))


@query(
    f"""with {WALK}, {_swept('weighted', 'abs(weight)')}, {_swept('unweighted', '1.0')},
  pf as (select * from pf_weighted union all select * from pf_unweighted),
  st as (select parameter, value, phi::double as phi, b, least_k from (values (null, null, 0.75, 4, 3), ('phi', 0.2, 0.2, 4, 3), ('phi', 0.4, 0.4, 4, 3), ('phi', 1.5, 1.5, 4, 3), ('b', 1.0, 0.75, 1, 3), ('b', 6.0, 0.75, 6, 3), ('min_cut_size', 1.0, 0.75, 4, 1), ('min_cut_size', 8.0, 0.75, 4, 8)) as s(parameter, value, phi, b, least_k)),
  runs as (select seeds.condition, seeds.node, mode, st.*, row_number() over () as run from seeds, (values ('weighted'), ('unweighted')) as x(mode), st),
  rung as (select * from (values (0, 1, 1.0, 1.0, true), (1, 2, 1.0, 1.0, false), (2, 3, 2.0, 1.0, false), (3, 3, 4.0, 1.0, false), (4, 4, 1.0, 1.25, false), (5, 4, 1.0, 1.5, false), (6, 4, 1.0, 1.75, false), (7, 4, 1.0, 2.0, false)) as r(rung, step, down, up, mass_too)),
  ad as (select runs.run, runs.phi, pow(2.0, runs.b - 1) as fl, pf.* from runs join pf on pf.condition = runs.condition and pf.mode = runs.mode left join pf own on own.condition = runs.condition and own.mode = runs.mode and own.node = runs.node where pf.k >= greatest(runs.least_k, coalesce(own.k, 1))),
  tag as (select ad.*, rung, step, score as key from ad, rung where volume > fl / down and score < phi * up and (not mass_too or mass > 1.0 / (48 * ceil(log2(greatest(m, 2)))))
    union all select ad.*, 8, 5, score / phi + 0.5 * case when volume < fl then log2(fl / volume) else 0 end - 0.1 * least(mass, 1) from ad where volume > 0),
  fs as (select *, min(rung) over (partition by run) as fr from tag), bs as (select *, min(key) over (partition by run) as best from fs where rung = fr),
  won as (select run, step, min(k) as k from bs where case when step = 5 then key = best else key <= best * 1.1 end group by 1, 2)
  select runs.parameter, runs.value::double as value, runs.condition as network, runs.mode, coalesce(won.step, 0)::int as step, case won.step when 4 then [0, 0, 0, 0, 1.25, 1.5, 1.75, 2.0][r.rung::int + 1] end::double as phi_relax_factor, case won.step when 3 then r.rung::int - 1 end::double as scale_relaxation, round(case won.step when 5 then pf.score / runs.phi end, 6) as penalty_quality,
  round(case won.step when 5 then case when pf.volume < pow(2.0, runs.b - 1) then 0.5 * log2(pow(2.0, runs.b - 1) / pf.volume) else 0 end end, 6) as penalty_volume, round(case won.step when 5 then -0.1 * least(pf.mass, 1) end, 6) as penalty_mass, (won.k - 1)::int as sweep_index
  from runs left join won using (run) left join (select distinct run, fr as rung from bs) r using (run) left join pf on pf.condition = runs.condition and pf.mode = runs.mode and pf.k = won.k"""
)
def gr6_relaxations(spark, sf):
    """What the ladder gave way in, for the settings, networks and modes of xp5_parameter_table."""
    e, s, p = walk(spark, sf)
    asked, found = swept(spark, e, s, p)
    told = C.relaxations(asked.drop("condition", "node").join(found.drop("condition", "node"), "setting"))
    return told.select("parameter", "value", "network", "mode", "step", "phi_relax_factor", r6("scale_relaxation").alias("scale_relaxation"), r6("penalty_quality").alias("penalty_quality"), r6("penalty_volume").alias("penalty_volume"), r6("penalty_mass").alias("penalty_mass"), F.col("sweep_index").cast("int").alias("sweep_index"))


@query(
    f"""with {WALK}, {_swept('unweighted', '1.0').replace('volume <= floor(total_volume / 2)', 'volume < floor(total_volume * 2 / 3)')}
  select condition, k::int as size, score, volume from pf_unweighted where volume > 4 and score < 0.9 and mass > 1.0 / (48 * ceil(log2(greatest(m, 2))))
  qualify row_number() over (partition by condition order by score, k) = 1"""
)
def gr3_legacy_nibble(spark, sf):
    e, _, p = walk(spark, sf)
    return C.legacy_nibble(e, p, phi=0.9, b=3)


@query(f"with {B}, sm as (select sample_id, row_number() over (order by sample_id) as rk, count(*) over () as t from (select distinct sample_id from b where value > 0)), ps as (select sample_id from sm where list_contains(list_transform(range(0, 40), lambda i: round_even(1 + i * (t - 1) / 39.0, 0)::bigint), rk)), c as (select * from b where value > 0 and sample_id in (select sample_id from ps)), g as (select feature, count(*) as k, sum(value) as v, min(value) as lo, max(value) as hi from c group by 1), vr as (select * from g where case when k < (select count(*) from ps) then least(lo, 0) else lo end <> case when k < (select count(*) from ps) then greatest(hi, 0) else hi end), fr as (select *, row_number() over (order by k, v, feature) as rk, count(*) over () as t from vr), pf as (select feature from fr where list_contains(list_transform(range(0, 9), lambda i: round_even(1 + i * (t - 1) / 8.0, 0)::bigint), rk)) select sample_id, feature, value from c where feature in (select feature from pf)")
def xp9_subset(spark, sf):
    return A.subset(demo.bacteria(spark, sf), 40, 9).select("sample_id", "feature", "value")


# --- what stands beside the graphs: reports, labels, scalar functions ---------------------------------


@query(f"with {EDGES} select condition, source, target, weight + 0.0 as weight from edges where weight > 0")
def flt18_positive_walk(spark, sf):
    return N.positive_walk(edges(spark, sf))


@query(f"with {REASONS}, x as (select feature from judged where len(reasons) > 0) select 'filtered' as reason, count(*) as dropped, (select string_agg(feature, ',' order by feature) from (select feature from x order by feature limit 50)) as items, count(*) > 50 as truncated from x")
def ag18_drop_events(spark, sf):
    judged = A.filter_taxa(demo.bacteria(spark, sf), FILTER)[1]
    return A.drop_events(judged.where(F.size("reasons") > 0), "filtered").withColumn("items", F.array_join("items", ","))


@query(f"with {RUNS}, n as (select count(distinct run_id) as n from runs), c as (select node, round_even(count(*) / max(n), 4) as frequency from runs, n group by 1) select frequency, count(*) as nodes from c group by 1")
def ag24_frequency_histogram(spark, sf):
    return T.frequency_histogram(runs_of(spark, sf))


@query(f"with {RUNS}, base as (select node from runs where run_id = (select min(run_id) from runs)) select run_id, count(*) filter (where node not in (select node from base)) as escaped from runs group by 1")
def ag25_escapes(spark, sf):
    r = runs_of(spark, sf)
    first = r.agg(F.min("run_id").alias("run_id"))
    return T.escapes(r, r.join(F.broadcast(first), "run_id").select("node"))


@query("select o_orderpriority as rule, count(*) as runs, round(count(*) / (select count(*) from orders), 6) as share from orders group by 1")
def ag27_condition_summary(spark, sf):
    return T.condition_summary(demo.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("rule"))).select("rule", "runs", F.round("share", 6).alias("share"))


TRIED = "select p_type as parameter, p_size::bigint as value, avg((p_size % 10 < 9)::int) as strict_rate, avg(p_retailprice) / 10000 as jaccard_above, max(p_retailprice) / 10000 as support_above from part group by 1, 2"


@query(f"with t as ({TRIED} union all select null, 0, 1, avg(p_retailprice) / 10000, avg(p_retailprice) / 10000 from part), s as (select *, case when strict_rate >= 0.9 then (jaccard_above + support_above) / 2 end as score from t), d as (select max(score) as base from s where parameter is null), r as (select *, row_number() over (partition by parameter order by score desc, value) as k from s where parameter is not null and score is not null) select parameter, value, round(score, 6) as score, round(score - base, 6) as gain from r, d where k = 1 and score > base")
def ag29_best_parameters(spark, sf):
    part = demo.table(spark, sf, "part")
    value, price = F.col("p_size").cast("long").alias("value"), F.avg("p_retailprice") / 10000
    tried = part.groupBy(F.col("p_type").alias("parameter"), value).agg(F.avg((F.col("p_size") % 10 < 9).cast("int")).alias("strict_rate"), price.alias("jaccard_above"), (F.max("p_retailprice") / 10000).alias("support_above"))
    default = part.agg(price.alias("jaccard_above")).select(F.lit(None).cast("string").alias("parameter"), F.lit(0).cast("long").alias("value"), F.lit(1.0).alias("strict_rate"), "jaccard_above", F.col("jaccard_above").alias("support_above"))
    found = T.best_parameters(T.stability_scores(tried.unionByName(default)))
    return found.select("parameter", "value", F.round("score", 6).alias("score"), F.round("gain", 6).alias("gain"))


@query("select distinct p_brand as brand, trim(regexp_replace(trim(' ' || p_type || '/' || p_brand || ' !'), '[^A-Za-z0-9._-]+', '_', 'g'), '_') as file_token, 'G' || substr(p_brand, 2) as display, p_brand as short_label from part")
def sc2_labels(spark, sf):
    from guildspark.functions import scalars as V

    part = demo.table(spark, sf, "part")
    path = F.concat(F.lit(" "), "p_type", F.lit("/"), "p_brand", F.lit(" !"))
    label = F.concat(F.lit("p_x; g__G"), F.substring("p_brand", 2, 100), F.lit("|z"))
    return part.select(F.col("p_brand").alias("brand"), V.file_token(path).alias("file_token"), V.display_taxon(label, "g").alias("display"), V.short_label(F.concat(F.lit("k_1;g_"), "p_brand")).alias("short_label")).distinct()


@query("select c_custkey as id, round(greatest(0, least(1, c_acctbal / 10000)), 6) as teleport, round(0.16 / (225 * ln(100 * sqrt(c_custkey + 1))), 12) as alpha, round(1 + 5 * least(1, abs(c_acctbal) / 5000), 6) as width, ceil(c_custkey % 100 / 100.0 * 37)::bigint as min_samples from customer")
def sc12_numbers(spark, sf):
    from guildspark.functions import scalars as V

    c = demo.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), V.teleport(F.col("c_acctbal") / 10000).alias("teleport"), F.round(V.theoretical_alpha(F.lit(0.4), F.col("c_custkey") + 1), 12).alias("alpha"), F.round(V.edge_width(F.col("c_acctbal"), F.lit(5000.0)), 6).alias("width"), V.min_samples(F.col("c_custkey") % 100, F.lit(37)).alias("min_samples"))


METHOD = "['spearman', 'sparcc', 'cclasso', 'spieceasi', 'spring'][1 + p_size % 5]"


@query(f"with x as (select distinct {METHOD} as method from part) select method, case method when 'spieceasi' then 'selection_stability' when 'spring' then 'latent_correlation' else 'correlation' end as weight_type, case when method in ('spieceasi', 'spring') then 'stars' when method = 'sparcc' then 'permutation_p_value' when method = 'cclasso' then 'bootstrap_p_value' else 'pairwise_p_value' end as evidence_type from x")
def sc21_evidence(spark, sf):
    from guildspark.functions.scalars import evidence_type, weight_type

    names = F.array(*[F.lit(m) for m in ("spearman", "sparcc", "cclasso", "spieceasi", "spring")])
    m = demo.table(spark, sf, "part").select(names[F.col("p_size") % 5].alias("method")).distinct()
    return m.select("method", weight_type(F.col("method")).alias("weight_type"), evidence_type(F.col("method")).alias("evidence_type"))


# --- lookups, reports of selections and metadata of two tables ----------------------------------------

LADDER_SQL = SQL["gr5_ladder"].rsplit("select s.condition", 1)[0]


@query(
    f"""{LADDER_SQL}, x as (select s.condition, coalesce(won.step, 0)::int as step, coalesce(pf.volume > 8 and pf.volume <= floor(pf.total_volume / 2), false) as volume_ok, coalesce(pf.mass > 1.0 / (48 * ceil(log2(greatest(pf.m, 2)))), false) as prob_ok, coalesce(pf.score < 0.75, false) as phi_ok from seeds s left join won using (condition) left join pf on pf.condition = s.condition and pf.k = won.k)
  select condition, step, case step when 0 then 'seed_singleton_fallback' when 1 then 'target_conductance' else 'target_conductance_fallback' end as strategy, volume_ok, prob_ok, phi_ok, volume_ok::int + prob_ok::int + phi_ok::int as conditions_met, array_to_string(list_filter([case when not volume_ok then 'volume_ok' end, case when not prob_ok then 'prob_ok' end, case when not phi_ok then 'phi_ok' end], lambda v: v is not null), ',') as failed, (select count(*) from ad where ad.condition = x.condition) as evaluated from x"""
)
def gr6_selection_report(spark, sf):
    e, s, p = walk(spark, sf)
    prefixes = cut(C.sweep(e, p), "prefixes")
    found = C.selection_report(prefixes, s, C.select(prefixes, s, LADDER), LADDER)
    return found.select("condition", "step", "strategy", "volume_ok", "prob_ok", "phi_ok", F.col("conditions_met").cast("int").alias("conditions_met"), F.array_join("failed_conditions", ",").alias("failed"), "evaluated")


def judged_orders(spark, sf) -> DataFrame:
    """Orders in the place of selection reports: status and price give step and conditions."""
    o = demo.table(spark, sf, "orders")
    step = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(4)
    return C.strict_flags(o.select("o_orderpriority", step.alias("step"), (F.col("o_totalprice") > 50000).alias("volume_ok"), (F.col("o_custkey") % 3 > 0).alias("prob_ok"), (F.col("o_orderkey") % 5 > 0).alias("phi_ok")))


JUDGED = "j as (select o_orderpriority, case o_orderstatus when 'P' then 'seed_singleton_fallback' when 'F' then 'target_conductance' else 'target_conductance_fallback' end as strategy, (o_totalprice > 50000)::int as v, (o_custkey % 3 > 0)::int as p, (o_orderkey % 5 > 0)::int as f from orders)"


@query(f"with {JUDGED} select o_orderpriority, count(*) as runs, count(*) filter (where strategy = 'target_conductance') as strict_success, round(avg((strategy = 'target_conductance')::int), 6) as strict_success_rate, count(*) filter (where strategy <> 'target_conductance') as fallback_runs, count(*) filter (where strategy = 'seed_singleton_fallback') as seed_singleton_runs, round(avg(v + p + f), 6) as conditions_met_mean, round(avg(v), 6) as volume_pass_rate, round(avg(p), 6) as prob_pass_rate, round(avg(f), 6) as phi_pass_rate from j group by 1")
def ag27_strict_summary(spark, sf):
    s = T.strict_summary(judged_orders(spark, sf), ["o_orderpriority"])
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(f"with {JUDGED}, s as (select 'strategy' as what, strategy as name from j union all select 'conditions_met', (v + p + f)::varchar from j union all select 'failed', 'volume_ok' from j where v = 0 union all select 'failed', 'prob_ok' from j where p = 0 union all select 'failed', 'phi_ok' from j where f = 0) select what, name, count(*) as runs from s group by 1, 2")
def ag27_strict_counts(spark, sf):
    return T.strict_counts(judged_orders(spark, sf))


SIZES = f"{STATS}, x as (select condition, node_count as n, count(*) as m from edges join nn using (condition) group by 1, 2), y as (select *, greatest(10, least(greatest(n // 3, 10), round_even(0.1 * n, 0))) as sz, ceil(log2(greatest(m, 2))) as lm from x), z as (select *, greatest(1, least(greatest(1, floor(log2(greatest(2 * m, 2)))), round_even(log2(greatest(2.0, 2 * m / n * sz)), 0)))::int as b from y)"


@query(f"{SIZES} select condition, n, m, 0.15::double as alpha, greatest(1, floor(log2(sqrt(n))))::int as b_min, greatest(1, ceil(log2(m)))::int as b_max, b, round(1 / (pow(2, b) * 48 * lm), 12) as epsilon from z")
def sc15_adaptive(spark, sf):
    a = C.adaptive(edges(spark, sf), conservative=True)
    return a.withColumn("alpha", F.round("alpha", 6)).withColumn("epsilon", F.round("epsilon", 12))


@query(f"{SIZES}, tv as (select condition, 2 * sum(abs(weight)) as total from edges group by 1) select condition, b, round(total, 6) as total_volume, pow(2, b - 1)::double as volume_min, floor(round(total / 2, 9))::bigint as volume_max, round(1 / (48 * lm), 9) as mass_threshold, round(1 / (pow(2, b) * 48 * lm), 12) as epsilon from z join tv using (condition)")
def xp7_thresholds(spark, sf):
    t = C.thresholds(edges(spark, sf), C.Ladder(b=None))
    return t.select("condition", "b", F.round("total_volume", 6).alias("total_volume"), "volume_min", "volume_max", F.round("mass_threshold", 9).alias("mass_threshold"), F.round("epsilon", 12).alias("epsilon"))


@query(f"with {EDGES}, near as (select condition, target as node from edges where source in (select min(source) from edges) union select condition, source from edges where target in (select min(source) from edges)) select condition, node from near")
def jn15_neighbours(spark, sf):
    e = edges(spark, sf)
    first = e.agg(F.min("source").alias("node"))
    return N.neighbours_of(e, e.select("condition").distinct().crossJoin(F.broadcast(first)))


@query(f'with {CELLS}, {ranks(PAIRS)} select condition, "right" as "left", "left" as "right", round(rho, 6) + 0.0 as rho from rho')
def jn8_pair_statistics(spark, sf):
    pairs = cut(rho(spark, sf).withColumn("p", F.lit(None).cast("double")), "pairs")
    turned = pairs.select("condition", F.col("right").alias("left"), F.col("left").alias("right"))
    return N.pair_statistics(turned, pairs).select("condition", "left", "right", r6("rho").alias("rho"))


@query(f"with {WALK}, r as (select condition, node, p, row_number() over (partition by condition order by p desc, node) as rank from sc) select condition, node, round(p, 6) as p, rank::int as rank from r where rank <= 5")
def tk2_top_nodes(spark, sf):
    top = N.top_nodes(walk(spark, sf)[2], 5)
    return top.withColumn("p", F.round("p", 6)).withColumn("rank", F.col("rank").cast("int"))


@query(f"{STATS}, ids as (select distinct condition, unnest([source, target]) as id from edges), f as (select condition, id from (select *, row_number() over (partition by condition order by id) as k from ids) where k <= 8) select e.condition, source, target, weight + 0.0 as weight from edges e where (e.condition, source) in (select (condition, id) from f) and (e.condition, target) in (select (condition, id) from f)")
def tk4_first_nodes(spark, sf):
    return N.first_nodes(edges(spark, sf), 8).select("condition", "source", "target", r6("weight").alias("weight"))


@query(f"{STATS}, ids as (select distinct condition, unnest([source, target]) as id from edges) select condition, bool_or(id = (select min(source) from edges)) as present from ids group by 1")
def jn16_seed_presence(spark, sf):
    e = edges(spark, sf)
    return N.seed_presence(N.nodes_of(e), e.agg(F.min("source")).first()[0])


@query(f"{STATS}, ids as (select distinct condition, unnest([source, target]) as id from edges) select id, max(condition) as condition from ids group by 1")
def jn17_selector_nodes(spark, sf):
    return N.selector_nodes(N.nodes_of(edges(spark, sf)), ["MACHINERY", "FURNITURE"]).select("id", "condition")


SECOND = "m2 as (select o_custkey as sample_id, max(o_orderpriority) as condition from orders group by 1)"


def second_metadata(spark, sf) -> DataFrame:
    return demo.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.max("o_orderpriority").alias("condition"))


@query(f"with {M}, {SECOND} select coalesce(m2.sample_id, m.sample_id) as sample_id, coalesce(m2.condition, m.condition) as condition from m2 full join m on m2.sample_id = m.sample_id")
def jn9_merged_metadata(spark, sf):
    """The second table fills what the first lacks: customers without an order keep their segment."""
    return A.merged_metadata(second_metadata(spark, sf), demo.conditions(spark, sf))


@query(f"with {M}, {B}, {FU} select m.condition, m.sample_id from m where sample_id in (select sample_id from b) and sample_id in (select sample_id from fu)")
def jn2_common_samples(spark, sf):
    meta = demo.conditions(spark, sf)
    return A.common_samples(meta, meta, demo.bacteria(spark, sf), demo.fungi(spark, sf))


@query(f"with {M}, {SECOND} select sample_id from m union select sample_id from m2")
def so4_known_samples(spark, sf):
    return A.known_samples(demo.conditions(spark, sf), second_metadata(spark, sf))


@query("select o_orderpriority as condition, count(*) filter (where o_orderstatus = 'F') as selected_edges, round(coalesce(avg(o_totalprice) filter (where o_orderstatus = 'F'), 0), 4) as mean_edge_stability from orders group by 1")
def ag17_mean_stability(spark, sf):
    o = demo.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("condition"), F.col("o_totalprice").cast("double").alias("rho"), (F.col("o_orderstatus") == "F").alias("selected"))
    return T.mean_stability(o).withColumn("mean_edge_stability", F.round("mean_edge_stability", 4))


@query(f"with {RHO} select condition, \"left\" as \"row\", \"right\" as \"column\", round(rho, 6) + 0.0 as cor, 'correlation' as weight_type, 'pairwise_p_value' as evidence_type from rho")
def snk1_pair_table(spark, sf):
    from guildspark.sources.sinks import pair_table

    t = pair_table(rho(spark, sf).withColumn("p", F.lit(None).cast("double")), "spearman")
    return t.select("condition", "row", "column", r6("cor").alias("cor"), "weight_type", "evidence_type")


@query("with s as (select o_orderpriority as condition, count(*) as runs, avg(o_totalprice) as mean, bool_or(o_orderstatus = 'F') as strict from orders group by 1) select condition, 'runs' as name, printf('%.4f', runs::double) as value from s union all select condition, 'strict', case when strict then 'Yes' else 'No' end from s union all select condition, 'nothing', 'Not applicable' from s")
def ex6_summary_rows(spark, sf):
    from guildspark.sources.sinks import summary_rows

    s = demo.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("condition")).agg(F.count("*").alias("runs"), F.bool_or(F.col("o_orderstatus") == "F").alias("strict"))
    return summary_rows(s.withColumn("nothing", F.lit(None).cast("double")).withColumn("grouping_mode", F.lit("all")))
