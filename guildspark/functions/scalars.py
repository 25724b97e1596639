"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    """Lower-case letters and digits, `_` for all else, none at the ends; `condition` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", ""), F.lit("")), F.lit("condition"))


def file_token(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def display_taxon(c: Column, prefix: str) -> Column:
    """Display variant: tokens are also cut at white space, and `x_` or `x__` is removed."""
    tokens = F.filter(F.split(c, r"[;,|\s]+"), lambda t: F.startswith(F.lower(t), F.lit(f"{prefix}_")))
    return F.nullif(F.regexp_replace(F.get(tokens, F.lit(0)), f"(?i)^{prefix}__?", ""), F.lit(""))


def short_label(c: Column) -> Column:
    """What follows `g_`, or the whole label."""
    at = F.instr(c, "g_")
    return F.when(at > 0, F.substring(c, at + 2, F.length(c))).otherwise(c)


def finite(c: Column) -> Column:
    """Null for NaN and infinities, for JSON."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(finite(c), digits)


def weight_type(method: Column) -> Column:
    """What a method's weights are."""
    return F.when(method == "spieceasi", "selection_stability").when(method == "spring", "latent_correlation").otherwise("correlation")


def evidence_type(method: Column) -> Column:
    """What a method's edges rest on."""
    return F.when(method.isin("spieceasi", "spring"), "stars").when(method == "sparcc", "permutation_p_value").when(method == "cclasso", "bootstrap_p_value").otherwise("pairwise_p_value")


def teleport(c: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6)


def min_samples(percent: Column, n: Column) -> Column:
    return F.ceil(percent / 100 * n)


def theoretical_alpha(phi: Column, m: Column) -> Column:
    return phi * phi / (225 * F.log(100 * F.sqrt(m)))


def edge_width(weight: Column, most: Column) -> Column:
    return 1 + 5 * F.least(F.lit(1.0), F.abs(weight) / F.when(most > 0, most).otherwise(1.0))


def node_border(ratio: Column, most: Column) -> Column:
    """Width of a node's border by its overabundance; a ratio that is not a positive number counts as 1, a tenth of the most is the least."""
    safe = F.when((ratio > 0) & (ratio < float("inf")), ratio).otherwise(1.0)
    return 0.8 + 3 * F.greatest(F.lit(0.1), F.least(F.lit(1.0), safe / F.greatest(F.lit(1.0), most)))


def weight_column(kind: Column) -> Column:
    """The name under which weights of a type are exported."""
    return F.when(kind == "selection_stability", "selection_stability").when(kind == "mixed", "weight").otherwise("correlation")


def threshold_label(method: Column) -> Column:
    """What the least weight of a graph bounds."""
    return F.when(method == "spieceasi", "minimum_stars_edge_stability").otherwise("minimum_absolute_correlation")
