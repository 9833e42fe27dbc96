"""Many projects at once: gates, fusion, envelopes that name what is left out, cross-project names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas

#: File extensions that are no part of a qualified name.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "py", "go", "rs", "java", "rb", "c", "h", "cpp", "cs", "php", "kt", "swift")


def stamp_gate(projects: DataFrame, expected: DataFrame) -> DataFrame:
    """projects (project_id, embedding_model, dimension, schema_version) with `reason`, null if the project's own stamp is as expected.

    expected has one row of the same three columns; repeats of it count once, two
    that differ are refused, and without any no project is as expected.
    """
    wanted = expected.select("embedding_model", "dimension", "schema_version").distinct().take(2)
    if len(wanted) > 1:
        raise ValueError("more than one expected stamp")
    reason = F.when(F.col("schema_version").isNull(), "no_stamp")
    for c in ("schema_version", "embedding_model", "dimension"):
        reason = reason.when(~F.col(c).eqNullSafe(F.lit(wanted[0][c] if wanted else None)), f"{c}_mismatch")
    return projects.withColumn("reason", reason)


def envelope(requested: DataFrame, gated: DataFrame) -> DataFrame:
    """(project_id, answered, reason) for every project asked for; unknown ones are named too."""
    told = requested.select("project_id").distinct().join(gated.select("project_id", "reason").withColumn("known", F.lit(True)), "project_id", "left")
    reason = F.when(F.col("known").isNull(), "not_registered").otherwise(F.col("reason"))
    return told.select("project_id", reason.isNull().alias("answered"), reason.alias("reason"))


def excluded(requested: DataFrame, answered: DataFrame) -> DataFrame:
    return requested.select("project_id").distinct().join(answered, "project_id", "left_anti")


def apply_policy(rows: DataFrame, policies: DataFrame, project: str = "project_id") -> DataFrame:
    """rows with denied and denied_reason: hidden unless the project has a policy that is visible; nothing is dropped."""
    p = policies.select(F.col("project_id").alias(project), "federation_visible")
    told = rows.join(p, project, "left")
    reason = F.when(F.col("federation_visible").isNull(), "no_policy").when(~F.col("federation_visible"), "not_visible")
    return told.withColumn("denied_reason", reason).withColumn("denied", F.col("denied_reason").isNotNull()).drop("federation_visible")


def denied_markers(denied: DataFrame, project: str = "project_id") -> DataFrame:
    """One marker per denied project in place of its rows."""
    return denied.where("denied").groupBy(project, "denied_reason").agg(F.count("*").alias("n_hidden")).withColumn("denied", F.lit(True))


def capped(items: DataFrame, order: list[str | Column], cap: int = schemas.MAX_RESPONSE_ITEMS) -> tuple[DataFrame, DataFrame]:
    """At most cap items, and one row that says whether more were there."""
    first = items.orderBy(*order).limit(cap + 1)
    return first.orderBy(*order).limit(cap), first.agg((F.count("*") > cap).alias("truncated"))


def segments(name: Column) -> Column:
    """Parts of a qualified name between ::, . and /, without file extensions."""
    parts = F.filter(F.split(name, r"::|\.|/", -1), lambda x: x != "")
    kept = F.filter(parts, lambda x: ~x.isin(*EXTENSIONS))
    return F.when(F.size(kept) > 0, kept).otherwise(parts)


def resolve_names(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, n_candidates, status, resolved) of references against exported names of other projects.

    A node is a candidate if the reference's segments, or those of one of its own
    listed candidates, are the last segments of the node's qualified name. One:
    resolved. More: ambiguous, none is picked. None: no match.

    Names are counted once for each of their endings, and references are joined to
    the ending they say as a whole, so a leaf that very many nodes share is one row.
    Of a reference's names one that ends in another adds no candidate; the others'
    candidates can't be the same, so counts add up.
    """
    listed = F.coalesce(F.from_json("candidates", "array<string>"), F.array().cast("array<string>"))
    said = F.filter(F.transform(F.array_union(F.array("reference_name"), listed), segments), lambda w: F.size(w) > 0)
    ends_in = lambda w, x: (F.size(x) < F.size(w)) & (F.slice(w, F.size(w) - F.size(x) + 1, F.size(x)) == x)
    asked = refs.select("ref_id", F.array_distinct(said).alias("all")).select("ref_id", F.explode(F.filter("all", lambda w: ~F.exists("all", lambda x: ends_in(w, x)))).alias("ending"))
    have = nodes.where("is_exported").select("node_id", "qualified_name", segments(F.col("qualified_name")).alias("have")).where(F.size("have") > 0)
    endings = have.select("node_id", "qualified_name", F.explode(F.transform(F.sequence(F.lit(1), F.size("have")), lambda k: F.slice("have", -k, k))).alias("ending"))
    counted = endings.groupBy("ending").agg(F.count_distinct("node_id").alias("n"), F.min("qualified_name").alias("only"))
    hits = asked.distinct().join(counted, "ending").groupBy("ref_id").agg(F.sum("n").alias("n"), F.min("only").alias("only"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    status = F.when(n == 1, "RESOLVED").when(n > 1, "AMBIGUOUS").otherwise("NO_MATCH")
    return refs.select("ref_id").distinct().join(hits, "ref_id", "left").select("ref_id", n.alias("n_candidates"), status.alias("status"), F.when(n == 1, F.col("only")).alias("resolved"))


def side_by_side(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, status, candidate): what is shown where nothing is picked, each candidate of an ambiguous reference in a row of its own."""
    told = resolve_names(refs, nodes)
    listed = F.coalesce(F.from_json("candidates", "array<string>"), F.array().cast("array<string>"))
    asked = refs.join(told.where("status = 'AMBIGUOUS'").select("ref_id", "status"), "ref_id").select("ref_id", "status", F.explode(F.array_union(F.array("reference_name"), listed)).alias("said"))
    wanted = asked.select("ref_id", "status", segments(F.col("said")).alias("ending")).where(F.size("ending") > 0)
    have = nodes.where("is_exported").select("qualified_name", segments(F.col("qualified_name")).alias("have")).where(F.size("have") > 0)
    endings = have.select("qualified_name", F.explode(F.transform(F.sequence(F.lit(1), F.size("have")), lambda k: F.slice("have", -k, k))).alias("ending"))
    return wanted.join(endings, "ending").select("ref_id", "status", F.col("qualified_name").alias("candidate")).distinct()


def resolution_quality(resolved: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of precision, recall and forced picks of resolve_names' result against truth (ref_id, kind, expected).

    expected is null where nothing may be picked; a pick for an ambiguous one is forced.
    """
    told = truth.join(resolved, "ref_id", "left")
    picked, right = F.col("resolved").isNotNull(), F.col("resolved") == F.col("expected")
    counts = told.agg(F.count_if(picked & right).alias("correct"), F.count_if(picked).alias("picked"), F.count_if(F.col("expected").isNotNull()).alias("resolvable"), F.count_if(picked & (F.col("kind") == "ambiguous")).alias("forced_picks"))
    return counts.select("correct", "picked", "resolvable", "forced_picks", F.round(F.try_divide("correct", "picked"), 3).alias("precision"), F.round(F.try_divide("correct", "resolvable"), 3).alias("recall"))


def one_model(rows: DataFrame, by: str, model: str, vector: str) -> DataFrame:
    """Per generation its models and vector lengths, and whether it holds one of each."""
    out = rows.groupBy(by).agg(F.count_distinct(model).alias("n_models"), F.count_distinct(F.size(vector)).alias("n_dimensions"))
    return out.withColumn("uniform", (F.col("n_models") == 1) & (F.col("n_dimensions") == 1))


def model_change(old_model: Column, new_model: Column, old_dim: Column, new_dim: Column) -> Column:
    """What a change of embedding model means for a generation."""
    return F.when(old_dim != new_dim, "rebuild").when(old_model != new_model, "reembed").otherwise("keep")


def common(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys that both sides have."""
    return a.select(*keys).intersect(b.select(*keys))
