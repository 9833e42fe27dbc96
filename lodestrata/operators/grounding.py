"""Anchors against current source, citations, provenance, drift. Rows are marked, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def revalidate(anchors: DataFrame, spans: DataFrame, files: DataFrame) -> DataFrame:
    """anchors with `state` by the current source.

    anchors: anchor_id, target_path, line_start, line_end, stored_hash. spans:
    path, line_start, line_end, span_hash of the current source. files: path,
    readable. Same place and hash: live. Same place, another hash: stale. The
    hash elsewhere: moved. The file there and not readable: unknown. Nothing, or the file gone: orphaned.
    """
    here = spans.select(F.col("path").alias("target_path"), "line_start", "line_end", F.col("span_hash").alias("now_hash")).distinct()
    somewhere = spans.select(F.col("span_hash").alias("stored_hash")).distinct().withColumn("found", F.lit(True))
    known = files.groupBy(F.col("path").alias("target_path")).agg(F.max("readable").alias("readable"))
    told = anchors.join(here, ["target_path", "line_start", "line_end"], "left").join(somewhere, "stored_hash", "left").join(known, "target_path", "left")
    state = (
        F.when(F.col("now_hash") == F.col("stored_hash"), "live")
        .when(F.col("found"), "moved")
        .when(F.col("now_hash").isNotNull(), "stale")
        .when(~F.col("readable"), "unknown")
        .otherwise("orphaned")
    )
    return told.select(*anchors.columns, state.alias("state"))


def check_citations(citations: DataFrame, files: DataFrame) -> DataFrame:
    """citations (answer_id, pos, path, line_start, line_end, state) with `status`.

    ok: the span exists and its anchor is live. missing_file, out_of_range and
    not_live are the flags; bad_span is one that ends before it starts.
    """
    lines = files.select("path", "n_lines")
    told = citations.join(lines, "path", "left")
    status = (
        F.when((F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")), "bad_span")
        .when(F.col("n_lines").isNull(), "missing_file")
        .when(F.col("line_end") > F.col("n_lines"), "out_of_range")
        .when(~F.col("state").eqNullSafe("live"), "not_live")
        .otherwise("ok")
    )
    return told.withColumn("status", status)


def gate_answers(checked: DataFrame, strict: bool = False) -> DataFrame:
    """Per answer its citations, how many are good, and the verdict: cited, flagged or (strict) refused."""
    bad = F.when(F.lit(strict), "refused").otherwise("flagged")
    out = checked.groupBy("answer_id").agg(F.count("*").alias("n_citations"), F.count_if(F.col("status") == "ok").alias("n_ok"))
    return out.withColumn("verdict", F.when(F.col("n_ok") == F.col("n_citations"), "cited").otherwise(bad))


def sentence_actions(sentences: DataFrame) -> DataFrame:
    """sentences (answer_id, pos, n_citations, n_ok) with an action, and the answer's.

    All citations good: keep. Some bad: strip and flag. None: annotate as
    unverifiable. An answer with no good citation at all is refused.
    """
    act = F.when(F.col("n_citations") == 0, "annotate").when(F.col("n_ok") == F.col("n_citations"), "keep").otherwise("strip_and_flag")
    anchored = sentences.groupBy("answer_id").agg((F.max("n_ok") > 0).alias("anchored"))
    return sentences.withColumn("action", act).join(anchored, "answer_id").withColumn("answer_action", F.when(F.col("anchored"), "answer").otherwise("refuse")).drop("anchored")


def provenance_packets(evidence: DataFrame) -> DataFrame:
    """One packet per answer from rows (answer_id, project_id, source_id, citation, commit_sha, session_id, confidence, type, label)."""
    sets = {f"{c}s": F.array_sort(F.collect_set(c)) for c in ("project_id", "source_id", "citation", "commit_sha", "session_id")}
    parts = F.array_sort(F.collect_list(F.struct("type", "label", F.col("citation").alias("resource_ref"), "confidence")))
    return evidence.groupBy("answer_id").agg(*[v.alias(k) for k, v in sets.items()], F.round(F.min("confidence"), 6).alias("confidence"), parts.alias("evidence"))


def freshness(head: Column, recorded: Column, dirty: Column) -> Column:
    """unknown without a recorded commit, dirty with uncommitted changes, lagging behind head, else fresh."""
    return F.when(recorded.isNull() | head.isNull(), "unknown").when(dirty, "dirty").when(head != recorded, "lagging").otherwise("fresh")


def drift_rank(items: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """items (key, authority, recency, agreement in [0, 1]) by their product, each to the power of its weight (feature, weight).

    Weights may hold other features, which are not read; a feature without a weight
    counts once, one with several is refused.
    """
    features = ("authority", "recency", "agreement")
    told = weights.where(F.col("feature").isin(*features)).groupBy("feature").agg(F.first("weight").alias("weight"), F.count("*").alias("n")).collect()
    if twice := sorted(r.feature for r in told if r.n > 1):
        raise ValueError(f"more than one weight of {', '.join(twice)}")
    w = {r.feature: 1.0 if r.weight is None else r.weight for r in told}
    score = F.lit(1.0)
    for f in features:
        score = score * F.pow(F.col(f), F.lit(float(w.get(f, 1.0))))
    return items.withColumn("score", F.round(score, 6))


def refresh_action(ownership: Column, changed: Column) -> Column:
    """What a refresh may do: owned files merge, foreign ones are never written, supplemental ones get a name space."""
    return F.when(~changed, "none").when(ownership == "owned", "three_way_merge").when(ownership == "foreign", "never_overwrite").when(ownership == "supplemental", "write_namespaced").otherwise("refuse")


def trust_metrics(checked: DataFrame, gold: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: citation precision and recall, grounding correctness and what it missed, and false confidence.

    checked: citations with status and state. gold: the (answer_id, path) that each
    answer ought to cite; recall is the share of them among its good citations.
    claims: (answer_id, pos, supported, flagged); correctness is the share of unsupported
    claims that were flagged. With nothing to find a share is 1, with nothing that
    claims to be live false confidence is 0.
    """
    told = citation_quality(checked).select("precision", "false_confidence")
    good = checked.where("status = 'ok'").select("answer_id", "path").distinct().withColumn("found", F.lit(True))
    of_gold = gold.select("answer_id", "path").distinct().join(good, ["answer_id", "path"], "left").agg(F.count("*").alias("n_gold"), F.count("found").alias("n_found"))
    bare = claims.agg(F.count_if(~F.col("supported")).alias("n_unsupported"), F.count_if(~F.col("supported") & F.col("flagged")).alias("n_flagged"), F.count_if(F.col("supported") & F.col("flagged")).alias("wrongly_flagged"))
    share = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.round(F.col(a) / F.col(b), 6))
    one = told.crossJoin(of_gold).crossJoin(bare)  # one row each
    return one.select("precision", share("n_found", "n_gold").alias("recall"), share("n_flagged", "n_unsupported").alias("grounding_correctness"), (F.col("n_unsupported") - F.col("n_flagged")).alias("unflagged"), "wrongly_flagged", "false_confidence")


def citation_quality(checked: DataFrame) -> DataFrame:
    """Share of good citations, and of those that claim to be live and are not good."""
    live = F.col("state").eqNullSafe("live")
    out = checked.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("good"), F.count_if(live).alias("live"), F.count_if(live & (F.col("status") != "ok")).alias("false_live"))
    share = lambda a, b, empty: F.when(F.col(b) == 0, empty).otherwise(F.round(F.col(a) / F.col(b), 6))
    return out.select("n", "good", share("good", "n", 1.0).alias("precision"), share("false_live", "live", 0.0).alias("false_confidence"))
