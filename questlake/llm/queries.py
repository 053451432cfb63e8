"""Named queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questlake.functions.scalars import promoted
from questlake.llm import distinct, language, leakage, packing, quantiles
from questlake.sources.ods import table
from questlake.workspace import materialise, new_folder

PERCENTILES = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
#: Values held per section; up to 6·K values are exact, beyond them ranks are off by at most about 0.6 % of the share above.
K_QUANTILE = 128
#: Hashes held per group; counts up to it are exact, beyond it the relative standard error is 1.6 %.
K_DISTINCT = 4096
CAPACITY = 2048


def _values(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ods_player_events")
    filled = t.select(
        "server_id", F.to_date("event_time").alias("dt"),
        promoted(F.col("online_sec"), F.col("payload"), "online_sec", "int").cast("bigint").alias("online_sec"),
        promoted(F.col("amount_fen"), F.col("payload"), "amount_fen", "bigint").alias("amount_fen"),
    )
    either = filled.where("online_sec IS NOT NULL OR amount_fen IS NOT NULL")
    pair = F.explode(F.array(F.struct(F.lit("online_sec").alias("metric"), F.col("online_sec").alias("value")), F.struct(F.lit("amount_fen").alias("metric"), F.col("amount_fen").alias("value"))))
    return either.select("server_id", "dt", pair.alias("m")).select("server_id", "dt", "m.metric", "m.value").where("value IS NOT NULL")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per metric, server and day, and per metric and server from the days' sketches."""
    keys = ["metric", "server_id", "dt"]
    # kept in the shared folder, as a day's sketches would be
    days = materialise(quantiles.sketch_groups(_values(spark, d), keys, "value", K_QUANTILE), new_folder(spark, "quantiles"))
    servers = quantiles.merge_groups(days, keys[:2], K_QUANTILE)
    by_day = quantiles.percentiles(days, keys, PERCENTILES, K_QUANTILE).withColumn("grain", F.lit("server_day"))
    by_server = quantiles.percentiles(servers, keys[:2], PERCENTILES, K_QUANTILE).withColumn("dt", F.lit(None).cast("date")).withColumn("grain", F.lit("server"))
    return by_day.unionByName(by_server)


def p3_rank_error(spark: SparkSession, d: str, k: int = 16) -> DataFrame:
    """Whether each percentile of sketches that must compact (k = 16, days merged to servers) keeps the stated rank error, against exact ranks."""
    keys = ["metric", "server_id"]
    values = _values(spark, d)
    days = quantiles.sketch_groups(values, [*keys, "dt"], "value", k)
    wide = materialise(quantiles.percentiles(quantiles.merge_groups(days, keys, k), keys, PERCENTILES, k), new_folder(spark, "ranks"))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("percentile"), F.lit(p).alias("p"), F.col(n).alias("found")) for n, p in PERCENTILES.items())))
    told = wide.select(*keys, "n", "rank_error", pairs.alias("x")).select(*keys, "n", "rank_error", "x.*")
    # a few values a group beside every row: the sketch's answers, not the data
    same = F.col("v.metric").eqNullSafe(F.col("s.metric")) & F.col("v.server_id").eqNullSafe(F.col("s.server_id"))
    ranked = values.alias("v").join(told.alias("s"), same).groupBy("s.metric", "s.server_id", "s.percentile", "s.p", "s.n", "s.rank_error").agg(
        F.count_if(F.col("v.value") < F.col("s.found")).alias("below"), F.count_if(F.col("v.value") <= F.col("s.found")).alias("upto")
    )
    want = F.ceil(F.col("p") * F.col("n") - 1e-9)
    off = F.greatest(F.col("below") + 1 - want, want - F.col("upto"), F.lit(0))
    return ranked.select("metric", "server_id", "percentile", "n", (off <= F.col("rank_error") * F.col("n") + 1).alias("within"))


def _players(spark: SparkSession, d: str) -> DataFrame:
    return distinct.sketch_groups(table(spark, d, "dws_player_behavior_di"), ["dt", "server_id"], "player_id", K_DISTINCT)


def p6_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct players per day and server, per day, per server, and of each server's day against the day before."""
    base = materialise(_players(spark, d), new_folder(spark, "distinct"))
    cols = ["kind", "dt", "server_id", "estimate", "lower", "upper"]
    days = distinct.merge_groups(base, ["dt"], K_DISTINCT)
    servers = distinct.merge_groups(base, ["server_id"], K_DISTINCT)
    before = base.select("server_id", F.date_add("dt", 1).alias("dt"), F.col("theta").alias("theta2"), F.col("hashes").alias("hashes2"))
    pairs = distinct.set_counts(base.join(before, ["server_id", "dt"]), ["dt", "server_id"], K_DISTINCT)
    name = F.create_map(*(F.lit(x) for kv in {"both": "returned", "either": "two_days", "only_first": "new", "only_second": "lost"}.items() for x in kv))
    return (
        distinct.counts(base, ["dt", "server_id"], "server_day", K_DISTINCT).select(cols)
        .unionByName(distinct.counts(days, ["dt"], "day", K_DISTINCT).withColumn("server_id", F.lit(None).cast("int")).select(cols))
        .unionByName(distinct.counts(servers, ["server_id"], "server", K_DISTINCT).withColumn("dt", F.lit(None).cast("date")).select(cols))
        .unionByName(pairs.withColumn("kind", F.element_at(name, F.col("kind"))).select(cols))
    )


def p6_dau(spark: SparkSession, d: str) -> DataFrame:
    """The published DAU beside the estimate: agrees if it lies within the bounds."""
    est = distinct.counts(_players(spark, d), ["dt", "server_id"], "server_day", K_DISTINCT)
    published = table(spark, d, "ads_dau_di").where(F.lower(F.trim("metric_id")) == "ads_dau_di").select("dt", "server_id", "dau")
    both = est.join(published, ["dt", "server_id"], "full")
    return both.select("dt", "server_id", "estimate", "lower", "upper", "dau", F.coalesce(F.col("dau").between(F.col("lower"), F.col("upper")), F.lit(False)).alias("agrees"))


def p6_bounds(spark: SparkSession, d: str, k: int = 64) -> DataFrame:
    """Whether the exact counts lie in the bounds (four deviations) of sketches that hold only 64 hashes: days, servers, and servers merged to days."""
    rows = table(spark, d, "dws_player_behavior_di").where("player_id IS NOT NULL")
    base = materialise(distinct.sketch_groups(rows, ["dt", "server_id"], "player_id", k), new_folder(spark, "bounds"))
    out = None
    for kind, keys in (("server_day", ["dt", "server_id"]), ("day", ["dt"]), ("server", ["server_id"])):
        told = distinct.counts(base if len(keys) == 2 else distinct.merge_groups(base, keys, k), keys, kind, k, deviations=4.0)
        exact = rows.groupBy(*keys).agg(F.countDistinct("player_id").alias("exact"))
        both = told.join(exact, keys).select("kind", *(F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in (("dt", "date"), ("server_id", "int"))), "exact", F.col("exact").between(F.col("lower"), F.col("upper")).alias("within"))
        out = both if out is None else out.unionByName(both)
    return out


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every document there, none overfull, overlapping or holed, and nothing split that fits."""
    packed = materialise(packing.pack_texts(table(spark, d, "documents"), CAPACITY), new_folder(spark, "packed"))
    texts = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"))
    by_text = texts.agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= CAPACITY)).alias("split_short"), F.count_if(F.col("pieces") != F.greatest(F.ceil(F.col("n") / CAPACITY), F.lit(1))).alias("wrong_pieces"))
    filled = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.countDistinct("start").alias("places"), F.count("*").alias("pieces"))
    by_container = filled.agg(F.count_if(F.col("n") > CAPACITY).alias("overfull"), F.count_if((F.col("n") != F.col("end")) | (F.col("places") != F.col("pieces"))).alias("holed"))
    return by_text.crossJoin(by_container)  # one row each


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), CAPACITY)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens, the share of the capacity that is filled, and the share of the fitted patterns that was run."""
    packed = packing.pack_texts(table(spark, d, "documents"), CAPACITY).where("container_id IS NOT NULL")
    each = packed.groupBy("container_id", "fit_share").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    return each.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.sum("pieces").alias("pieces"), (F.sum("n") / (F.count("*") * CAPACITY)).alias("filled"), F.max("fit_share").alias("fit_share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("item_id", "doc_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_planted(spark: SparkSession, d: str) -> DataFrame:
    """Every passage put into a text of its own, each fifth word missing and each third followed by a strange one: the items whose text is found again."""
    items = table(spark, d, "eval_items")
    put = F.transform(F.split("passage", r"\s+"), lambda w, i: F.when(i % 5 == 4, "").when(i % 3 == 2, F.concat(w, F.lit(" zyzzyva"))).otherwise(w))
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("qwerty "), F.array_join(put, " "), F.lit(" uiop")).alias("text"))
    return leakage.leaked_items(docs, items).where("item_id = doc_id").select("item_id", "doc_id")


def p10_samples(spark: SparkSession, d: str) -> DataFrame:
    """The language of each labelled sentence, which the classifier has seen (accuracy on held-out sentences is tested)."""
    samples = table(spark, d, "lang_samples")
    return language.languages(samples, samples, id_col="sample_id").select("sample_id", "found_lang", "mixed")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    found = p10_documents(spark, d)
    named = language.label_language(F.col("lang"))
    return found.where(F.col("mixed") | ~F.coalesce(named == F.col("found_lang"), F.lit(False))).select("doc_id", "found_lang")


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "documents"), table(spark, d, "lang_samples"), keep=["lang"])


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p3_percentiles": p3_percentiles,
        "p3_rank_error": p3_rank_error,
        "p6_distinct": p6_distinct,
        "p6_dau": p6_dau,
        "p6_bounds": p6_bounds,
        "p8_containers": p8_containers,
        "p8_fill": p8_fill,
        "p8_check": p8_check,
        "p9_found": p9_found,
        "p9_leaks": p9_leaks,
        "p9_planted": p9_planted,
        "p10_found": p10_found,
        "p10_documents": p10_documents,
        "p10_segments": p10_segments,
        "p10_samples": p10_samples,
    }
