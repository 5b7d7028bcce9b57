"""The cleaning job: read, extract, score, plugins, filters, dedup, write and report."""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as fn
from lexloom.operators import dedup, html, plugins, scoring
from lexloom.plans.config import fingerprint
from lexloom.sources import files, storage


@dataclass
class Result:
    report: dict
    decided: DataFrame


def decide(rows: DataFrame, config: dict, earlier: DataFrame | None = None, run: int = 0) -> DataFrame:
    """rows (of files.ROW) with their scores, outcome (accepted, rejected or error) and reason. earlier: (run, ord, text) of rows kept in runs before run, which count as first for dedup."""
    s, e, d = config["scoring"], config["extract"], config["dedup"]
    if config["input"]["format"] in ("html", "warc"):
        rows = rows.withColumn("text", html.extract(F.col("text"), strip_boilerplate=e["strip_boilerplate"], markdown=e["markdown"], keep_headings=e["markdown_keep_headings"], keep_lists=e["markdown_keep_lists"], keep_links=e["markdown_keep_links"]))
    else:
        rows = rows.withColumn("text", fn.trimmed(F.col("text")))
    c = s["content_quality"]
    rows = scoring.score(rows, "text", s["language"]["allow"], c["ad_keywords"], c["ad_patterns"])
    thresholds = {k: v for part in (s["language"], s["text_quality"], c, config["filters"]["thresholds"]) for k, v in part.items()}
    none = F.lit(None).cast("string")
    if config["plugins"]:
        rows = rows.withColumn("__p", plugins.chain(F.col("text"), F.col("meta"), config["plugins"])).withColumns({"plugin_scores": F.col("__p.scores"), "__reason": F.col("__p.reason"), "error": F.coalesce("error", "__p.error")}).drop("__p")
    else:
        rows = rows.withColumns({"plugin_scores": F.create_map().cast("map<string,double>"), "__reason": none})
    rows = rows.withColumn("reason", F.when(F.col("error").isNull(), F.coalesce("__reason", scoring.reason(thresholds, s["language"]["allow"], config["filters"]["rules"], "plugin_scores")))).drop("__reason")
    if d["exact"] or d["minhash_lsh"]:
        rows = dedup.scratch(rows)
        open_ = rows.where("error is null and reason is null").select(F.struct(F.lit(run).alias("run"), F.col("ord.file_rank").alias("f"), F.col("ord.rec_no").alias("r")).alias("o"), "text")
        if earlier is not None:
            open_ = open_.union(earlier.select(F.struct("run", F.col("ord.file_rank").alias("f"), F.col("ord.rec_no").alias("r")).alias("o"), "text"))
        again = []
        if d["exact"]:
            marked = dedup.scratch(dedup.exact(open_, "text", "o"))
            again.append(marked.where("duplicate_exact").select("o", F.lit("duplicate_exact").alias("why")))
            open_ = marked.where("not duplicate_exact").drop("duplicate_exact")
        if d["minhash_lsh"]:
            near = dedup.near(open_, d["similarity_threshold"], d["num_hashes"], d["num_bands"], d["shingle_size"], "text", "o")
            again.append(near.select("o", F.lit("duplicate_near_duplicate").alias("why")))
        found = again[0] if len(again) == 1 else again[0].union(again[1])
        found = found.where(F.col("o.run") == run).select(F.col("o.f").alias("__f"), F.col("o.r").alias("__r"), "why")
        rows = rows.join(found, (F.col("ord.file_rank") == F.col("__f")) & (F.col("ord.rec_no") == F.col("__r")), "left").withColumn("reason", F.coalesce("reason", "why")).drop("why", "__f", "__r")
    return rows.withColumn("outcome", F.when(F.col("error").isNotNull(), "error").when(F.col("reason").isNotNull(), "rejected").otherwise("accepted"))


def report(decided: DataFrame, seconds: float = 0.0) -> dict:
    """Counts by outcome and reason, the metrics' distributions, and the mean shares of characters by class."""
    counts = {r[0]: r[1] for r in decided.groupBy("outcome").count().collect()}
    reasons = {r[0]: r[1] for r in decided.where("outcome = 'rejected'").groupBy("reason").count().orderBy("reason").collect()}
    metrics = {r["metric"]: {"min": r["minimum"], "max": r["maximum"], "mean": r["mean"], "variance": r["variance"]} for r in scoring.statistics(decided).collect()}
    content = ("ad_keyword_ratio", "seo_spam_score", "naturalness_score")
    return {
        "summary": {"total_input_records": sum(counts.values()), **{f"{k}_records": counts.get(k, 0) for k in ("accepted", "rejected", "error")}, "elapsed_seconds": seconds},
        "rejection_reasons": reasons,
        "score_distributions": {k: v for k, v in metrics.items() if k not in content and not k.startswith("char_")},
        "char_type_ratios_aggregate": {k.removeprefix("char_"): v["mean"] for k, v in metrics.items() if k.startswith("char_")},
        "content_quality": {k: metrics[k] for k in content},
    }


def render(found: dict) -> str:
    lines = [f"{k}: {v}" for k, v in found["summary"].items()] + [f"  {k}: {v}" for k, v in found["rejection_reasons"].items()]
    lines += [f"{k}: {v:.6g}" for k, v in found["char_type_ratios_aggregate"].items()]
    return "\n".join(lines + [f"{k}: mean {v['mean']:.6g}, variance {v['variance']:.6g}, from {v['min']:.6g} to {v['max']:.6g}" for part in ("score_distributions", "content_quality") for k, v in found[part].items()])


def _nested() -> list:
    """The scores as JSON Lines have them, classes of characters within one object."""
    flat = [x for x in scoring.FIELDS if not x.startswith("char_")]
    chars = F.struct(*(F.col(x).alias(x.removeprefix("char_")) for x in scoring.FIELDS if x.startswith("char_"))).alias("char_ratios")
    return [*flat, chars, "plugin_scores"]


def run(spark: SparkSession, config: dict, dry_run: bool = False) -> Result:
    """Do the job. With runtime.checkpoint_dir files done in an earlier run with the same fingerprint are skipped, and what it kept counts for dedup.

    Results are staged, then the manifest is written, then they are moved to their place; a run that broke off before the
    manifest leaves nothing, and one that broke off after it is completed by the next.  Files that can't be opened are errors and aren't done.
    """
    began = time.monotonic()
    inp, out = config["input"], config["output"]
    found = files.discover(inp["paths"], spark)
    where = config["runtime"]["checkpoint_dir"] if not dry_run else None
    state = {"fingerprint": fingerprint(config), "done": [], "runs": 0, "index": [], "staged": []}
    if where and storage.exists(spark, f"{where}/manifest.json"):
        before = json.loads(storage.read_text(spark, f"{where}/manifest.json"))
        state = before if before["fingerprint"] == state["fingerprint"] else state
        for staged, path in state["staged"]:
            storage.publish(spark, staged, path)
    full = lambda f: f if "://" in f else os.path.abspath(f)
    todo = [f for f in found if full(f) not in set(state["done"])]
    rows = files.read(spark, inp["format"], todo, inp["text_mode"], inp["text_field"], inp["meta_fields"])
    earlier = spark.read.parquet(*state["index"]).select("run", "ord", "text") if state["index"] else None
    decided = dedup.scratch(decide(rows, config, earlier, state["runs"]))
    columns = ["id", "text", "meta", F.struct(*_nested()).alias("scores")] if out["format"] == "jsonl" else ["id", "source_path", "text", "meta", *scoring.FIELDS, "plugin_scores"]
    more = state["runs"] > 0
    token, staged = uuid.uuid4().hex, []
    if not dry_run:
        results = [("accepted", out["path"], columns)]
        if out["write_rejected"]:
            results.append(("rejected", out["rejected_path"] or f"{out['path']}.rejected.{out['format']}", [*columns, "reason"]))
        for outcome, path, chosen in results:
            files.write(decided.where(F.col("outcome") == outcome).select(*chosen), out["format"], path, more, out["shard_max_rows"], f"_staged-{token}")
            staged.append((f"{path}/_staged-{token}", path))
    whole = decided
    if where:
        index = f"{where}/run-{token}"
        kept = decided.select(F.lit(state["runs"]).alias("run"), "ord", "text", "outcome", "reason", *scoring.NUMERIC)
        kept.where("outcome = 'accepted'").write.parquet(f"{index}/kept")
        kept.drop("text").write.parquet(f"{index}/scores")
        scores = [f"{os.path.dirname(i)}/scores" for i in state["index"]]
        failed = files.unreadable(todo)
        state |= {"done": sorted({*state["done"], *(full(f) for f in todo if f not in failed)}), "runs": state["runs"] + 1, "index": [*state["index"], f"{index}/kept"], "staged": staged}
        storage.write_text(spark, f"{where}/manifest.json", json.dumps(state))
        whole = spark.read.parquet(*scores, f"{index}/scores")
    for part, path in staged:
        storage.publish(spark, part, path)
    result = report(whole, time.monotonic() - began)
    place = config["stats"]["output_path"] or (None if dry_run else f"{out['path']}.stats.json")
    shown = json.dumps(result, indent=2) if config["stats"]["format"] == "json" else render(result)
    if place:
        storage.write_text(spark, place, shown)
    else:
        print(shown)
    return Result(result, decided)


def validate_extraction(spark: SparkSession, paths: list[str]) -> dict:
    """Counts and samples of markup and URLs left in text files: at most 5 of a kind in a file, 10 in all."""
    found = files.discover(paths, spark)
    rows = files.read_text(spark, found, whole=True).select("source_path", *(x for name, p in (("html", fn.TAG), ("urls", fn.URL)) for x in (F.col("text").rlike(p).alias(f"has_{name}"), fn.residual_samples(F.col("text"), p).alias(name))))
    total = rows.agg(F.count_if("has_html").alias("files_with_html"), F.count_if("has_urls").alias("files_with_urls")).first().asDict()
    samples = {k: [r[0] for r in rows.select("source_path", F.posexplode(k).alias("i", "x")).orderBy("source_path", "i").limit(10).select("x").collect()] for k in ("html", "urls")}
    return {"files": len(found), **total, "html_samples": samples["html"], "url_samples": samples["urls"]}
