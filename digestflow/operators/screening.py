"""Batch scoring: requests from clusters, strict parsing of answers, the accept policy, the review."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SCORE_KEY = ("cluster_id", "profile_id", "profile_version", "model", "prompt_version")
#: What an answer to a screening request must hold, with ranges.
SCREENING_FIELDS = {"relevance_score": "double", "noise_score": "double", "uncertain": "boolean", "reason": "string"}
LEAST_BUDGET, TITLE_CHARS = 1000, 300


def cluster_materials(clusters: DataFrame, materials: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Clusters as rows of members (dedup.MEMBERS) -> cluster_id, members (ordered array of structs: id and columns), and the ids
    of members that are missing.  For clusters that got an answer, whose size a request's budget bounds."""
    each = clusters.select(F.col("id").alias("cluster_id"), "pos", F.col("material_id").alias("id"))
    both = each.join(materials.select(F.col("id").cast("string").alias("id"), F.lit(True).alias("found"), *columns), "id", "left")
    missing = both.where("found IS NULL").select("cluster_id", "id")
    members = both.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", *columns))).alias("members"), F.count("found").alias("n"))
    return members.where(F.col("n") == F.size("members")).drop("n"), missing


def _json(text: Column) -> Column:
    """A text as JSON writes it within quotes."""
    whole = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t")))
    return F.substring(whole, F.lit(len('{"t":"') + 1), F.char_length(whole) - len('{"t":""}'))


def _cut(escaped: Column, n: Column) -> Column:
    """At most n characters of a text in JSON, without a broken escape at the end."""
    return F.regexp_replace(F.substring(escaped, F.lit(1), n), r"(?<!\\)((?:\\\\)*)\\(?:u[0-9A-Fa-f]{0,3})?\z", "$1")


def pack_prompts(clusters: DataFrame, materials: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Clusters as rows of members -> cluster_id, documents (JSON within budget characters), and errors (member_missing, metadata_over_budget).

    Each member gets an equal share of what ids and titles leave of the budget, counted in characters of JSON; there must be
    one at least for each.  Ids and titles of a cluster with too many members alone are over budget, so its texts are never
    gathered; of others a member's text is cut before.
    """
    if budget < LEAST_BUDGET:
        raise ValueError(f"budget must be at least {LEAST_BUDGET}")
    head = F.concat(F.lit('{"material_id":"'), _json(F.col("id")), F.lit('","title":"'), _json(F.substring("title", 1, TITLE_CHARS)), F.lit('","text":"'))
    tail = '"}'
    least = len('{"material_id":"","title":"","text":""},') + 1
    each = clusters.select(F.col("id").alias("cluster_id"), F.col("n_members").alias("n"), "pos", F.col("material_id").alias("id"))
    one = materials.withColumn("id", F.col("id").cast("string")).select("id", head.alias("head"), _json(F.substring("text", 1, budget)).alias("text"))
    missing = each.join(one.select("id"), "id", "left_anti").select("cluster_id").distinct()
    large = each.where((F.col("n") > budget // least) & (F.col("pos") == 0)).select("cluster_id").join(missing, "cluster_id", "left_anti")
    both = each.where(F.col("n") <= budget // least).join(one, "id")
    both = both.withColumn("text", _cut(F.col("text"), F.floor(budget / F.col("n")).cast("int")))
    members = both.groupBy("cluster_id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "head", "text"))).alias("m"))
    members = members.where(F.size("m") >= F.col("n")).withColumn("n", F.size("m"))
    # brackets, commas, and all of each member but its text
    heads = F.aggregate("m", F.col("n") + 1, lambda s, x: s + F.char_length(x["head"]) + len(tail))
    rows = members.withColumn("room", budget - heads)
    share = F.floor(F.col("room") / F.col("n")).cast("int")
    written = F.transform("m", lambda x: F.concat(x["head"], _cut(x["text"], share), F.lit(tail)))
    documents = F.concat(F.lit("["), F.array_join(written, ","), F.lit("]"))
    over = rows.where("room < n").select("cluster_id").unionByName(large)
    errors = missing.select("cluster_id", F.lit("member_missing").alias("code")).unionByName(over.select("cluster_id", F.lit("metadata_over_budget").alias("code")))
    return rows.where("room >= n").select("cluster_id", documents.alias("documents")), errors


def needs_scoring(clusters: DataFrame, scored: DataFrame, profile_id: str, version: int, model: str, prompt_version: str) -> DataFrame:
    """The rows of clusters without a score under this profile version, model and prompt."""
    own = scored.where(
        (F.col("profile_id") == profile_id) & (F.col("profile_version") == version) & (F.col("model") == model) & (F.col("prompt_version") == prompt_version)
    )
    return clusters.join(own.select(F.col("cluster_id").alias("id")), "id", "left_anti")


def screening_requests(clusters: DataFrame, materials: DataFrame, interests: str, template: str = "%s\n%s", budget: int = 16_000) -> tuple[DataFrame, DataFrame]:
    """One request (cluster_id, request) per cluster: the interests and its documents, by the caller's template."""
    rows, errors = pack_prompts(clusters, materials, budget)
    return rows.select("cluster_id", F.format_string(template, F.lit(interests), F.col("documents")).alias("request")), errors


def summary_requests(accepted: DataFrame, materials: DataFrame, length_text: str, tone: str | None = None, template: str = "%s\n%s", budget: int = 24_000) -> tuple[DataFrame, DataFrame]:
    """One request per accepted cluster: the length's wording and a tone line if there is one, then its documents."""
    rows, errors = pack_prompts(accepted, materials, budget)
    head = length_text if not tone else f"{length_text}\n{tone}"
    return rows.select("cluster_id", F.format_string(template, F.lit(head), F.col("documents")).alias("request")), errors


def score(requests: DataFrame, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """requests with ``response``: fn over the requests of a batch, in the caller's way (a model client, say)."""

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(response=fn(batch["request"].tolist()))

    return requests.mapInPandas(answered, StructType([*requests.schema, StructField("response", StringType())]))


def parse_json_strict(responses: DataFrame, fields: Mapping[str, str], checks: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """responses (..., response) with the answer's fields as columns, and the rows that don't fit, with ``code``.

    An answer is a JSON object, maybe in a code fence, with exactly these keys, each of its type, that passes the checks.
    """
    text = F.regexp_replace("response", r"(?U)^\s+|\s+$", "")
    fenced = F.regexp_extract(text, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    names = sorted(fields)
    kinds = {"double": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$", "string": "^STRING$", "bigint": "^BIGINT$"}
    value = {n: F.try_variant_get(F.col("_v"), f"$.{n}", "variant") for n in names}
    rows = responses.withColumn("_body", body).withColumn("_v", F.try_parse_json("_body"))
    keys = F.array_sort(F.coalesce(F.json_object_keys("_body"), F.array().cast("array<string>")))
    typed = F.lit(True)
    for n in names:
        typed = typed & F.coalesce(F.schema_of_variant(value[n]).rlike(kinds[fields[n]]), F.lit(False))
    rows = rows.withColumn("_ok", F.col("_v").isNotNull() & (keys == F.array(*[F.lit(n) for n in names])) & typed)
    rows = rows.withColumns({n: F.when(F.col("_ok"), F.try_variant_get(F.col("_v"), f"$.{n}", fields[n])) for n in names})
    for check in (checks or {}).values():
        rows = rows.withColumn("_ok", F.col("_ok") & F.coalesce(check, F.lit(False)))
    bad = rows.where(~F.coalesce("_ok", F.lit(False))).select(*responses.columns, F.lit("answer_invalid").alias("code"))
    return rows.where("_ok").drop("_body", "_v", "_ok"), bad


def screening_rows(responses: DataFrame, profile_id: str, version: int, model: str, prompt_version: str, created_at: Column) -> tuple[DataFrame, DataFrame]:
    """Parsed scores as screening rows, and the answers that don't fit."""
    checks = {"relevance": F.col("relevance_score").between(0, 1), "noise": F.col("noise_score").between(0, 1), "reason": F.trim("reason") != ""}
    rows, bad = parse_json_strict(responses.select("cluster_id", "response"), SCREENING_FIELDS, checks)
    return rows.select(
        "cluster_id", F.lit(profile_id).alias("profile_id"), F.lit(version).alias("profile_version"), F.lit(model).alias("model"),
        F.lit(prompt_version).alias("prompt_version"), "relevance_score", "noise_score", "uncertain", "reason", created_at.alias("created_at"),
    ), bad


def verdict(relevance: float = 0.6, noise: float = 0.7) -> Column:
    """Uncertain scores pass; others if relevant enough and not too noisy."""
    if not (0 <= relevance <= 1 and 0 <= noise <= 1):
        raise ValueError("thresholds must be between 0 and 1")
    return F.col("uncertain") | ((F.col("relevance_score") >= relevance) & (F.col("noise_score") <= noise))


def accept(rows: DataFrame, relevance: float = 0.6, noise: float = 0.7) -> DataFrame:
    return rows.where(verdict(relevance, noise))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def review(rows: DataFrame, clusters: DataFrame, materials: DataFrame, profile_id: str, n: int, relevance: float = 0.6, noise: float = 0.7) -> DataFrame:
    """The newest n clusters as last scored for a profile, with title and URL of the representative and today's verdict.

    Scores of one time are told apart by model and prompt version.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    own = rows.where(F.col("profile_id") == profile_id)
    last = latest(own, "cluster_id", F.desc("created_at"), F.asc("model"), F.asc("prompt_version"))
    both = last.join(clusters.select(F.col("id").alias("cluster_id"), "representative_id").distinct(), "cluster_id")
    both = both.join(materials.select(F.col("id").cast("string").alias("representative_id"), "title", "original_url"), "representative_id")
    return both.withColumn("accepted", verdict(relevance, noise)).orderBy(F.desc("created_at"), "cluster_id").limit(n)
