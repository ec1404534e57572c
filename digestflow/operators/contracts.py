"""Record rules as reports: which rows break which."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestflow.functions.text import stripped


def filled(name: str) -> Column:
    return F.coalesce(F.char_length(stripped(F.col(name))) > 0, F.lit(False))


def http_url(column: Column) -> Column:
    return F.coalesce(column.rlike("(?i)^https?://[^/?#]"), F.lit(False))


def materials() -> Mapping[str, Column]:
    return {
        "id_sha256": F.col("id").rlike("^[0-9a-f]{64}$"), "hash_sha256": F.col("content_hash").rlike("^[0-9a-f]{64}$"), "title_filled": filled("title"),
        "text_filled": filled("text"), "url_http": http_url(F.col("original_url")), "date_set": F.col("published_at").isNotNull(),
    }


def cursors() -> Mapping[str, Column]:
    c = F.col("cursor")
    return {"one_shape": c.isNull() | ((c["published_at"].isNotNull() & c["external_id"].isNotNull()) != c["message_id"].isNotNull())}


def profiles() -> Mapping[str, Column]:
    return {
        "version": F.col("version") >= 1, "freshness": F.col("freshness_days").between(1, 365), "times": F.col("updated_at") >= F.col("created_at"),
        "length": F.col("summary_length").isin("brief", "normal", "detailed"), "description_filled": filled("description"),
    }


def links() -> Mapping[str, Column]:
    return {"no_self_link": F.col("material_id") != F.col("duplicate_of_id"), "similarity_range": F.col("similarity").between(0, 1), "kind": F.col("kind").isin("exact_content", "semantic")}


def clusters() -> Mapping[str, Column]:
    ids, near = F.col("material_ids"), F.col("similarities")
    return {
        "unique_members": F.size(F.array_distinct(ids)) == F.size(ids), "representative_in": F.array_contains(ids, F.col("representative_id")),
        "scores_of_members": F.array_sort(F.map_keys(near)) == F.array_sort(ids), "score_range": F.forall(F.map_values(near), lambda v: v.between(0, 1)),
        "own_score": F.try_element_at(near, F.col("representative_id")) == 1.0,
    }


def members() -> Mapping[str, Column]:
    """Of clusters as rows of members; places are unique within a cluster."""
    own = F.col("material_id") == F.col("representative_id")
    return {
        "representative_first": own == (F.col("pos") == 0), "place": F.col("pos").between(0, F.col("n_members") - 1), "score_range": F.col("similarity").between(0, 1),
        "own_score": ~own | (F.col("similarity") == 1.0), "id_sha256": F.col("id").rlike("^[0-9a-f]{64}$"),
    }


def digest_items() -> Mapping[str, Column]:
    n = F.size("source_links")
    return {"has_link": n >= 1, "links_http": F.forall("source_links", http_url), "dates_match": F.col("source_dates").isNull() | (F.size("source_dates") == n)}


def posts() -> Mapping[str, Column]:
    return {"receipt_whole": F.col("message_id").isNull() == F.col("sent_at").isNull(), "length": F.char_length("text").between(1, 4096)}


def violations(df: DataFrame, rules: Mapping[str, Column], key: str = "id") -> DataFrame:
    """key, rule for each rule that a row breaks; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def unknown_columns(df: DataFrame, schema) -> list[str]:
    """Columns of df that a fixed schema doesn't have."""
    return sorted(set(df.columns) - set(schema.names))
