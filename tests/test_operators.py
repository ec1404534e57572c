"""Dedup, clusters, screening, digests, registry, tables and streams on small fixtures."""

import datetime as dt
import hashlib
import html
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from digestflow.operators import contracts, dedup, digest, ingest, registry, screening, tables
from digestflow.plans import feed_queries
from digestflow.streaming import jobs

NOW = dt.datetime(2026, 9, 2, 12)
#: A cluster as rows of its members.
MEMBERS = "id string, representative_id string, n_members long, pos long, material_id string, similarity double"


def test_exact_prefers_stored(spark):
    ddl = "id string, content_hash string, published_at timestamp, batch_pos long"
    stored = spark.createDataFrame([("s2", "h1", NOW, 0), ("s1", "h1", NOW - dt.timedelta(1), 0)], ddl)
    new = spark.createDataFrame([("n1", "h2", NOW, 0), ("n2", "h2", NOW - dt.timedelta(5), 1), ("n3", "h1", NOW, 2)], ddl)
    unique, links = dedup.exact(new, stored)
    assert [r.id for r in unique.collect()] == ["n1"]
    assert {(r.material_id, r.duplicate_of_id) for r in links.collect()} == {("n2", "n1"), ("n3", "s1")}
    assert [r.id for r in dedup.drop_known(new, new.where("id = 'n1'")).orderBy("id").collect()] == ["n2", "n3"]
    assert [r.id for r in dedup.repeated_ids(new.union(new.limit(1))).collect()] == ["n1"]


def shuffles(df):
    """How often rows are dealt out by a key in the plan of df (as it was before it ran), and the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return plan.count("Exchange hashpartitioning"), plan


def test_rows_are_shuffled_once_to_find_the_first(spark):
    rng, ddl = random.Random(8), "k string, j int, o int, v int"
    rows = [(rng.choice("abcdefgh") if rng.random() < 0.9 else None, rng.choice([1, 2, None]), rng.choice([None, *range(30)]), i) for i in range(300)]
    rows = list({(k, j, o): r for r in rows for k, j, o, _ in [r]}.values())  # no ties
    df, stored = spark.createDataFrame(rows, ddl), spark.createDataFrame([("a", 1, 0, -1), ("b", None, 0, -1), ("z", 1, 0, -1)], ddl)
    found, first = tables.first_wins(df, stored, ["k", "j"], ["o"]), {}
    for k, j, o, v in rows:
        if None not in (k, j) and (k, j) != ("a", 1):
            first[k, j] = min(first.get((k, j), (99, 0)), (-1 if o is None else o, v))
    want = [v for _, v in first.values()] + [v for k, j, _, v in rows if None in (k, j)]
    assert sorted(r.v for r in found.collect()) == sorted(want) and found.columns == df.columns
    n, plan = shuffles(found)
    assert n == 2 and "row_number(), 1, Partial" in plan  # the rows and the stored keys, each once; repeats stay where they are


def test_exact_shuffles_no_rows_for_a_few_repeats(spark):
    ddl = "id string, content_hash string, published_at timestamp, batch_pos long"
    new = spark.createDataFrame([(f"n{i:03}", None if i % 50 == 9 else f"h{min(i % 60, 40)}", NOW, i) for i in range(200)], ddl)
    stored = spark.createDataFrame([("s1", "h3", NOW, 0), ("s2", "h99", NOW, 0), ("s3", None, NOW, 0)], ddl)
    unique, links = dedup.exact(new, stored)
    target = {}
    for r in new.where("content_hash IS NOT NULL").orderBy("batch_pos").collect():
        target.setdefault(r.content_hash, "s1" if r.content_hash == "h3" else r.id)
    rows = [r for r in new.collect() if r.content_hash]
    assert {r.id for r in unique.collect()} == {r.id for r in rows if target[r.content_hash] == r.id}
    assert {(r.material_id, r.duplicate_of_id) for r in links.collect()} == {(r.id, target[r.content_hash]) for r in rows if target[r.content_hash] != r.id}
    assert shuffles(unique)[0] == shuffles(links)[0] == 0


def test_items_without_cursors_are_not_shuffled(spark, tmp_path):
    items = spark.createDataFrame([("s", "1", NOW, "a", 1)], ITEMS)
    none = jobs.FeedTables(spark, f"file://{tmp_path}/t").latest_cursors()
    new = ingest.after_cursor(items, none)
    assert shuffles(new)[0] == 0 and new.columns == items.columns and new.count() == 1 and ingest.next_cursors(items, none).first().cursor.external_id == "1"


def vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, 8)) + rng.standard_normal((4, 8))[rng.integers(0, 4, n)] * 2
    m[0] = 0
    return m, spark.createDataFrame([(i, [float(x) for x in v], i) for i, v in enumerate(m)], "id long, vec array<float>, pos long")


@pytest.mark.parametrize("mode,block", [("exact", 2048), ("exact", 7), ("bands", 2048), ("bands", 5)])
def test_similarity_pairs(spark, mode, block):
    m, df = vectors(spark, 60, 1)
    m = m.astype(np.float32).astype(float)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if unit[i] @ unit[j] >= 0.9}
    got = {(r.a, r.b) for r in dedup.similarity_pairs(df, 0.9, mode, block, bits=6).collect()}
    assert got == want if mode == "exact" else got <= want and len(got) >= 0.95 * len(want)
    with pytest.raises(ValueError):
        dedup.similarity_pairs(df, 0)


def assert_similar_docs(spark, path, texts):
    """The query as registered finds what comparing all whole texts does."""
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    m = np.array(dedup.hashed_counts(pd.Series(texts)), float)
    near = m @ m.T
    want = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(near >= 0.9))) if i < j}
    assert want and not (abs(near - 0.9) < 1e-5).any()
    assert {(r.a, r.b) for r in feed_queries.similar_docs(spark, str(path)).collect()} == want


def test_similar_docs_finds_pairs_near_the_threshold(spark, tmp_path):
    texts = []
    for g in range(12):
        base = [f"w{g}x{i}" for i in range(104)]
        texts += [" ".join(base[: 5 * k] + [f"v{g}x{k}x{i}" for i in range(5)] + base[5 * k + 5 :]) for k in range(10)]
    assert_similar_docs(spark, tmp_path, texts)


def test_similar_docs_takes_whole_texts(spark, tmp_path):
    """Two texts share their first 5000 characters and little else, two differ there and agree afterwards."""
    part = lambda name, n: " ".join(f"{name}{i:05d}" for i in range(n))
    opening, rest = part("o", 800), part("r", 9000)
    assert_similar_docs(spark, tmp_path, [f"{opening} {part('a', 2000)}", f"{opening} {part('b', 2000)}", f"{part('c', 700)} {rest}", f"{part('d', 700)} {rest}"])


def test_leaders_and_clusters(spark):
    rng = random.Random(2)
    edges = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(60)) if a < b}
    pairs = spark.createDataFrame([(a, b, 0.9 + 0.001 * a) for a, b in edges], "a long, b long, similarity double")
    nodes = spark.createDataFrame([(i, i) for i in range(40)], "id long, pos long")
    lead = []
    for i in range(40):
        if not any((j, i) in edges for j in lead):
            lead.append(i)
    found = dedup.greedy_leaders(nodes, pairs)
    assert {r.id for r in found.where("leader").collect()} == set(lead) and found.count() == 40
    members, links = dedup.clusters(found, pairs, nodes)
    rows = dedup.identified(members)
    clusters = dedup.gathered(rows)
    got = {int(r.representative_id): {int(x) for x in r.material_ids} for r in clusters.collect()}
    assert got == {i: {i} | {j for j in range(40) if (i, j) in edges and j not in lead} for i in lead}
    best, _ = dedup.clusters(found, pairs, nodes, assign="best")
    members = [r.material_id for r in best.collect()]
    assert len(members) == len(set(members)) == 40
    for r in clusters.collect():
        assert r.material_ids == [r.representative_id, *sorted(set(r.material_ids) - {r.representative_id})] and r.id == hashlib.sha256("\x1f".join(sorted(r.material_ids)).encode()).hexdigest()
    assert contracts.violations(rows, contracts.members()).count() == 0 and dedup.identified(rows.limit(0).drop("id", "n_members", "pos")).count() == 0
    assert contracts.violations(clusters, contracts.clusters()).count() == 0 and contracts.violations(links, contracts.links(), "material_id").count() == 0
    only_old, _ = dedup.clusters(found, pairs, nodes.limit(0))
    assert only_old.count() == 0


def test_attach_exact(spark):
    members = spark.createDataFrame([("r", "r", 1.0), ("r", "m", 0.9)], "representative_id string, material_id string, similarity double")
    links = spark.createDataFrame([("y", "m", 2), ("x", "m", 1), ("m", "r", 0), ("z", "q", 3), ("y", "m", 5), ("w", "r", 9)], "material_id string, duplicate_of_id string, batch_pos long")
    rows = dedup.identified(dedup.attach_exact(members, links))
    assert contracts.violations(rows, contracts.members()).count() == 0
    r = dedup.gathered(rows).first()
    assert r.material_ids == ["r", "m", "w", "x", "y"] and r.similarities == {"r": 1.0, "m": 0.9, "w": 1.0, "x": 1.0, "y": 1.0}
    assert r.id == hashlib.sha256("\x1f".join("mrwxy").encode()).hexdigest() and {x.n_members for x in rows.collect()} == {5}


def test_large_cluster(spark):
    """A cluster with most of all rows: its places come from many tasks, and its id is that of the ordered list."""
    n = 20_000
    members = spark.createDataFrame([("r", "r", 1.0)], "representative_id string, material_id string, similarity double")
    copies = spark.range(n).select(F.format_string("c%06d", "id").alias("material_id"), F.lit("r").alias("duplicate_of_id"), (n - F.col("id")).alias("batch_pos"))
    alone = spark.range(100).select(*[F.concat(F.lit("s"), "id").alias(c) for c in ("representative_id", "material_id")], F.lit(1.0).alias("similarity"))
    rows = dedup.identified(dedup.attach_exact(members.unionByName(alone), copies)).cache()
    ids = ["r", *(f"c{i:06d}" for i in range(n))]
    assert {r.id for r in rows.where("representative_id = 'r'").select("id").distinct().collect()} == {hashlib.sha256("\x1f".join(sorted(ids)).encode()).hexdigest()}
    places = {r.material_id: r.pos for r in rows.where("representative_id = 'r'").collect()}
    assert places == {"r": 0} | {f"c{i:06d}": n - i for i in range(n)}
    assert rows.where("pos = 0").count() == 101 and rows.where("representative_id != 'r' AND n_members = 1").count() == 100


def test_exact_conflicts(spark):
    both, bad = dedup.combine(spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string"), spark.createDataFrame([(2, "c"), (1, "a")], "id long, t string"))
    assert both.count() == 2 and [r.id for r in bad.collect()] == [2]


def one_cluster(spark, texts):
    ids = [f"m{i}" for i in range(len(texts))]
    clusters = spark.createDataFrame([("c", ids[0], len(ids), k, i, 1.0) for k, i in enumerate(ids)], MEMBERS)
    rows = [(i, f"title {i}", t, f"https://x.test/{i}", NOW) for i, t in zip(ids, texts)]
    return clusters, spark.createDataFrame(rows, "id string, title string, text string, original_url string, published_at timestamp")


def test_pack_prompts(spark):
    clusters, materials = one_cluster(spark, ["a" * 60_000, "\n\"" * 3000, "short"])
    rows, errors = screening.pack_prompts(clusters, materials, 1000)
    found = json.loads(rows.first().documents)
    assert len(rows.first().documents) <= 1000 and [d["material_id"] for d in found] == ["m0", "m1", "m2"] and found[0]["text"].startswith("aaa") and errors.count() == 0
    with pytest.raises(ValueError):
        screening.pack_prompts(clusters, materials, 999)
    _, errors = screening.pack_prompts(clusters, materials.where("id != 'm1'"), 1000)
    assert [r.code for r in errors.collect()] == ["member_missing"]
    many, own = one_cluster(spark, ["x"] * 60)
    assert [r.code for r in screening.pack_prompts(many, own, 1000)[1].collect()] == ["metadata_over_budget"]


def test_pack_prompts_equals_brute_force(spark):
    rng = random.Random(1)
    some = lambda n: "".join(rng.choice('ab"\\\n\x01é😀 ') for _ in range(rng.randint(0, n))) if rng.random() > 0.1 else None
    rows = {f'c{c}"{i}': (some(40), some(1500)) for c in range(60) for i in range(c % 12 + 1)}
    groups = {f"c{c}": [f'c{c}"{i}' for i in range(c % 12 + 1)] for c in range(60)}
    clusters = spark.createDataFrame([(c, ids[0], len(ids), k, i, 1.0) for c, ids in groups.items() for k, i in enumerate(ids)], MEMBERS)
    got, errors = screening.pack_prompts(clusters, spark.createDataFrame([(i, *r) for i, r in rows.items()], "id string, title string, text string"), 1000)
    got, failed = {r.cluster_id: r.documents for r in got.collect()}, {r.cluster_id for r in errors.collect()}

    def packed(ids, texts):
        return json.dumps([{"material_id": i, "title": rows[i][0] or "", "text": t} for i, t in zip(ids, texts)], ensure_ascii=False, separators=(",", ":"))

    for c, ids in groups.items():
        share = (1000 - len(packed(ids, [""] * len(ids)))) // len(ids)
        heads = []
        for text in (rows[i][1] or "" for i in ids):
            n = len(text)
            while len(json.dumps(text[:n], ensure_ascii=False)) - 2 > max(share, 0):
                n -= 1
            heads.append(text[:n])
        assert c in failed if share < 1 else json.loads(got[c]) == json.loads(packed(ids, heads)) and len(got[c]) <= 1000


def test_scoring_round_trip(spark):
    clusters, materials = one_cluster(spark, ["a b", "c"])
    requests, _ = screening.screening_requests(clusters, materials, "about x")
    assert requests.first().request.startswith("about x\n[")
    answer = '{"relevance_score": 0.7, "noise_score": 0.1, "uncertain": false, "reason": "r"}'
    rows, bad = screening.screening_rows(screening.score(requests, lambda batch: [answer for _ in batch]), "p", 1, "m", "v", F.lit(NOW))
    assert rows.count() == 1 and bad.count() == 0 and screening.accept(rows).count() == 1
    summaries, _ = screening.summary_requests(clusters, materials, "short", "plain")
    assert summaries.first().request.startswith("short\nplain\n[")


def test_strict_answers(spark):
    good = '{"relevance_score": 1, "noise_score": 0.5, "uncertain": true, "reason": "r"}'
    texts = [good, f"```json\n{good}\n```", good.replace("1,", "1.5,"), good.replace('"r"', '" "'), good[:-1] + ', "x": 1}', "no json", "[1]", None, good.replace("true", '"true"'), good.replace('"reason"', '"other"')]
    rows, bad = screening.screening_rows(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "cluster_id string, response string"), "p", 1, "m", "v", F.lit(NOW))
    assert {r.cluster_id for r in rows.collect()} == {"0", "1"} and {r.cluster_id for r in bad.collect()} == {str(i) for i in range(2, 10)}


def test_verdict_and_review(spark):
    ddl = "cluster_id string, profile_id string, profile_version int, model string, prompt_version string, relevance_score double, noise_score double, uncertain boolean, reason string, created_at timestamp"
    rows = spark.createDataFrame([("c", "p", 1, "a", "v", 0.6, 0.7, False, "r", NOW), ("c", "p", 1, "b", "v", 0.5, 0.7, False, "r", NOW), ("d", "p", 1, "a", "v", 0.0, 1.0, True, "r", NOW - dt.timedelta(1)),
                                  ("e", "q", 1, "a", "v", 0.0, 1.0, True, "r", NOW)], ddl)
    assert {(r.cluster_id, r.model) for r in screening.accept(rows).collect()} == {("c", "a"), ("d", "a"), ("e", "a")}
    clusters = spark.createDataFrame([(i, i) for i in "cde"], "id string, representative_id string")
    materials = spark.createDataFrame([(i, f"t{i}", "u") for i in "cde"], "id string, title string, original_url string")
    got = screening.review(rows, clusters, materials, "p", 5).collect()
    assert [(r.cluster_id, r.title, r.accepted) for r in got] == [("c", "tc", True), ("d", "td", True)]
    assert [r.id for r in screening.needs_scoring(clusters, rows, "p", 1, "b", "v").orderBy("id").collect()] == ["d", "e"]
    with pytest.raises(ValueError):
        screening.review(rows, clusters, materials, "p", 0)


def test_digest(spark):
    clusters, materials = one_cluster(spark, ["a", "b"])
    summaries = spark.createDataFrame([("c", "A <b> & c"), ("d", "see https://x"), ("e", " "), ("f", "x" * 1501)], "cluster_id string, summary string")
    items, bad = digest.digest_items(summaries, clusters, materials)
    assert {r.cluster_id for r in bad.collect()} == {"d", "e", "f"}
    own = items.withColumns({"profile_id": F.lit("p"), "profile_version": F.lit(1), "channel_id": F.lit("ch"), "position": F.lit(0)})
    digests, rows, posts = digest.compose(own, "Head", F.lit(NOW))
    assert posts.first().text == 'Head\n\n• A &lt;b&gt; &amp; c\nИсточники:\n1. <a href="https://x.test/m0">x.test</a>\n02.09.2026\n2. <a href="https://x.test/m1">x.test</a>\n02.09.2026'
    assert rows.count() == 1 and len(digests.first().id) == 64
    again, _, _ = digest.compose(own, "Other", F.lit(NOW + dt.timedelta(1)))
    assert again.first().id == digests.first().id
    assert digest.collisions(digests.withColumn("channel_id", F.lit("z")), digests).count() == 1 and digest.collisions(digests, digests).count() == 0
    assert digest.compose(own.limit(0), "Head", F.lit(NOW))[0].count() == 0


def test_split_posts(spark):
    texts = ["word " * 100, "short", "x" * 300]
    items = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "digest_id string, position int, text string")
    posts = [r.text for r in digest.split_posts(items, " H ", 128).orderBy("position").collect()]
    assert all(len(p) <= 128 and p.startswith("H\n\n") for p in posts)
    bodies = [p[3:] for p in posts]
    at = bodies.index("short")
    assert at >= 4 and " ".join(bodies[:at]).split() == ["word"] * 100 and "".join(bodies[at + 1 :]) == "x" * 300
    for limit, header in ((127, "H"), (4097, "H"), (128, " "), (128, "h" * 126)):
        with pytest.raises(ValueError):
            digest.split_posts(items, header, limit)


def test_digest_posts_are_whole(spark, tmp_path):
    """The query against brute force: texts of up to 20000 characters, a hot source, null and equal positions."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["a<b", "it's", "plain", "x" * 50]) for _ in range(rng.choice([0, 1, 40, 700]))), "hot" if i % 3 else f"s{i % 2}") for i in range(60)]
    docs += [docs[4], (None, "nowhere " * 500, "hot"), (7, "z " * 900, None), (8, None, "hot")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = feed_queries.digest_posts(spark, str(tmp_path)).collect()
    for source in {d[2] for d in docs}:
        own = sorted((d for d in docs if d[2] == source and d[1] is not None), key=lambda d: (d[0] is not None, d[0] or 0))
        posts = [f"Digest\n\n{p}" for d in own for p in digest._pieces(html.escape(d[1]), 992)]
        found = sorted((r for r in got if r.digest_id == source), key=lambda r: r.position)
        assert [r.position for r in found] == list(range(len(posts))) and [r.text for r in found] == posts
        assert "".join("".join(r.text[8:].split()) for r in found) == "".join("".join(html.escape(d[1]).split()) for d in own)


def test_receipts(spark):
    posts = spark.createDataFrame([("d", 0, "a", None, None), ("d", 1, "b", 5, NOW), ("e", 0, "c", None, None)], "digest_id string, position int, text string, message_id long, sent_at timestamp")
    later = NOW + dt.timedelta(hours=1)
    log = spark.createDataFrame([("d", 0, 7, NOW), ("d", 0, 7, later), ("d", 0, 8, later), ("d", 1, 6, later), ("x", 0, 1, NOW)], "digest_id string, position int, message_id long, sent_at timestamp")
    kept, conflicts, unknown = digest.apply_receipts(posts, log)
    assert {(r.digest_id, r.position): r.message_id for r in kept.collect()} == {("d", 0): 7, ("d", 1): 5, ("e", 0): None}
    assert {r.message_id for r in conflicts.collect()} == {8, 6} and [r.digest_id for r in unknown.collect()] == ["x"]
    assert [(r.digest_id, r.message_ids) for r in digest.delivery_receipts(kept).collect()] == [("d", [7, 5])]
    digests = spark.createDataFrame([("d", None), ("e", None)], "id string, sent_at timestamp")
    assert {r.id: r.sent_at for r in digest.complete(digests, kept).collect()} == {"d": NOW, "e": None}
    assert [r.digest_id for r in digest.pending_posts(kept, kept.where("message_id IS NOT NULL")).collect()] == ["e"]
    assert contracts.violations(kept, contracts.posts(), "digest_id").count() == 0


def test_due(spark):
    def due(slots, local):
        df = spark.createDataFrame([(slots, local - dt.timedelta(hours=3))], "s array<struct<weekday:int,hour:int>>, now timestamp")
        return df.select(digest.due(F.col("s"), F.col("now"))).first()[0]

    daily, sunday = [(None, 9)], [(6, 23)]
    assert due(daily, dt.datetime(2026, 9, 2, 10, 17)) and not due(daily, dt.datetime(2026, 9, 2, 16, 17)) and due([], NOW) and due(None, NOW)
    assert due(sunday, dt.datetime(2026, 9, 7, 4, 17)) and not due(sunday, dt.datetime(2026, 9, 8, 4, 17)) and not due(daily, dt.datetime(2026, 9, 2, 15, 0)) and due(daily, dt.datetime(2026, 9, 2, 9, 0))


def test_source_log(spark):
    log = [(1, "add", "a", "https://x.test/", "website"), (2, "add", "b", "https://X.test", "website"), (3, "delete", "a", None, None), (4, "add", "c", "https://x.test/#f", "website"), (5, "delete", "zz", None, None),
           (6, "add", "d", "nonsense", "website"), (7, "delete", "a", None, None), (8, "delete", "a", None, None), (9, "add", "e", "@Channel", "telegram")]
    state, rejected = registry.fold_sources(spark.createDataFrame(log, "seq long, op string, id string, locator string, kind string"))
    assert {(r.id, r.normalized_locator, r.enabled) for r in state.collect()} == {("a", "https://x.test/", False), ("e", "@channel", True)}
    assert {r.seq: r.reason for r in rejected.collect()} == {2: "duplicate", 5: "absent", 6: "invalid_locator", 8: "absent"}


CHANGES = "seq long, profile_id string, op string, expected_version int, description string, freshness_days int, summary_length string"


def test_profile_log(spark):
    log = [(1, "p", "create", None, " about ", None, None), (2, "p", "update", 1, "new", 30, "brief"), (3, "p", "update", 1, "stale", None, None), (4, "p", "update", 2, " ", None, None), (5, "p", "update", 2, None, 400, None),
           (6, "p", "create", None, "x", None, None), (7, "q", "update", 1, "x", None, None), (8, "p", "update", 2, None, None, "long"), (9, "p", "update", 2, None, 1, None), (10, None, "create", None, "x", None, None)]
    state, rejected = registry.fold_profiles(spark.createDataFrame(log, CHANGES))
    got = {r.profile_id: tuple(r)[1:] for r in state.collect()}
    assert got == {"p": (3, "new", 1, "brief"), "q": (0, None, 7, "normal")}
    assert {r.seq: r.reason for r in rejected.collect()} == {3: "stale_version", 4: "blank_description", 5: "freshness_range", 6: "exists", 7: "missing", 8: "summary_length", 10: "no_profile"}


def folded(log: list[tuple]) -> tuple[dict, dict]:
    """The same one change after the other."""
    state, rejected = {}, {}
    for seq, p, op, expected, about, days, length in sorted(log):
        s = state.setdefault(p, [0, None, 7, "normal"])
        new = op == "create"
        why = ("exists" if new and s[0] else "missing" if not new and not s[0] else "stale_version" if not new and expected != s[0] else "blank_description" if new and about is None or about is not None and not about.strip()
               else "freshness_range" if days is not None and not 1 <= days <= 365 else "summary_length" if length not in (None, "brief", "normal", "detailed") else None)
        if why:
            rejected[seq] = why
        else:
            state[p] = [s[0] + 1, s[1] if about is None else about.strip(), s[2] if days is None else days, length or s[3]]
    return state, rejected


def test_long_profile_log(spark):
    """One profile with most changes, most of them stale or unfit, against a fold in order."""
    rng, log, at = random.Random(5), [], {}
    for seq in range(1500):
        p = "hot" if rng.random() < 0.8 else f"p{rng.randrange(20)}"
        op = "create" if rng.random() < 0.2 else "update"
        expected = max(0, at.get(p, 0) + rng.choice([0, 0, 0, 0, -1, 1, -3]))
        row = (seq, p, op, rng.choice([expected] * 9 + [None]), rng.choice([None, "a", f" about {seq} ", "b", " "]), rng.choice([None, None, 5, 365, 400]), rng.choice([None, "brief", "detailed", "brief", "long"]))
        log.append(row)
        at[p] = folded([x for x in log if x[1] == p])[0][p][0] if seq % 5 == 0 else at.get(p, 0)
    state, rejected = registry.fold_profiles(spark.createDataFrame(rng.sample(log, len(log)), CHANGES))
    want, bad = folded(log)
    assert want["hot"][0] > 50 and {r.profile_id: list(r)[1:] for r in state.collect()} == want
    assert {r.seq: r.reason for r in rejected.collect()} == bad


def test_tables(spark, tmp_path):
    t = tables.Table(spark, f"file://{tmp_path}/t")
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (2, "c", 2), (None, "d", 3), (None, "e", 4)], "k int, v string, o int")
    assert t.read() is None and t.read(df.schema).count() == 0
    values = lambda: sorted(r.v for r in t.read().collect())
    for _ in range(2):  # a batch that is repeated replaces its rows
        tables.append_first_wins(df, t, ["k"], ["o"], "b1")
        assert values() == ["b", "c", "d", "e"]
    tables.append_first_wins(df.where("k IS NOT NULL").union(spark.createDataFrame([(3, "f", 0)], df.schema)), t, ["k"], ["o"], "b2")
    assert values() == ["b", "c", "d", "e", "f"] and t.read(df.schema, besides="b2").count() == 4
    t.append(df.limit(0), "b3")
    assert values() == ["b", "c", "d", "e", "f"]


def test_cursor_rules(spark):
    sources = [("a", "website", "native_rss", (NOW, "x", None)), ("b", "telegram", "web_preview", (NOW, "x", None)), ("c", "website", "nope", None), ("d", "website", "telethon", None), ("e", "telegram", "telethon", (None, None, 4))]
    df = spark.createDataFrame(sources, "id string, kind string, collector string, cursor struct<published_at:timestamp,external_id:string,message_id:long>")
    assert {(r.id, r.rule) for r in ingest.audit_sources(df).collect()} == {("b", "cursor_kind"), ("c", "unknown_collector"), ("d", "collector_kind")}
    assert contracts.violations(df, contracts.cursors()).count() == 0
    half = spark.createDataFrame([("z", (NOW, None, None)), ("y", (NOW, "x", 3))], "id string, cursor struct<published_at:timestamp,external_id:string,message_id:long>")
    assert contracts.violations(half, contracts.cursors()).count() == 2


ITEMS = "source_id string, external_id string, published_at timestamp, text string, batch_pos long"


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(3)}", str(i), NOW + dt.timedelta(minutes=i), f"text {rng.randrange(20)}", i) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], ITEMS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landing")
        stream = jobs.FeedTables(spark, f"file://{tmp_path}/stream")
        jobs.run_available(spark, f"{tmp_path}/landing", ITEMS, stream, f"{tmp_path}/checkpoint", files_per_batch=1)
    batch = jobs.FeedTables(spark, f"file://{tmp_path}/batch")
    jobs.backfill(spark, f"{tmp_path}/landing", ITEMS, batch, "1")
    jobs.backfill(spark, f"{tmp_path}/landing", ITEMS, batch, "1")  # a replay
    jobs.backfill(spark, f"{tmp_path}/landing", ITEMS, batch, "2")  # everything is known
    for a, b in ((stream.materials.read(), batch.materials.read()), (stream.links.read(), batch.links.read()), (stream.latest_cursors(), batch.latest_cursors())):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))
    jobs.run_available(spark, f"{tmp_path}/landing", ITEMS, stream, f"{tmp_path}/checkpoint")
    assert stream.materials.read().count() == 60


def test_stateful_streams(spark, tmp_path):
    rows = [("s", str(i), NOW + dt.timedelta(minutes=i), f"t{i % 5}", i) for i in range(20)]
    spark.createDataFrame(rows, ITEMS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ITEMS).parquet(f"{tmp_path}/in")
    for by_message in (False, True):
        kept = tables.Table(spark, f"file://{tmp_path}/cursors-{by_message}")
        jobs.run_cursors(spark, f"{tmp_path}/in", ITEMS, kept, f"{tmp_path}/c-{by_message}", by_message)
        # what lands later and lies before moves nothing, what has no number or date neither
        old = [("s", "3", NOW, "t", 0), ("s", "x" if by_message else None, NOW + dt.timedelta(days=9), "t", 0), ("new", "7", NOW, "t", 0)]
        spark.createDataFrame(old, ITEMS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.run_cursors(spark, f"{tmp_path}/in", ITEMS, kept, f"{tmp_path}/c-{by_message}", by_message)
        rows = kept.read(jobs.CURSORS).collect()
        assert sorted((r.source_id, r.cursor.message_id if by_message else r.cursor.external_id) for r in rows) == ([("new", 7), ("s", 19)] if by_message else [("new", "7"), ("s", "19")])
    query = jobs.deduplicated_stream(stream).writeStream.format("memory").queryName("unique_out").option("checkpointLocation", f"{tmp_path}/c2").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("unique_out").count() == 6
