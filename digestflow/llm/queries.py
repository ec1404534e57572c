"""The registered queries of the training-data operators, with oracle SQL where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from . import (
    bpe_codec, exact_dedup, fingerprints, jaccard_join, language_id, mixing, periodic_runs, suffix_dedup, token_counts, token_files, tool_calls, turn_repair,
    url_filter,
)
from ._shared import WORD, shared_dir


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe_codec(spark, sf_dir):
    encoded = bpe_codec.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.drop("token_ids").withColumnRenamed("id", "doc_id")


URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op2_url_filter(spark, sf_dir):
    """A page's outcome is the label of the document that its url numbers: bad if toxic or of low quality."""
    pages = _read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), "url", F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS bigint)").alias("doc_id")
    )
    bad = F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0))
    labels = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(bad.alias("bad"))
    judged = url_filter.judge(pages.join(labels, "doc_id", "left"), URL_RULES).withColumnRenamed("id", "page_id")
    return judged.withColumns({"mean": F.round("mean", 6), "low": F.round("low", 6)})


OP2_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS bigint) AS doc_id FROM pages),
l AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, array_to_string(string_split(host, '.')[-2:], '.') AS domain,
    string_split(host, '.')[-1] AS suffix FROM p LEFT JOIN l USING (doc_id) GROUP BY host),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
c AS (SELECT (sum(k) + 0.5) / (sum(n) + 1) AS p FROM s),
sr AS (SELECT 1 / least(0.9, greatest(0.01, coalesce((sum((k - n * p) * (k - n * p)) - sum(n * p * (1 - p))) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), 0.01))) - 1 AS m FROM s, c),
sm AS (SELECT suffix, (m * p + k) / (m + n) AS p FROM s, c, sr),
dr AS (SELECT 1 / least(0.9, greatest(0.01, coalesce((sum((k - n * p) * (k - n * p)) - sum(n * p * (1 - p))) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), 0.01))) - 1 AS m FROM d JOIN sm USING (suffix)),
dm AS (SELECT suffix, domain, (m * p + k) / (m + n) AS p FROM d JOIN sm USING (suffix), dr),
hr AS (SELECT 1 / least(0.9, greatest(0.01, coalesce((sum((k - n * p) * (k - n * p)) - sum(n * p * (1 - p))) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), 0.01))) - 1 AS m FROM h JOIN dm USING (suffix, domain)),
hm AS (SELECT host, n, k, (m * p + k) / (m + n) AS p, m + n AS t FROM h JOIN dm USING (suffix, domain), hr),
hl AS (SELECT hm.*, greatest(0, p - 1.645 * sqrt(p * (1 - p) / (t + 1))) AS low FROM hm),
r AS (SELECT p.*, p.page_id AS id, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN low > (SELECT p FROM c) THEN 'block' ELSE 'allow' END AS verdict, n, CAST(k AS BIGINT) AS k, round(hl.p, 6) AS mean, round(low, 6) AS low
FROM r JOIN hl USING (host)
"""


def op3_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return found.drop("spans", "kept").withColumnRenamed("id", "doc_id")


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_groups(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


REPLY_SCHEMA = {"reply": {"prompt": "string", "turn": "integer", "system": "string?"}}


def op5_chat_formatting(spark, sf_dir):
    """The given turns as calls and results of a tool ``reply``: a user's turn calls it, the assistant's next turn answers.

    So that calls come out of order, repeat and fail, as they do in logs: the fourth of each four calls takes the first
    one's identifier; by the length of its text, a call waits for the next one, for the one before or for none, lacks its
    prompt, gives its turn as text, or has arguments that are no JSON.
    """
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    user, assistant, text = F.col("role") == "user", F.col("role") == "assistant", F.coalesce("text", F.lit(""))

    def identifier(turn):
        return f"concat('c', ({turn}) div 8 * 4 + (({turn}) div 2 % 4) % 3)"

    n = F.char_length(text)
    arguments = (
        F.when(n % 11 == 0, F.concat(F.lit("prompt="), text))
        .when(n % 5 == 0, F.to_json(F.struct("turn")))
        .when(n % 5 == 1, F.to_json(F.struct(F.col("turn").cast("string").alias("turn"), text.alias("prompt"))))
        .otherwise(F.to_json(F.struct("turn", text.alias("prompt"))))
    )
    after = F.when(n % 3 == 0, F.array(F.expr(identifier("turn + 2")))).when((n % 3 == 1) & (F.col("turn") > 1), F.array(F.expr(identifier("turn - 2"))))
    events = turns.select(
        "conv", "turn",
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        F.when(user, F.expr(identifier("turn"))).when(assistant, F.expr(identifier("greatest(turn - 1, 0)"))).alias("call_id"),
        F.when(user, "reply").alias("name"),
        F.when(user, arguments).alias("arguments"),
        F.when(user, after).alias("after"),
        F.when(~user, F.col("text")).alias("content"),
    )
    linked = tool_calls.link(events, REPLY_SCHEMA).withColumnRenamed("conv", "conv_id")
    # no place: -1, which both sides of a comparison show alike
    return linked.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("place", "step")})


OP5_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn::BIGINT AS turn, role, text, coalesce(text, '') AS s, length(coalesce(text, '')) AS n FROM conversations),
e AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN concat('c', turn // 8 * 4 + (turn // 2 % 4) % 3)
              WHEN 'assistant' THEN concat('c', greatest(turn - 1, 0) // 8 * 4 + (greatest(turn - 1, 0) // 2 % 4) % 3) END AS id,
    CASE WHEN n % 3 = 0 THEN concat('c', (turn + 2) // 8 * 4 + ((turn + 2) // 2 % 4) % 3)
         WHEN n % 3 = 1 AND turn > 1 THEN concat('c', (turn - 2) // 8 * 4 + ((turn - 2) // 2 % 4) % 3) END AS before FROM t),
c AS (SELECT conv_id, id, min(turn) AS call_turn, arg_min(struct_pack(b := before), turn).b AS before FROM e WHERE kind = 'call' GROUP BY ALL),
a AS (SELECT conv_id, id, min(turn) AS answer_turn FROM e JOIN c USING (conv_id, id) WHERE kind = 'result' AND turn >= call_turn GROUP BY ALL),
w AS (SELECT c.conv_id, c.id, d.id AS before FROM c JOIN c d ON d.conv_id = c.conv_id AND d.id = c.before),
r AS (SELECT conv_id, id, id AS far, 0 AS steps FROM c
      UNION SELECT r.conv_id, r.id, w.before, steps + 1 FROM r JOIN w ON w.conv_id = r.conv_id AND w.id = r.far WHERE steps < 9),
o AS (SELECT r.conv_id, r.id, bool_or(steps = 9) AS never, max(d.call_turn) AS place, max(struct_pack(p := d.call_turn, s := steps)).s AS step
      FROM r JOIN c d ON d.conv_id = r.conv_id AND d.id = r.far GROUP BY ALL),
k AS (SELECT c.conv_id, c.id, call_turn, answer_turn, CASE WHEN NOT never THEN place END AS place, CASE WHEN NOT never THEN step END AS step
      FROM c JOIN o USING (conv_id, id) LEFT JOIN a USING (conv_id, id)),
f AS (SELECT e.*, place, step, call_turn, answer_turn, CASE WHEN kind <> 'call' THEN NULL WHEN n % 11 = 0 THEN 'arguments are no object'
      WHEN n % 5 = 0 THEN 'prompt is missing' WHEN n % 5 = 1 THEN 'turn is no integer' END AS fault FROM e LEFT JOIN k USING (conv_id, id)),
s AS (SELECT *, CASE kind WHEN 'call' THEN CASE WHEN turn > call_turn THEN 'repeated' WHEN fault IS NOT NULL THEN 'invalid'
          WHEN answer_turn IS NULL THEN 'unanswered' ELSE 'linked' END
      WHEN 'result' THEN CASE WHEN call_turn IS NULL OR turn < call_turn THEN 'orphan' WHEN turn > answer_turn THEN 'repeated' ELSE 'linked' END
      ELSE 'message' END AS status FROM f)
SELECT conv_id, turn, kind, id AS call_id, coalesce(place, -1) AS place, coalesce(step, -1)::BIGINT AS step, status, '{' || concat_ws(',',
    CASE WHEN kind = 'call' THEN '"arguments":' || CASE WHEN n % 11 = 0 THEN '{"text":' || to_json('prompt=' || s)::VARCHAR || '}'
        WHEN n % 5 = 0 THEN '{"turn":' || turn || '}' WHEN n % 5 = 1 THEN '{"prompt":' || to_json(s)::VARCHAR || ',"turn":"' || turn || '"}'
        ELSE '{"prompt":' || to_json(s)::VARCHAR || ',"turn":' || turn || '}' END END,
    CASE WHEN kind <> 'call' THEN '"content":' || to_json(text)::VARCHAR END, '"conv":' || conv_id, '"faults":["' || fault || '"]', '"id":"' || id || '"',
    '"kind":"' || kind || '"', CASE WHEN kind = 'call' THEN '"name":"reply"' END, '"place":' || place, '"status":"' || status || '"', '"step":' || step,
    '"turn":' || turn) || '}' AS json
FROM s
"""


def op6_jaccard_join(spark, sf_dir):
    return jaccard_join.join(_read(spark, sf_dir, "documents"), n=5, tau=0.8).withColumnRenamed("id", "doc_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT l.b, r.r FROM r JOIN l ON l.a = r.a WHERE r.r < l.b)
SELECT d.doc_id, (SELECT min(r) FROM r WHERE r.a = d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
FROM documents d
"""


def op7_mix_sources(spark, sf_dir):
    mix = mixing.Mix(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), block=64)
    return mix.taken().select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op8_language_id(spark, sf_dir):
    return language_id.identify(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_token_counts(spark, sf_dir):
    counts = token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumnRenamed("id", "doc_id").withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_fingerprints(spark, sf_dir):
    return fingerprints.compare_edited(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def planted(docs):
    """docs with words repeated in every text whose h ends in 0: from word a on, those of a period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.expr(f"regexp_extract_all(text, r'{WORD}', 0)")).alias("w"))
    placed = words.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    period = placed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, get(w, cast(a + (i - a) % p AS int)))), ' ')")
    return period.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    found = periodic_runs.find_runs(planted(_read(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"], r.alias("run"))))["run"]
    lines = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("r", longest).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "r.start", "r.length", "r.period", F.expr("1000 * r.length div r.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged(rows):
    """conv, turn, role, text with rows dropped, emptied, cut off, repeated and given to the user by a hash of place."""
    plain = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn", "role", "text")}
    code = F.crc32(F.concat(plain["conv"], F.lit(":"), plain["turn"]).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(plain["text"], "[.!?]", "")).otherwise(plain["text"])
    marked = rows.select("conv", "turn", F.when(code == 4, "user").otherwise(plain["role"]).alias("role"), text.alias("text"), code.alias("code"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return marked.where("code <> 0").select("conv", "turn", "role", "text", copies.alias("copy")).drop("copy")


def op12_turn_repair(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "conv")
    return turn_repair.Repair(damaged(rows), rows).digests().withColumnRenamed("conv", "conv_id")


def op13_token_files(spark, sf_dir):
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    token_files.write(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return token_files.read(spark, folder).withColumnRenamed("id", "doc_id")


QUERIES = {"op2_url_filter": op2_url_filter, "op5_chat_formatting": op5_chat_formatting, "op3_suffix_dedup": op3_suffix_dedup, "op6_jaccard_join": op6_jaccard_join, "op10_fingerprints": op10_fingerprints, "op8_language_id": op8_language_id, "op1_bpe_codec": op1_bpe_codec, "op9_token_counts": op9_token_counts, "op7_mix_sources": op7_mix_sources, "op4_exact_dedup": op4_exact_dedup, "op11_periodic_runs": op11_periodic_runs, "op12_turn_repair": op12_turn_repair, "op13_token_files": op13_token_files}
ORACLE_SQL = {"op2_url_filter": OP2_SQL, "op5_chat_formatting": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op4_exact_dedup": OP4_SQL}
