"""URL filter, chat formatting, components, and the pipeline."""

import os
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from digestflow.llm import mixing, queries, tool_calls, url_filter
from digestflow.llm._shared import WORD
from digestflow.llm.components import components

SF = "/root/testdata/sf0.001"


def test_rules(frame):
    urls = ["https://A.example.net/en/1", "http://example.net/fr/1?x", "http://x.example.com/de/", "http://x.example.com/en", "http://a.org/fr/2#t", "http://a.org/en/",
            None, "no url", "http://notexample.net", "http://net/", "ftp://net?/en/"]
    rows = frame([(i, u, None, "h") for i, u in enumerate(urls)], "id long, url string, bad int, host string")
    got = {r.id: r for r in url_filter.judge(rows, queries.URL_RULES).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None, None, "net/", None]
    assert [got[i].verdict for i in range(6)] == ["allow", "block", "block", "allow", "allow", "allow"]
    assert (got[0].host, got[0].path, got[6].host, got[6].path, got[10].host, got[10].path) == ("a.example.net", "/en/1", "", "", "net", "")


def test_reputation_shrinks(frame):
    rows = [(i, f"http://bad.spam.test/{i}", 1) for i in range(40)] + [(100 + i, f"http://h{i}.fine.test/", i % 10 == 0) for i in range(200)] + [(500, "http://new.fine.test/", 1)]
    got = {r.id: r.verdict for r in url_filter.judge(frame([(a, b, int(c)) for a, b, c in rows], "id long, url string, bad int"), ()).collect()}
    assert got[0] == "block" and got[500] == "allow" and got[100] == "allow"
    assert url_filter.judge(frame([], "id long, url string, bad int"), ()).count() == 0


def test_domains(frame):
    from pyspark.sql import functions as F

    given = {
        "www.shop.co.uk": ("shop.co.uk", "co.uk"), "u:p@a.b.example.com:8080": ("example.com", "com"), "10.0.0.1:80": ("10.0.0.1", "(numeric)"), "[::1]:80": ("[::1]", "(numeric)"),
        "co.uk": ("co.uk", "uk"), "localhost": ("localhost", "localhost"), "": ("", ""), "x.example.org.": ("example.org", "org"), "a.com.example": ("com.example", "example"),
    }
    got = frame([(h,) for h in given], "h string").select("h", url_filter.domain_of(F.col("h")).alias("d"), url_filter.suffix_of(F.col("h")).alias("s")).collect()
    assert {r.h: (r.d, r.s) for r in got} == given


def test_judge_of_awkward_rows(frame):
    """Null and repeated ids, rules of equal length, and evidence beside every verdict."""
    rows = [(None, None, None), (1, "http://b.test/cc/", 1), (1, "http://b.test/cc/", 0), (2, "http://a.b.test/c/", None)]
    got = url_filter.judge(frame(rows, "id long, url string, bad int"), (("block", "b.test/c"), ("allow", "a.b.test"), ("allow", "test/cc/d")))
    assert sorted((r.id or 0, r.rule or "", r.verdict, r.n) for r in got.collect()) == [(0, "", "allow", 0), (1, "b.test/c", "block", 2), (1, "b.test/c", "block", 2), (2, "a.b.test", "allow", 0)]
    rules = [("block", f"h{i}.test/") for i in range(3000)]
    many = url_filter.judge(frame([(i, f"http://www.h{i}.test/x", None) for i in range(0, 4000, 500)], "id long, url string, bad int"), rules)
    assert {r.id for r in many.collect() if r.verdict == "block"} == {0, 500, 1000, 1500, 2000, 2500}


EVENTS = "conv long, turn long, kind string, call_id string, name string, arguments string, after array<string>, content string"
SCHEMA = {"f": {"x": "integer", "y": "string", "o": "string?"}}


def test_tool_calls(frame):
    rows = [
        (1, 0, "call", "a", "f", '{"y":"s","x":1}', [], None), (1, 1, "result", "a", None, None, None, "ok"), (1, 2, "call", "b", "f", '{"y":"s"}', ["a"], None),
        (1, 3, "call", "c", "f", '{"x":1.5,"y":"s","z":0}', ["b", "a", "nope"], None), (1, 4, "result", "c", None, None, None, "1"), (1, 5, "result", "c", None, None, None, "2"),
        (1, 6, "result", "zz", None, None, None, "2"), (1, 7, "call", "a", "f", '{"x":1,"y":"s"}', [], None), (2, 0, "call", "p", "g", "not json", ["q"], None),
        (2, 1, "call", "q", "f", "[1]", ["p"], None), (2, 2, "message", None, None, None, None, "hi"), (2, 3, "call", None, None, None, None, None),
    ]
    got = {(r.conv, r.turn): r for r in tool_calls.link(frame(rows, EVENTS), SCHEMA).collect()}
    assert [got[1, t].status for t in range(8)] == ["linked", "linked", "invalid", "invalid", "linked", "repeated", "orphan", "repeated"]
    assert [(got[1, t].place, got[1, t].step) for t in range(8)] == [(0, 0), (0, 0), (2, 0), (3, 0), (3, 0), (3, 0), (None, None), (0, 0)]
    assert got[2, 0].place is None and got[2, 1].status == "invalid" and got[2, 2].status == "message" and got[2, 3].status == "invalid"
    assert got[1, 0].json == '{"arguments":{"x":1,"y":"s"},"conv":1,"id":"a","kind":"call","name":"f","place":0,"status":"linked","step":0,"turn":0}'
    assert '"faults":["x is missing"]' in got[1, 2].json and '"faults":["extra z","x is no integer"]' in got[1, 3].json
    assert tool_calls.link(frame([], EVENTS), SCHEMA).count() == 0
    nulls = [(None, 0, "call", "a", "f", None, None, None), (None, 1, "result", "a", None, None, None, "x"), (3, None, "call", "a", "f", '{"x":1,"y":"s"}', None, None), (3, 1, None, "a", None, None, None, "x")]
    assert sorted(r.status for r in tool_calls.link(frame(nulls, EVENTS), SCHEMA).collect()) == ["invalid", "message", "orphan", "unanswered"]


def test_argument_types(frame):
    """Names with dots and quotes, integers of any size and spelling, and what is none."""
    schemas = {"f": {"a.b": "integer", "it's": "number?", "$[0]": "string?"}}
    given = {
        '{"a.b":1}': [], '{"a.b":123456789012345678901}': [], '{"a.b":1.0}': [], '{"a.b":-2.50}': ["a.b is no integer"], '{"a.b":1e3}': [], '{"a.b":1.5e300}': [], '{"a.b":1.5e-3}': ["a.b is no integer"],
        '{"a.b":"1"}': ["a.b is no integer"], '{"a.b":null}': ["a.b is no integer"], '{"a.b":true}': ["a.b is no integer"], '{"a":{"b":1}}': ["extra a", "a.b is missing"],
        '{"a.b":0,"it\'s":1.25,"$[0]":"x"}': [], '{"a.b":0,"it\'s":"x"}': ["it's is no number"], '{"a.b":[1]}': ["a.b is no integer"],
    }
    rows = frame([("f", a) for a in given], "name string, arguments string")
    got = rows.select("arguments", tool_calls.argument_faults(rows["name"], rows["arguments"], schemas).alias("faults")).collect()
    assert {r.arguments: list(r.faults) for r in got} == given
    with pytest.raises(ValueError):
        tool_calls.argument_faults(rows["name"], rows["arguments"], {"f": {"a'\"b": "string"}})


def test_call_order(frame):
    """Calls that wait for later ones move behind them; cycles and what waits for them get no place."""
    waits = {("a", 0): ["b"], ("b", 1): ["c"], ("c", 2): [], ("d", 3): ["a"], ("p", 4): ["q"], ("q", 5): ["p"], ("r", 6): ["p", "c"], ("s", 7): ["s"]}
    rows = [(1, c, t, w) for (c, t), w in waits.items()] + [(2, f"n{i}", i, [f"n{i - 1}"]) for i in range(300)]
    got = {(r.conv, r.call_id): (r.place, r.step) for r in tool_calls.call_order(frame(rows, "conv long, call_id string, call_turn long, after array<string>")).collect()}
    assert [got[1, c] for c in "abcd"] == [(2, 2), (2, 1), (2, 0), (3, 0)] and all(got[1, c] == (None, None) for c in "pqrs")
    assert all(got[2, f"n{i}"] == (i, 0) for i in range(300))


def test_components(frame):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7), (300, 301), (301, 300)]
    got = {(r.node, r.root) for r in components(frame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(51)} | {(100, 100), (200, 100), (150, 100), (300, 300), (301, 300)}
    assert components(frame([], "a long, b long")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_rows = lambda df: sorted(tuple(map(str, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))
    assert as_rows(got) == as_rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark):
    """run() against brute force: copies, near copies, shares of the sources, and every row's tokens."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = corpus_pipeline.known_language(spark, docs, SF)
    assert told.columns == docs.columns
    rows = {r.doc_id: r for r in told.collect()}
    assert set(rows) == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text), i)
    unique = sorted(first.values())
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})(re.findall(WORD, rows[i].text)) for i in unique}
    least = {i: i for i in unique}
    links = [(i, j) for i in unique for j in unique if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in unique:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    left = {i for i in unique if least[i] == i}
    sizes = Counter()
    for i in left:
        sizes[rows[i].source] += len(re.findall(WORD, rows[i].text))
    sources = sorted(sizes)
    targets = dict(zip(sources, mixing.share_out([sizes[s] for s in sources], [(5, 2, 1)[k % 3] for k in range(len(sources))])))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words, times = Counter(), Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        text = tokenizer.decode(r.token_ids, skip_special_tokens=False)
        assert r.doc_id in left and tokenizer.encode(text, add_special_tokens=False).ids == r.token_ids and r.n_tokens == len(r.token_ids)
        own = re.findall(WORD, text)
        assert text == rows[r.doc_id].text or not Counter(own) - Counter(re.findall(WORD, rows[r.doc_id].text))
        words[r.source] += len(own)
        times[r.doc_id] += 1
    assert max(times.values()) <= 3 and all(abs(words[s] - targets[s]) <= 64 for s in sources)


def test_pipeline_of_awkward_rows(spark, frame, tmp_path):
    """Nulls, blank texts, repeated rows and ids, clashing extra columns, and an empty table."""
    import corpus_pipeline

    text = "plain words of a text that is long enough to have several runs of five words in it"
    rows = [(1, text, "en", "s", 9, "k"), (1, text, "en", "s", 9, "k"), (2, text + " more", "en", "s", 9, "k"), (2, "another text altogether with the same id as one before", None, None, None, None),
            (None, None, None, None, None, None), (3, "", "en", "s", 0, "k"), (4, " \n", "en", "s", 0, "k"), (5, "123", "en", "s", 0, "k"), (None, "words without any id at all", "en", "t", 0, "k")]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, rec string"
    for name, given in (("some", rows), ("none", [])):
        frame(given, ddl).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        if given:
            # the near copy (2) and the repeated row go; the other row with id 2 stays
            assert {r.doc_id for r in got} <= {1, 2, None} and all(r.n_tokens == len(r.token_ids) for r in got)
            docs = corpus_pipeline.known_language(spark, spark.read.parquet(f"{tmp_path}/{name}/documents.parquet"), "")
            left = corpus_pipeline.without_near_copies(spark, corpus_pipeline.without_copies(spark, docs, ""), "")
            assert sorted((r.doc_id or 0, r.text[:5]) for r in left.collect()) == [(0, "words"), (1, "plain"), (2, "anoth")]
        else:
            assert got == []
