import re
from collections import Counter

from kindred.llm import quality_rules as Q
from tests.llm.cases import awkward, none


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), len("".join(words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed)


def test_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    for r in Q.rule_counts(docs).collect():
        assert tuple(r[c] for c in [*Q.COUNTS[:1], "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]) == brute(r["text"] or "")


def test_hosts_and_keep(spark):
    good, bad = "a good text about many different things that nobody has said before now", "bad"
    rows = [(i, f"{good} {i}", "clean") for i in range(100)] + [(100 + i, bad if i < 90 else f"{good} {i}", "dirty") for i in range(100)] + [(200 + i, bad, None) for i in range(50)] + [(300, f"{good} x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in Q.quality_rules(docs).collect()}
    assert all(out[i]["kept"] for i in range(100))
    assert not any(out[i]["kept"] for i in range(100, 200)) and out[195]["host_rejected"] and not out[195]["base_failed"]
    assert out[300]["kept"]  # no host, no verdict
    assert {r["doc_id"] for r in Q.keep(docs).collect()} == {*range(100), 300}


def test_shrinkage(spark):
    rows = [(i, "bad", "small") for i in range(2)] + [(10 + i, "words that differ from each other in every one of these ten texts " + str(i), "large") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {r["__qr_host"]: r["base_rate"] for r in Q.host_rates(Q.rule_counts(docs)).collect()}
    assert 0 < rates["large"] < 0.1 and rates["small"] < 1


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    out = Q.quality_rules(docs)
    assert out.count() == docs.count()
    assert Q.keep(docs).columns == docs.columns
    assert Q.keep(none(spark)).count() == 0 == Q.quality_rules(none(spark)).count()


def test_no_python_in_plan(spark, sf_dir):
    from kindred.llm import queries

    plan = queries.op9_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_domain(spark):
    urls = ["https://WWW.Example.org/a?b=c", "http://user@news.example.org:8080/x", "no url", "", None, "ftp://www2.a.b"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(Q.domain(Q.F.col("url")).alias("d"))
    assert [r["d"] for r in got.collect()] == ["example.org", "news.example.org", None, None, None, "www2.a.b"]


def test_keep_agrees_with_the_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    want = sorted((r["doc_id"] or -1) for r in Q.quality_rules(docs).filter("kept").collect())
    kept = Q.keep(docs)
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == want and kept.columns == docs.columns
    assert kept.exceptAll(docs).count() == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
