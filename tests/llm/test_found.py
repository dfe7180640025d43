"""The named queries: against their SQL where there is one, else against brute force and the properties that TESTDATA states."""

import os
import unicodedata

import duckdb
import pyarrow.parquet as pq
import pytest

from emberframe.llm.queries import LLM, SHARES
from tests.test_queries import canon

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def run(spark, name):
    return LLM.queries[name](spark, DATA).toPandas()


def read(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pandas()


@pytest.mark.parametrize("name", sorted(LLM.sql))
def test_query(spark, con, name):
    got, want = run(spark, name), con.sql(LLM.sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


def test_p1_splits(spark):
    got = run(spark, "p1_splits")
    assert got["sample_id"].is_unique and got["sample_id"].nunique() == read("samples")["sample_id"].nunique()
    fires = got.dropna(subset=["fire"])
    assert fires.groupby("fire")["split"].nunique().max() == 1 and got.groupby("component")["split"].nunique().max() == 1
    # A heavy fire can't be cut, so shares may miss by half of the heaviest one.
    largest = got.groupby("component").size().max() / len(got)
    for s, w in SHARES.items():
        assert abs((got["split"] == s).mean() - w) < max(0.05, largest)
    balance = run(spark, "p1_balance")
    assert balance[balance["level"] == "all"].set_index("split")["n"].to_dict() == got["split"].value_counts().to_dict()


def test_p3_sample(spark):
    p = read("picked").dropna(subset=["fire_id", "day_t"])
    p = p[(p["region_id"] > 0) & (p["fire_type"] >= 0)]
    keys = p.sort_values(["region_id", "fire_type"]).drop_duplicates(["fire_id", "day_t"])
    have = keys.groupby(["region_id", "fire_type"]).size()
    n, got = len(keys) / 10, run(spark, "p3_sample")
    assert not got.duplicated(["fire_id", "day_t"]).any()
    drawn = got.groupby(["region_id", "fire_type"]).size()
    minima = 0
    for t in read("target_mix").itertuples():
        k = (t.region_id, t.fire_type)
        assert drawn.get(k, 0) >= min(t.min_rows, have.get(k, 0))
        minima += min(t.min_rows, have.get(k, 0))
    assert len(got) == max(int(n + 0.5), minima)
    report = run(spark, "p3_balance")
    assert report.set_index(["region_id", "fire_type"])["drawn"].sum() == len(got)
    long = report[report["drawn"] >= 5]
    assert (abs(long["sample_mean"] - long["pool_mean"]) < 2.5).all()


def test_p8_mix(spark):
    mix, report = run(spark, "p8_mix"), run(spark, "p8_shares").set_index("source")
    assert mix["doc_id"].is_unique and (mix["copies"] >= 1).all()
    sums = (mix["tokens"] * mix["copies"]).groupby(mix["source"]).sum()
    largest = mix["tokens"].max()
    for s, r in report.iterrows():
        assert sums.get(s, 0) == r["mixed"]
        if r["target_share"] > 0 and s in sums:
            assert mix[mix["source"] == s]["copies"].max() <= r["max_repeats"]
            want = min(r["wanted"], r["available"] * r["max_repeats"])
            assert abs(r["mixed"] - want) <= largest
    assert abs(report["actual_share"].sum() - 1) < 1e-9


def grams(text, n_words=12, n_chars=20):
    """Runs of words and, in Han and kana, of characters, by another way of folding than the operator's."""
    t = "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()) if not unicodedata.combining(c) and unicodedata.category(c)[0] != "M")
    w = "".join(c if c.isalnum() else " " for c in t).split()
    c = "".join(w)
    return {tuple(w[i : i + n_words]) for i in range(len(w) - n_words + 1)}, {c[i : i + n_chars] for i in range(len(c) - n_chars + 1)}


def test_p7_found(spark):
    docs, items = read("documents"), read("eval_passages")
    want = set()
    held = {d: grams(t) for d, t in zip(docs["doc_id"], docs["text"]) if t}
    for i, lang, t in zip(items["item_id"], items["lang"], items["text"]):
        w, c = grams(t)
        for d, (dw, dc) in held.items():
            if (c & dc) if lang in ("zh", "ja") else (w & dw):
                want.add((d, i))
    got = run(spark, "p7_found")
    assert set(got.itertuples(index=False, name=None)) == want and want
    leaks, by_item = run(spark, "p7_leaks"), run(spark, "p7_items")
    assert set(zip(leaks["doc_id"], leaks["item_id"])) == want and (leaks["share"] <= 1).all() and (leaks["covered"] >= leaks["longest"].clip(upper=12)).all()
    assert by_item["n_docs"].sum() == len(want)


def test_p7_cleaned(spark):
    from emberframe.llm.automaton import find_passages

    docs, got = read("documents").set_index("doc_id"), run(spark, "p7_cleaned").set_index("doc_id")
    leaked = set(run(spark, "p7_found")["doc_id"])
    assert set(got.index) == set(docs.index) and set(got.index[got["action"] != "keep"]) == leaked
    for d, r in got.iterrows():
        text = docs.loc[d, "text"]
        if r["action"] == "keep":
            assert r["text"] == text
        elif r["action"] == "cut":
            assert len(r["text"]) == len(text) - r["removed_chars"] and r["removed_chars"] <= len(text) / 2
            rest = iter(text)
            assert all(c in rest for c in r["text"])
    kept = spark.createDataFrame(got[got["action"] == "cut"].reset_index()[["doc_id", "text"]])
    again = find_passages(kept, spark.read.parquet(f"{DATA}/eval_passages.parquet")).toPandas()
    # What is left may meet at a cut; there are no passages but across cuts.
    assert len(again) <= 0.02 * max(1, len(kept.collect()))


def test_p9_sentences(spark):
    docs = read("documents").set_index("doc_id")["text"]
    got = run(spark, "p9_sentences").sort_values(["doc_id", "sentence_no"])
    found = run(spark, "p9_found")
    assert sorted(zip(found["doc_id"], found["end_char"])) == sorted(zip(got["doc_id"], got["end_char"]))
    assert set(got["doc_id"]) == {d for d, t in docs.items() if t and t.strip()}
    for d, part in got.groupby("doc_id"):
        text, at = docs[d], 0
        assert part["sentence_no"].tolist() == list(range(1, len(part) + 1))
        for a, b in zip(part["start_char"], part["end_char"]):
            assert not text[at:a].strip() and a < b and text[a:b] == text[a:b].strip()
            at = b
        assert not text[at:].strip()
