import re

from veilmill.llm import components as stars
from veilmill.llm import ngram_join
from veilmill.llm.common import written


def test_plans_of_components_stay_small(spark, monkeypatch):
    exchanges = []

    def seen(df, label):
        exchanges.append(len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString())))
        return written(df, label)

    monkeypatch.setattr(stars, "written", seen)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3)]
    got = dict(stars.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert max(exchanges) <= 5


def test_only_survivors_texts_and_a_few_others_move(spark):
    texts = spark.range(-3000, 3000).selectExpr("id as doc_id", "if(id % 7 = 0, null, concat('text ', id)) as text").union(spark.createDataFrame([(None, "x"), (5, "again")], "doc_id bigint, text string"))
    chosen = spark.range(-3000, 3000, 100).selectExpr("id + 5 as _id")
    rows = [tuple(r) for r in ngram_join._perhaps(texts, chosen).collect()]
    wanted = {r[0] for r in chosen.collect()}
    assert sorted(r for r in map(str, rows) if r in {str(tuple(x)) for x in texts.where("doc_id is not null").collect() if x[0] in wanted}) == sorted(str(tuple(x)) for x in texts.collect() if x[0] in wanted)
    assert len(rows) < 200


def test_members_of_one_token_group_link_over_many_leaders(spark):
    # All share the rarest tokens, but only every 30th links to the next such one, whatever the ranks of both.
    from tests.llm.test_corpus import docs_of  # noqa: PLC0415

    common = [f"c{i}" for i in range(12)]
    texts = [" ".join(common + [f"w{k % 30}x{j}" for j in range(60)] + [f"own{k}"]) for k in range(90)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {k: k % 30 for k in range(90)}
