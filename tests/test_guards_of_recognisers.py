import random

from pyspark.sql import functions as F

from veilmill import catalogue
from veilmill.operators import detect
from veilmill.operators.detect import COMPOSITE, GATES
from veilmill.plans.pseudonymise import resolved_spans

SAMPLES = [
    "a.b@mail1.example.com", "10.0.0.1", "255.255.255.255", "4111111111111111", "password = 'x'", "API_KEY:\n\t\"yy\"", "Secret:'a'", "+33 6 12 34 56 78", "+1 (555) 123-4567", "http://a.b/c", "https://x", "eyJab.cd.ef",
    "abcdefab-abcd-abcd-abcd-abcdefabcdef", "ab:cd:ef:ab:cd:ef", "a" * 40, "f" * 64, "0" * 40, "CVE-2020-1234", "db1.acme.internal", "x.io", "svc-a-prod", "2020-01-02", "ghp_" + "a" * 16, "github_pat_" + "a" * 20, "glpat-" + "a" * 16,
    "xoxb-" + "a" * 10, "sk-" + "a" * 20, "AKIA" + "A" * 16, "dop_v1_" + "a" * 32, "npm_" + "a" * 30, "FR76 3000 6000 0112 3456 7890 189", "DE89370400440532013000", "3 March 2020", "1er janvier 2020", "March 3rd, 2020", "DEC. 3 2020", "3/4/2020", "3.4.2020", "2020/4/3",
    *(f"{t} Jane Smith" for t in "M. Mr Mr. Mrs Mrs. Ms Ms. Mme Mme. Mlle Mlle. Dr Dr. Prof Prof. Herr Frau Señor Señora Sr. Sra.".split()), *(f"{n}: Paul Vries" for n in "name nom contact author auteur from by owner".split()),
    "12 rue de la Paix", "12bis, AVENUE Foch", "5 Baker Street", "Hauptstraße 7", "Mozartweg 7", "Marktplatz 1", "Berggasse 19", "Lindenallee 3", "Bergstrasse 4", "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----",
]


def test_no_guard_or_gate_loses_a_match(spark):
    """Samples of all recognisers, as they are, side by side, and cut or changed at random: what a pattern finds passes its guard and its gate."""
    r = random.Random(1)
    texts = SAMPLES + [f"{a} {b}" for a, b in zip(SAMPLES, SAMPLES[1:])]
    for _ in range(1500):
        s = list(r.choice(SAMPLES))
        for _ in range(r.randrange(3)):
            s[r.randrange(len(s))] = r.choice("0a Z.-:/é\n,'\"")
        texts.append("".join(s))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [F.col("text").rlike(x.pattern) for x in COMPOSITE]
    passes = [(F.col("text").rlike(x.guard or x.pattern)) & (GATES[x.gate](F.col("text")) if x.gate else F.lit(True)) & (F.exists(F.array(*map(F.lit, x.needs)), lambda n: F.contains("text", n)) if x.needs else F.lit(True)) for x in COMPOSITE]
    sums = df.agg(*(F.count_if(f).alias(f"f{i}") for i, f in enumerate(found)), *(F.count_if(f & ~p).alias(f"l{i}") for i, (f, p) in enumerate(zip(found, passes, strict=True)))).first()
    assert [x.name for i, x in enumerate(COMPOSITE) if not sums[f"f{i}"]] == []
    assert [x.name for i, x in enumerate(COMPOSITE) if sums[f"l{i}"]] == []


def test_spans_are_those_of_bare_patterns(spark):
    texts = [*SAMPLES, " ".join(SAMPLES), "\n".join(SAMPLES), "plain words only", "", "﷐ 10.0.0.1 ﷑ a@b.com"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bare = tuple(detect.Recogniser(x.name, x.kind, x.pattern, x.score) for x in COMPOSITE)
    rows = lambda recognisers: {r["doc_id"]: r["spans"] for r in resolved_spans(docs, recognisers).select("doc_id", "spans").collect()}
    got = rows(COMPOSITE)
    assert got == rows(bare) and sum(map(len, got.values())) > len(SAMPLES) and got[len(texts) - 3] == []


def test_texts_are_searched_once_and_by_all_tasks(spark, tmp_path):
    """One row group becomes as many tasks as there are, and no filter computes the spans again to see that there are any."""
    spark.createDataFrame([(i, "a@b.com and 10.0.0.1") for i in range(50)], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (catalogue.QUERIES["overlap_resolved"](spark, str(tmp_path)), catalogue._spans_table(spark, str(tmp_path))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "size(" not in "".join(x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Filter"))
        assert rows.rdd.getNumPartitions() >= 4 and rows.count() == 100
