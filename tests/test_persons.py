import re

from pyspark.sql import functions as F

from veilmill.operators import detect, persons, vault
from veilmill.plans import pseudonymise as plan

#: Texts with the bare names that must be found in them; titled ones are found by rule.
LABELLED = [
    ("Mr. John Smith signed.", []),
    ("Yesterday John Smith called again, then Smith left.", ["John Smith", "Smith"]),
    ("Contact Mme Claire Moreau or Dr. Jean de La Roche today.", []),
    ("Mail from Claire Moreau; Claire Smith and Jean Moreau replied to Jean de La Roche.", ["Claire Moreau", "Claire Smith", "Jean Moreau", "Jean de La Roche"]),
    ("Mr. Brown painted. Brown walls, brown doors, brown floors.", []),
    ("author: Ana Lopez", []),
    ("Ana Lopez\nwrote to Lopez.", ["Ana Lopez", "Lopez"]),
    ("John Smith Moreau and XJohn Smithson, John-Smith", ["John Smith Moreau"]),
    ("Apache License", []), ("", []), (None, []), ("𝄞 John  Smith", ["Smith"]),
]


def spans_of(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "_row bigint, text string")
    docs = docs.withColumn("spans", detect.spans_of("text", detect.COMPOSITE))
    taken = docs.select("_row", F.explode("spans").alias("s")).select("_row", "s.*")
    return docs, taken


def test_recall_and_precision_on_labelled_texts(spark):
    docs, taken = spans_of(spark, [t for t, _ in LABELLED])
    got = {}
    for r in persons.marked(docs, taken).collect():
        assert LABELLED[r["_row"]][0][r["start"]:r["end"]] == r["value"] or "𝄞" in LABELLED[r["_row"]][0]
        got.setdefault(r["_row"], []).append((r["start"], r["value"]))
    assert {i: [v for _, v in sorted(s)] for i, s in got.items()} == {i: w for i, (_, w) in enumerate(LABELLED) if w}


def test_windows_against_brute_force(spark):
    text = "Aa Bb Cc Dd Ee de Ff, Gg du hh Ii' Jj\nKk x Ll1 Mm_ Élan Ñu " + "Word " * 50
    token = re.compile(r"[^\W_]+(?:['’-]|[^\W_])*(?: (?:de |van |von |la |le |du )?)?")
    pieces = [(m.start(), m.end(), m.group()) for m in token.finditer(text) if re.fullmatch(r"[A-ZÉÑ][^\W\d_]?['’\-a-zA-ZéñÉÑ]{0,29}", m.group().split(" ")[0]) and len(m.group().split(" ")[0]) > 1]
    want = set()
    for i in range(len(pieces)):
        for k in range(1, 5):
            p = pieces[i:i + k]
            if len(p) == k and all(a[2].endswith(" ") and a[1] == b[0] for a, b in zip(p, p[1:])):
                want.add((p[0][0], "".join(x[2] for x in p[:-1]) + p[-1][2].split(" ")[0]))
    got = spark.createDataFrame([(text,)], "text string").select(F.explode(persons.windows("text")).alias("w")).select("w.start", "w.value").collect()
    assert {(r["start"], r["value"]) for r in got} == want and len(got) == len(want)


def test_nobody_confirmed_and_empty_tables(spark):
    docs, taken = spans_of(spark, ["John Smith called.", None])
    assert persons.marked(docs, taken) is None
    docs, taken = spans_of(spark, [])
    assert persons.marked(docs, taken) is None


def test_no_text_is_shuffled_and_hot_names_are_whole(spark):
    n = 3000
    docs = spark.range(n).select(F.col("id").alias("_row"), F.lit("So John Smith said").alias("text"))
    taken = spark.createDataFrame([(n + 1, "PERSON", "John Smith", 0, 10)], "_row bigint, type string, value string, start int, end int")
    out = persons.marked(docs, taken)
    assert out.where("value = 'John Smith' and start = 3 and end = 13").count() == out.count() == n


def test_in_the_plan_and_back(spark):
    texts = ["Mr. John Smith signed on 3 March 2020.", "We met John Smith there.", "We met john there.", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    keys = vault.Keys(b"k")
    safe, mapping = plan.pseudonymise(docs, "s", keys)
    out = {r["doc_id"]: r["safe_text"] for r in safe.collect()}
    assert "Smith" not in out[0] + out[1] and out[2] == texts[2] and out[0].startswith("Mr. ")
    # One person, one surrogate, with a title or without.
    assert out[1].removeprefix("We met ").removesuffix(" there.") in out[0]
    back = {r["doc_id"]: r["restored"] for r in plan.restore(safe, mapping, "s", keys).select("doc_id", "restored").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
