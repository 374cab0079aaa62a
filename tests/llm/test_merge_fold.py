import random

from veilmill.llm import registry, spm


def test_fold_merges_as_the_heap_does(spark):
    table, rnd = spm.Pieces.load(registry.PIECE_MODEL), random.Random(5)
    plain = [p for p, special in zip(table.pieces, table.special, strict=True) if not special]
    letters = "etaoinsrhldcumfpgwybvkxjqzETAÉß"
    units = {"".join(rnd.choice(letters) for _ in range(n)) for n in (1, 2, 3, 9, 30, 59, 60)} | {spm.SPACE + "internationalisation", "aaaaaaaaaaaaaaaa", "\n", "7", "漢字かな", *rnd.sample(plain, 40)}
    vocabulary = spark.createDataFrame([(0, u, [1]) for u in sorted(units)], "part bigint, unit string, uses array<int>")
    got = {r["unit"]: list(r["ids"]) for r in spm.merged(spm.lattice(vocabulary, table), table).collect()}
    ids = table.ids()
    assert got == {u: spm.merge_long(u, ids, table.scores, table) for u in units}
