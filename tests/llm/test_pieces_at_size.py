import os
import random
import subprocess
import sys

import pyarrow as pa
import sentencepiece

from veilmill.llm import registry, spm

#: Chunks of random words: MB that they take at their peak beyond what there was before.
PEAK = """
import sys
import pyarrow as pa
from veilmill.llm import spm

class Task:
    get = staticmethod(lambda: Task)
    partitionId = staticmethod(lambda: 0)

def mb(what):
    return int(open("/proc/self/status").read().split(what + ":")[1].split()[0]) / 1024

spm.TaskContext = Task
batch = pa.ipc.open_file(pa.memory_map(sys.argv[1])).get_batch(0)
before = mb("VmRSS")
rows = sum(spm._from_bytes(spm._from_bytes(r.column(1)[0].as_py()).column("rows")[0].as_py()).num_rows for r in spm._chunked(1, 9)(iter([batch])))
assert rows == 8_000
print(mb("VmHWM") - before)
"""


def test_chunks_leave_room_for_two_tasks(tmp_path):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("etaoinsrhldcumfpg", k=rnd.randint(2, 8))) for _ in range(300_000)]
    batch = pa.record_batch([pa.array(range(8_000), pa.int64()), pa.array(" ".join(rnd.choices(vocabulary, k=500)) for _ in range(8_000))], names=["key", "text"])
    with pa.ipc.new_file(tmp_path / "batch", batch.schema) as out:
        out.write_batch(batch)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.run([sys.executable, "-c", PEAK, tmp_path / "batch"], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True)
    assert float(run.stdout) < 225


def test_assembly_of_a_chunk_keeps_nothing_large():
    rnd, table = random.Random(4), spm.Pieces.load(registry.PIECE_MODEL)
    n, n_units = 4_000_000, 200_000
    planes = pa.record_batch({f"b{k}": pa.array([rnd.randbytes(n) if k < 2 else bytes(n)], pa.large_binary()) for k in range(4)})
    rows = pa.record_batch({"key": pa.array(range(n // 1_000), pa.int64()), "n": pa.array([1_000] * (n // 1_000), pa.int64())})
    named = pa.record_batch({"unit": pa.array(f"u{i:x}" for i in range(n_units)), "part": pa.array([0] * n_units, pa.int64()), "code": pa.array(range(n_units), pa.int32())})
    codes, rows, named = (spm._to_bytes(x) for x in (planes, rows, named))
    body = pa.record_batch({"codes": pa.array([codes], pa.binary()), "rows": pa.array([rows], pa.binary()), "units": pa.array([named], pa.binary())})
    encoded = pa.record_batch({"chunk": pa.array([7] * n_units, pa.int64()), "code": pa.array(range(n_units), pa.int32()), "ids": pa.array([[300 + i % 30_000] for i in range(n_units)], pa.list_(pa.int32()))})
    found = [r.column(1)[0].as_py() for r in spm._found(iter([encoded]))]
    batch = pa.record_batch([pa.array([spm._to_bytes(body)], pa.binary()), pa.array([found], pa.list_(pa.binary()))], names=["packed", "found"])
    pool, count = pa.default_memory_pool(), 0
    before, most = pool.bytes_allocated(), 0
    for part in spm._assembled("k", table)(iter([batch])):
        count, most = count + part.num_rows, max(most, pool.bytes_allocated() - before)
    assert count == n // 1_000 and most < 8_000_000


def test_marks_of_blanks_beside_blanks_are_one_run(spark):
    table, model = spm.Pieces.load(registry.PIECE_MODEL), sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_MODEL)
    texts = ["x▁ y", "x▁ 7", "x ▁y", "▁", "a▁", " ", "  ", "a  b▁▁ c", "plain words", "line one\nline two  ", ""]
    got = spm.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), table).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in got} == {i: model.encode(t) for i, t in enumerate(texts)}


def test_one_pass_and_late_edges_merge_as_the_heap_does(spark):
    rnd, n_late = random.Random(8), 0
    for byte in (False, True):
        strings = sorted({"".join(rnd.choices("abcé漢", k=rnd.randint(2, 5))) for _ in range(150)} | set("abé漢" + spm.SPACE))
        pieces = ["<unk>", *([f"<0x{b:02X}>" for b in range(256)] if byte else []), *strings]
        scores = [0.0] * (len(pieces) - len(strings)) + [-float(x) for x in rnd.choices(range(120), k=len(strings))]
        special = [True] * (len(pieces) - len(strings)) + [False] * len(strings)
        table = spm.Pieces(spm.BPE, pieces, scores, special, list(range(1, 257)) if byte else [], 0)
        n_late += len(table.late())
        units = sorted({"".join(rnd.choices("abcé漢", k=rnd.randint(1, 25))) for _ in range(300)} | {"😀a", spm.SPACE})
        got = {r["unit"]: list(r["ids"]) for r in spm.merged(spm.lattice(spark.createDataFrame([(0, u, [1]) for u in units], "part bigint, unit string, uses array<int>"), table), table).collect()}
        ids = table.ids()
        assert got == {u: spm.merge_long(u, ids, scores, table) for u in units}
    assert n_late > 20


def test_texts_without_words_by_the_chunk_and_by_the_step(spark):
    table, model = spm.Pieces.load(registry.PIECE_MODEL), sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_MODEL)
    for texts in ([""], [None, ""] * 3, [""] * spm.CHUNK_STEP + ["plain words"], ["plain words"] + [""] * (2 * spm.CHUNK_STEP) + ["more words"]):
        got = spm.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), table).collect()
        assert {r["doc_id"]: list(r["ids"]) for r in got} == {i: model.encode(t or "") for i, t in enumerate(texts)}
