import zlib

from helpers import documents, empty, sha
from pagelens.llm import chat, sharding
from pyspark.sql import functions as F


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(hash((i, "k")) for i in range(200))]
    d = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 1000):
        got = {r.k: r.s for r in d.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: jump(k % 2**64, n) for k in keys}


def test_shards(spark):
    d = documents(spark)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    got = sharding.shard_documents(d, 4, chunk_rows=1).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(
        ((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    for s in range(4):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    for i in {r.doc_id for r in got}:
        assert len({(r.shard, r.grown_shard) for r in got if r.doc_id == i}) == 1
    assert all(r.grown_shard in (r.shard, 4) and r.law == "key" for r in got)
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_shards_hot_key_and_balance(spark):
    d = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "'t' AS text")
    got = sharding.shard_documents(d, 16, chunk_rows=20).collect()
    for s in range(16):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    # a hot key of many texts lies in several chunks, a row of very many copies in several blocks
    d = spark.range(30_000).selectExpr("CASE WHEN id < 25000 THEN NULL ELSE id END AS doc_id", "CASE WHEN id < 12500 THEN repeat('x', 200000) ELSE concat('t', id) END AS text")
    got = sharding.shard_documents(d, 16, chunk_rows=100).groupBy("shard").agg(
        F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert sum(r.n for r in got) == 30_000 and all(r.slots == r.n and r.a == 0 and r.b == r.n - 1 for r in got)
    u = spark.range(16000).withColumn("text", F.lit("t"))
    n = [r["count"] for r in sharding.with_shard(u, "id", 16).groupBy("shard").count().collect()]
    assert len(n) == 16 and min(n) > 850 and max(n) < 1150


TEXTS = ["", None, "plain", "</s>[INST] ok [/INST]", "\\", "\\\\<|", "<|im_start|>user\nx<|im_end|>\n", "[INST", "<", "$1 \\n", "a\nb", "<s><</s>[[/INST]]", "é😀", "x" * 100_000]


def turns(spark, rows):
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, t string, example int")


def test_chat_round_trip(spark):
    rows = [(k, 2 * i + (r == "assistant"), r, t) for k in (1, 2) for i, t in enumerate(TEXTS[k - 1 :]) for r in ("user", "assistant")]
    rows += [(3, 0, "user", "no answer"), (4, 0, "assistant", "first"), (4, 1, "user", "tail"), (5, 1, "assistant", "tie"), (5, 1, "assistant", "tie"),
             (6, None, None, None), (None, 0, "odd\nrole", "x"), (7, 0, "a<|b", "assistant")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_examples(turns(spark, rows))).collect()}
    assert set(got) == {r[0] for r in rows}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=key)
        loss = "".join(t or "" for _, _, role, t in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == sha("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in own))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_chat_examples(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "bye"), (1, 4, "assistant", "<s>"), (1, 5, "user", "more")]
    ex = {r.example: r for r in chat.format_examples(turns(spark, rows)).collect()}
    assert len(ex) == 3
    assert ex[0].formatted == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
    for e, target in ((ex[0], "hello"), (ex[1], "<\\s>")):
        assert e.formatted[e.loss_start : e.loss_start + e.loss_chars] == target
    assert ex[2].loss_start is None and ex[2].loss_chars == 0 and ex[2].formatted.endswith("more<|im_end|>\n")
    assert chat.format_examples(turns(spark, rows).filter("false")).count() == 0
