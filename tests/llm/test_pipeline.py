import hashlib

import corpus_pipeline
import public_tokenizers
from helpers import linked, sha, simhash
from pagelens.llm import decontam, langid, queries
from pagelens.session import read_table
from pyspark.sql import functions as F
from test_dedup import normal
from test_texts import brute_marks
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    rejected = {r.doc_id for r in langid.predict(docs, model).collect() if r.rejected}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in rejected}
    first = {}
    for i in sorted(rows):
        first.setdefault(sha(normal(rows[i])), i)
    rows = {i: rows[i] for i in first.values()}
    fp = {i: simhash(t) for i, t in rows.items()}
    root = linked(sorted(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    rows = {i: rows[i] for i in rows if root[i] == i}
    bench = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    rows = {i: t for i, t in rows.items() if not brute_marks(t, bench)[1]}
    t = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    want = set()
    for i, x in rows.items():
        ids = t.encode(x, add_special_tokens=False).ids
        want.add((i, len(ids), sha(",".join(map(str, ids))), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_stages_keep_columns(spark):
    docs = read_table(spark, SF, "documents").withColumn("text_key", F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.filter("false"), SF).count() == 0
    assert decontam.SPAN == 10


def test_columns_with_the_operators_own_names_stay(spark):
    from helpers import documents
    from pagelens.llm import decontam, exact_dedup, importance, simhash

    own = ["_llm_text_key", "_llm_id", "_llm_key", "_llm_row", "_llm_i", "_llm_k"]
    d = documents(spark)
    for name in own:
        d = d.withColumn(name, d.doc_id)
    bench = spark.createDataFrame([("b", "nothing of this kind")], "item_id string, text string")
    for out in (exact_dedup.drop_duplicates(d), simhash.drop_near_duplicates(d), decontam.clean_documents(d, bench), importance.resample(d, bench)):
        assert out.columns == d.columns
        rows = out.collect()
        assert all(r[name] == r.doc_id for r in rows for name in own)
    assert decontam.clean_documents(d, bench).count() == d.count()


def test_one_row_of_a_component_is_kept(spark):
    from helpers import documents
    from pagelens.llm import simhash

    near = simhash.near_duplicates(documents(spark)).collect()
    per = {}
    for r in near:
        per[r.component_id] = per.get(r.component_id, 0) + r.kept
    assert set(per.values()) == {1}
