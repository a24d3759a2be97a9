"""What the saved lexical index and its searches shuffle: bytes written by the stages of a call."""

from pyspark.sql import functions as F

from docengine.operators import block_index, lexical
from docengine.plans import retrieve as R

TOKENS = "split(text, ' ')"


def shuffled(spark, call):
    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    call()
    return sum(n for k, n in stages().items() if k not in before)


def documents(spark, n=3000, words=150):
    word = lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(40) + F.pmod(F.xxhash64(i), F.lit(2000))).cast("string"))
    return spark.range(n).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), word), " ").alias("text"))


def test_build_shuffles_packed_blocks(spark, tmp_path):
    docs = documents(spark)
    moved = shuffled(spark, lambda: block_index.build(docs, f"file://{tmp_path}/index", "id", F.expr(TOKENS)))
    index = block_index.load(spark, f"file://{tmp_path}/index")
    plain = lexical.build(docs, "id", F.expr(TOKENS))
    postings = index.blocks.select("term", "n", F.explode("posts").alias("p")).select("p.id", "p.dl", "term", "p.tf")
    assert not postings.exceptAll(plain.postings.select("id", "dl", "term", "tf")).count() and postings.count() == plain.postings.count()
    assert (index.n, index.avgdl) == tuple(plain.stats.first())
    assert moved < 20 * postings.count()


def asked(spark, n):
    return documents(spark, n, 30).withColumnRenamed("id", "query_id")


def test_search_shuffles_blocks_not_pairs(spark, tmp_path):
    docs, queries = documents(spark), asked(spark, 100)
    block_index.build(docs, f"file://{tmp_path}/index", "id", F.expr(TOKENS))
    index, terms = block_index.load(spark, f"file://{tmp_path}/index"), lexical.query_terms(queries, "query_id", F.expr(TOKENS))
    pairs = terms.join(index.terms, "term").agg(F.sum("df")).first()[0]
    moved = shuffled(spark, lambda: block_index.search(index, terms, 10).collect())
    assert moved < 26 * pairs
    assert block_index.postings_read(index, terms, 10).agg(F.sum("total")).first()[0] == pairs


def test_retrieval_shuffles_no_texts(spark, tmp_path):
    rows = documents(spark, 2000, 600)
    rows.withColumn("title", F.lit("t")).withColumn("category", F.lit("c")).write.parquet(f"file://{tmp_path}/chunks")
    chunks = spark.read.parquet(f"file://{tmp_path}/chunks")
    vectors = chunks.select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    plan = R.retrieve(chunks, vectors, asked(spark, 5), vectors.filter("id < 5").withColumnRenamed("id", "query_id"), index=lexical.build(chunks, "id", F.expr(TOKENS)))
    assert plan.count() == 50
    assert shuffled(spark, lambda: plan.select("content").write.format("noop").mode("overwrite").save()) < 3_000_000


def test_slices_hold_every_document_once(spark):
    import pyarrow as pa

    sizes = [0, 5, block_index.SLICE + 1, 0, 3, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([n if n is None else ["a"] * n for n in sizes])], names=["id", "tokens"])
    slices = list(block_index._slices([batch, batch.slice(0, 0)]))
    assert [i for s in slices for i in s.column(0).to_pylist()] == list(range(6))
    assert len(slices) == 3
