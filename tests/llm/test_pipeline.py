import zlib

import corpus_pipeline

from . import brute


def test_stages_in_turn(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before.collect(), docs.collect())

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, after = seen["quality"]
    kept = {r.doc_id for r in after}
    assert kept >= {r.doc_id for r in before if labels.get(r.doc_id) == 1} and not kept & {i for i, q in labels.items() if q == 0}

    before, after = seen["exact_dedup"]
    last = {}
    for r in sorted(before):
        last[brute.lower(r.text)] = r.doc_id
    assert sorted(r.doc_id for r in after) == sorted(last.values())

    before, after = seen["simhash"]
    groups = brute.simhash_components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in groups.values()})

    before, after = seen["mixing"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and set(after) <= set(before)

    before, after = seen["packing"]
    tokens = {}
    for r in after:
        tokens.setdefault(r.doc_id, 0)
        tokens[r.doc_id] += r.length
    copies = {}
    for r in before:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    whole = {r.doc_id: r.doc_tokens for r in after}
    assert tokens == {i: n * whole[i] for i, n in copies.items()}


def test_run_gives_token_ids(spark, sf_dir):
    for r in corpus_pipeline.run(spark, sf_dir).limit(200).collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32


def _packed(df):
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return sorted(map(str, df.select(*cols).collect()))


def test_run_is_the_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    want = _packed(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir))
    assert _packed(corpus_pipeline.run(spark, sf_dir)) == want and want


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp string, norm string, place long"


def test_odd_rows_pass_all_stages(spark, tmp_path):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    texts = [(1, "", "en", "a"), (2, None, None, None), (None, "some words stand here\nand here too", "en", "b"), (3, long, "de", "a"), (4, "Same text as the next", "en", "b"), (5, "same text AS the next", "en", None), (5, "same text AS the next", "en", None), (None, None, None, None)]
    spark.createDataFrame([(*t, 0, "own", "own", "own", 1) for t in texts], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = {(r.doc_id, r.text) for r in docs.collect()}
    assert docs.count() == len(left) == 4 and left == {(2, None), (None, texts[2][1]), (3, long), (5, texts[5][1])}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {2, None, 3, 5} and all(r.doc_tokens == 1 for r in out if r.doc_id == 2)


def test_empty_table_and_no_leftovers(spark, tmp_path):
    import glob

    from reelframe.llm.common import shared_dir

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda: {p for p in glob.glob(shared_dir(spark).removeprefix("file://") + "/*") if "pack-" not in p}
    before = held()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert held() == before
