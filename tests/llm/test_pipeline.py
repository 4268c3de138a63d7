import random
import re

import corpus_pipeline
from embergrid.llm import queries


def test_names_and_oracles():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES]
    assert numbers == list(range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "packing"]


def test_stages_against_a_plain_account(spark, tmp_path):
    rng = random.Random(6)
    vocab = {"aa": [f"{a}{b}o" for a in "bcdfg" for b in "lrnmst"], "bb": [f"{a}{b}ie" for a in "hjkpqt" for b in "vwxyz"]}
    rows = []
    for i in range(160):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, " ".join(rng.choices(vocab[lang], k=rng.choice([8, 30, 90]))), lang, f"s{i % 3}", 0))
    long = next(r for r in rows if len(r[1].split()) == 90)
    item = " ".join(rng.choices(vocab["aa"], k=30))
    rows += [
        (200, long[1], long[2], "s0", 0),
        (201, long[1] + " tail", long[2], None, 0),
        (202, "clean start bro " + item + " end", "aa", "s1", 0),
        (203, "blo bro bno card 4111111111111111 blo", "aa", "s1", 0),
        (204, None, "aa", "s1", 0),
        (205, "1234 ---", None, "s1", 0),
        (203, "blo bro bno card 4111111111111111 blo", "aa", "s1", 0),
    ]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = [{204, 205}, {200, 201}, {202}, set()]
    for (name, stage), gone in zip(corpus_pipeline.STAGES, want):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert before - {r["doc_id"] for r in docs.select("doc_id").collect()} == gone, name
    texts = docs.where("doc_id = 203").collect()
    assert len(texts) == 1 and "4111111111111111" not in texts[0]["text"] and re.fullmatch(r"blo bro bno card \d{16} blo", texts[0]["text"])
    packed = corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
