"""The pipeline's stages on the smallest tables with cases of our own, each against a plain version."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    word = [f"thand{chr(97 + i // 26)}{chr(97 + i % 26)}er" for i in range(200)]
    line = "this line of ten words is the same in both texts"
    own = [
        (10_001, " ".join(word[:100]) + "\n" + line, "en", "src1", 0), (10_002, " ".join(word[100:]) + "\n" + line, "en", "src1", 0),
        (10_003, " ".join(word[20:140]), "en", "src2", 0), (10_004, " ".join(word[20:140]) + "\nand x@y.org", "en", "src2", 0), (10_005, None, "en", "src2", None), (10_006, "", None, None, 0),
    ]
    docs = docs.unionByName(spark.createDataFrame(own, docs.schema))
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_order(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language identification", "line deduplication", "n-gram Jaccard join", "personal data", "best-fit packing"]


def test_only_texts_without_a_language_go(stages):
    gone = {r["doc_id"] for r in stages[0].join(stages[1], "doc_id", "left_anti").collect()}
    assert gone == {10_005, 10_006}


def test_repeated_lines_go_but_documents_stay(stages):
    assert stages[2].count() == stages[1].count()
    text = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    assert text[10_001].endswith("in both texts") and "both texts" not in text[10_002]
    seen = []
    for d in sorted(text):
        for line in text[d].split("\n"):
            w = line.lower().split()
            s = set(w)
            if w:
                assert not any(100 * len(s & o) >= 80 * len(s | o) for o in seen), (d, line)
                seen.append(s)


def test_one_of_each_group_of_near_copies_stays(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    after = {r["doc_id"] for r in stages[3].select("doc_id").collect()}
    grams = {}
    for d, t in before.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        grams[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    least = {d: d for d in before}
    changed = True
    while changed:
        changed = False
        for a in before:
            for b in before:
                if a < b and grams[a] and least[a] != least[b] and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    assert after == {d for d in before if least[d] == d}


def test_personal_data_is_gone_and_the_rest_is_left(stages):
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in stages[3:5])
    assert before.keys() == after.keys()
    for d, t in after.items():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)
        if t != before[d]:
            assert re.sub(r"<(EMAIL|IP|CARD|PHONE|SECRET|LOCAL_PHONE)>", "", t) != t


def test_all_tokens_are_packed(stages):
    packed = stages[5]
    assert packed.select("doc_id").distinct().count() == stages[4].count()
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 4096 for r in full)


def test_run_is_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).columns == stages[5].columns
