from collections import Counter

import corpus_pipeline
import pytest
from cases import ALNUM_WORDS, ASCII_LOWER, FOLDER, SPACE_WORDS, awkward, components

from pyspark.sql import functions as F

from clickloom.llm.queries import tokenizer_path

STAGES = dict(corpus_pipeline.STAGES)
CLASHES = "row int, own string, times boolean, first int, copies int, __clean string"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Awkward documents in files: repeated rows, one id with several texts, a passage of the benchmark, clashing columns."""
    _, rows = awkward(spark)
    passage = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(r[0], r[1], r[2]) for r in rows] + [rows[5]] * 3
    rows += [(rows[7][0], f"before {passage} after", "src1"), (rows[8][0], rows[9][1], "src1"), (10_050, f"{passage}", None)]
    folder = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    full = [(*r, 1, "x", True, 2, 3, "y") for r in rows]
    spark.createDataFrame(full, f"doc_id long, text string, source string, {CLASHES}").repartition(3).write.parquet(folder)
    return spark.read.parquet(folder), rows


def kept(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_one_row_of_each_group_stays(spark, written):
    docs, rows = written
    out = STAGES["jaccard_join"](spark, docs, FOLDER)
    got = kept(out)
    assert out.columns == docs.columns and not got - Counter(rows)
    numbered = [(i, text) for i, (_, text, _) in enumerate(rows)]
    groups = {}
    for i, n, group in components(numbered):
        groups.setdefault(("alone", i) if n == 0 else group, []).append(rows[i])
    assert sum(got.values()) == len(groups)
    for members in groups.values():
        least = min(members, key=lambda r: (r[0] is None, r[0] or 0))[0]
        assert any(got[m] and m[0] == least for m in members)


def test_rows_with_passages_go(spark, written):
    docs, rows = written
    items = [ALNUM_WORDS.findall(r.text.translate(ASCII_LOWER)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(len(w) - 9, 1))}

    def clean(text):
        words = ALNUM_WORDS.findall((text or "").translate(ASCII_LOWER))
        return not any(tuple(words[i : i + 10]) in windows for i in range(len(words)))

    out = STAGES["decontamination"](spark, docs, FOLDER)
    assert out.columns == docs.columns
    assert kept(out) == Counter(r for r in rows if clean(r[1])) and len(rows) - out.count() >= 2


def test_mix_takes_no_row_more_than_twice(spark, written):
    docs, rows = written
    out = STAGES["source_mixing"](spark, docs, FOLDER)
    got, given = kept(out), Counter(rows)
    assert out.columns == docs.columns and all(n <= 2 * given[r] for r, n in got.items())
    size = lambda r: len(SPACE_WORDS.findall(r[1] or ""))
    for source in {r[2] for r in rows}:
        own = sum(size(r) for r in rows if r[2] == source)
        assert sum(size(r) * n for r, n in got.items() if r[2] == source) <= 2 * own
    assert got == kept(STAGES["source_mixing"](spark, docs.repartition(5), FOLDER))


def test_quality_keeps_whole_rows(spark, written):
    docs, rows = written
    out = STAGES["quality_rules"](spark, docs, FOLDER)
    got = kept(out)
    assert out.columns == docs.columns and 0 < sum(got.values()) < len(rows)
    assert all(n == Counter(rows)[r] and len(SPACE_WORDS.findall(r[1] or "")) >= 20 for r, n in got.items())


def test_frames_that_are_no_files_and_empty_tables(spark, written):
    docs, _ = written
    memory = spark.createDataFrame([(1, "one two three", "s"), (1, "one two three", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert kept(STAGES["jaccard_join"](spark, memory, FOLDER)) == Counter([(1, "one two three", "s"), (2, None, None)])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name


def test_run_goes_through_all_stages(spark):
    """The rows of the last stage are the records of what the stages before it keep, run by hand."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, folder = docs.count(), corpus_pipeline.new_folder(spark, name)
        stage(spark, docs, FOLDER).write.parquet(folder)
        docs = spark.read.parquet(folder)
        assert 0 < docs.count() <= 2 * before
    texts = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = [(d, len(e.ids) + 1) for (d, _), e in zip(texts, tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False))]
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted(want)
    assert got.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == sum(n for _, n in want)


def test_stages_called_by_themselves_have_the_settings(spark, written):
    docs, _ = written
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(key)
        stage(spark, docs.limit(0), FOLDER)
        assert spark.conf.get(key) == "true", name


def test_the_plan_of_the_rules_does_not_hold_the_weights(spark, written):
    docs, _ = written
    plan = STAGES["quality_rules"](spark, docs, FOLDER)._jdf.queryExecution()
    assert len(plan.toString()) < 100_000 and len(plan.executedPlan().toString()) < 100_000
