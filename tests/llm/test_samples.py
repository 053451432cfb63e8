"""The bounded fitting sample: every language keeps its share."""

from questlake.llm import language
from questlake.sources.ods import table

DATA = "/root/testdata/sf0.001"


def test_all_languages_are_found_under_a_small_bound(spark):
    samples = table(spark, DATA, "lang_samples")
    docs = samples.select("sample_id", "text", "lang").where("sample_id % 5 = 0")
    found = language.languages(docs, samples, id_col="sample_id", keep=["lang"], max_samples=400).collect()
    assert {r.lang for r in found} == {r.found_lang for r in found} == set(language.LABELS)
    assert sum(r.lang == r.found_lang for r in found) / len(found) >= 0.9


def test_a_small_language_keeps_all_its_rows(spark):
    rows = [("en", f"text {i}") for i in range(100)] + [("zh", f"text {i}") for i in range(3)] + [(None, "x"), ("en", None)]
    df = spark.createDataFrame(rows, "lang string, text string")
    kept = language.fitting_sample(df, 10)
    assert [lang for lang, _ in kept] == ["en"] * 7 + ["zh"] * 3
    assert language.fitting_sample(df, 1000) == sorted(rows[:103])
